"""Similarity join and term counts against brute force, and their odd inputs."""

import random
import re
from collections import defaultdict

import pytest

from declarium.llm import similar, terms

DECLS = "decl_id bigint, body_text string, cls string, g bigint, s bigint, extracted_at timestamp"


def body(rng, words=60):
    return " ".join(rng.choice("abcdefghij") + rng.choice("xyzuvw") + str(rng.randrange(9)) for _ in range(words))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
    return " ".join(words)


def brute(rows):
    sets = {}
    for key, text in rows:
        if key is None or text is None:
            continue
        w = re.findall(r"[A-Za-z0-9_]+", text)
        w = [x.lower() for x in w]
        if len(w) >= 30:
            sets[key] = frozenset(zip(w, w[1:], w[2:], strict=False))
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}


@pytest.mark.parametrize("block", [2, 1024])
def test_pairs(spark, block):
    rng = random.Random(5)
    rows = [(None, "x " * 40), (1000, None), (1001, ""), (1002, "too short to count"), (1003, "w " * 5000)]
    key = 0
    for _ in range(8):
        base = body(rng)
        for e in (0, 0, 1, 3, 8, 12):
            rows.append((key, edited(rng, base, e)))
            key += 1
    rows.append((key, rows[10][1].upper().replace(" ", " ;\n")))  # the same words, laid out otherwise
    rows += rows[10:20]  # delivered again
    df = spark.createDataFrame([(k, t, "clash", 1, 2, None) for k, t in rows], DECLS)
    got = [tuple(r) for r in similar.found(df, block=block).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_classes(spark):
    rng = random.Random(6)
    a, b = body(rng), body(rng)
    near = edited(rng, a, 3)
    df = spark.createDataFrame([(i, t, "", 0, 0, None) for i, t in enumerate([a, a, a, near, b])], DECLS)
    assert {tuple(r) for r in similar.classes(df).collect()} == {(0, 0, 2, 1), (1, 0, 2, 1), (2, 0, 2, 1), (3, 3, 0, 1), (4, 4, 0, 0)}


def test_no_bodies(spark):
    assert similar.found(spark.createDataFrame([], DECLS)).collect() == []


ITEMS = (
    "project string, ordinal int, signature struct<params:array<struct<name:string,norm_type:string>>>,"
    " deps struct<external_packages:array<string>,env_vars:array<string>>, ingested_at timestamp_ntz, term string, items bigint"
)


def counted(rows, rare=2, common=0.1):
    one = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            one[r[0], r[1]] = r
    hits, held = defaultdict(int), defaultdict(set)
    for key, r in one.items():
        lists = {"norm_type": [p[1] for p in (r[2] or ([],))[0] or []], "external_packages": (r[3] or ([], []))[0] or [], "env_vars": (r[3] or ([], []))[1] or []}
        for field, values in lists.items():
            for v in values:
                if v is not None and v.strip():
                    hits[field, v.strip()] += 1
                    held[field, v.strip()].add(key)
    mark = lambda n: "rare" if n <= rare else "common" if n >= common * len(one) else None
    return {(f, t, n, len(held[f, t]), mark(len(held[f, t]))) for (f, t), n in hits.items()}


@pytest.mark.parametrize("heavy", [2, 256])
def test_terms(spark, heavy):
    rng = random.Random(2)
    rows = [(None, 1, ([("a", "lost")],), None, None, "x", 0), ("p", None, None, (["lost"], None), None, "x", 0), ("p", 9000, None, None, None, "x", 0), ("p", 9001, (None,), ([None, "", " \t"], []), None, "x", 0)]
    for i in range(300):
        types = [("a", "i64" if rng.random() < 0.6 else f"obj:T{rng.randrange(80)}") for _ in range(rng.randrange(4))] + [("b", " any\n")] * (i % 9 == 0) * 2
        rows.append((rng.choice("pq"), i, (types,), ([rng.choice(["kikin", " kikin ", "Kikin", f"k{i % 70}"])], ["E"] * (i % 3)), None, "x", 0))
    rows += rows[10:30]
    got = {tuple(r) for r in terms.frequencies(spark.createDataFrame(rows, ITEMS), heavy=heavy).collect()}
    assert got == counted(rows)
    assert {(r.field_name, r.term, r.mark) for r in terms.found(spark.createDataFrame(rows, ITEMS)).collect()} == {(f, t, m) for f, t, _, _, m in got if m}


def test_no_items(spark):
    assert terms.found(spark.createDataFrame([], ITEMS)).collect() == []
