"""Encoding, leaks and quality of texts."""

import random
import re

import pytest

from declarium.llm import leaks, quality, tokens

DOCS = "doc_id bigint, text string, lang string, updated_at timestamp_ntz, ids array<int>, item_id bigint, stats double"

needs_vocabulary = pytest.mark.skipif(not __import__("os").path.exists(tokens.VOCABULARY), reason="no public vocabulary here")


def docs(spark, rows):
    return spark.createDataFrame([(k, t, lang, None, None, None, None) for k, t, lang in rows], DOCS)


def test_lexicon():
    rng = random.Random(3)
    entries = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))): [rng.randrange(9) for _ in range(rng.randrange(1, 4))] for _ in range(400)}
    built = tokens.Lexicon.build(entries)
    import numpy as np

    mapped = tokens.Lexicon.over(np.frombuffer(built.to_bytes(), np.uint8))
    for lexicon in (built, mapped):
        words = [*entries, b"", b"zzz", b"abcabcabcabcabc", b"c" * 99]
        for w, i in zip(words, lexicon.find(words).tolist(), strict=True):
            ids = lexicon.ids[lexicon.starts[i] : lexicon.starts[i + 1]].tolist() if i >= 0 else None
            assert ids == entries.get(w)
    assert len(built.final) < sum(map(len, entries))  # suffixes are shared
    assert tokens.Lexicon.build({}).find([b"a"]).tolist() == [-1]


@needs_vocabulary
def test_ids(spark):
    text = "The reader's cat — naïve ﬁlter! 123 <|endoftext|> 漢字 🧵\r\n\t  end  "
    rows = [(1, text, "en"), (2, "", None), (3, None, None), (4, " \n", "en"), (5, "x" * 30_000, None), (6, "the reader the reader", None), (1, text, "en"), (None, "lost", None)]
    got = {r.doc_id: list(r.ids) for r in tokens.encode(docs(spark, rows)).collect()}
    encoder = tokens.vocabulary(tokens.VOCABULARY)
    assert got == {k: encoder.encode_ordinary(t) if t else [] for k, t, _ in rows if k}
    assert encoder.decode(got[1]) == text
    few = {r.doc_id: list(r.ids) for r in tokens.encode(docs(spark, rows), words=1).collect()}
    assert few == got  # the lexicon's size changes no result
    assert tokens.encode(docs(spark, [])).collect() == []


def words(rng, n):
    return " ".join(f"w{rng.randrange(40)}" for _ in range(n))


@pytest.mark.parametrize("block", [10**6, 60])
def test_leaks(spark, block):
    rng = random.Random(4)
    items = [(i, words(rng, rng.randrange(12, 40))) for i in range(12)] + [(50, None), (51, "too short"), (52, "")]
    items.append((53, items[0][1]))  # shares all with another
    rows = [(i, words(rng, 60), "en") for i in range(30)]
    for i, (item, text) in enumerate(items[:8]):
        w = text.split()
        rows.append((100 + i, words(rng, 9) + " " + " * ".join(w[:12]).upper() + "\n" + words(rng, 5), "en"))
        rows.append((200 + i, words(rng, 9) + " gap " + " ".join(w[:11]) + " gap " + words(rng, 5), "en"))
    rows += [(300, None, None), (301, "", None), (None, items[0][1], None), (302, (items[3][1] + " . ") * 400, "en"), rows[40]]
    held = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, suite string")
    got = [tuple(r) for r in leaks.leaks(docs(spark, rows), held, words=block).collect()]
    word = re.compile(r"[^\W_]+")
    windows = {}
    for i, t in items:
        w = [x.lower() for x in word.findall(t or "")]
        for k in range(len(w) - 11):
            windows.setdefault(tuple(w[k : k + 12]), set()).add(i)
    expected = set()
    for k, t, _ in rows:
        w = [x.lower() for x in word.findall(t or "")]
        expected |= {(k, i) for j in range(len(w) - 11) for i in windows.get(tuple(w[j : j + 12]), ()) if k is not None}
    assert len(got) == len(set(got))
    assert set(got) == expected
    assert leaks.leaks(docs(spark, []), held, words=block).collect() == []


def test_fingerprints_within_the_radius_meet():
    import numpy as np

    rng = np.random.default_rng(1)
    base = leaks.Index([(1, np.array(leaks.word_hashes(" ".join(f"q{i}" for i in range(30))), np.uint64))])
    for bit in range(64):
        prints = base.prints ^ np.uint64(1 << bit)
        m, t = base.candidates(prints)
        assert {(i, i) for i in range(len(prints))} <= set(zip(m.tolist(), t.tolist(), strict=True))
    assert len(base.candidates(rng.integers(0, 2**63, 1000).astype(np.uint64))[0]) == 0


def test_weighted_similarity_against_sets():
    import numpy as np

    rng = random.Random(5)
    texts = [words(rng, 24) for _ in range(12)]
    items = [(i, np.array(leaks.word_hashes(t), np.uint64)) for i, t in enumerate(texts)]
    index = leaks.Index(items, 24, 64)
    document = np.array(leaks.word_hashes(words(rng, 40) + " " + texts[3] + " " + words(rng, 30)), np.uint64)
    m, t = index.candidates(leaks.fingerprints(document, 24))
    assert len(m) == (len(document) - 23) * 12  # every pair is within 64 bits
    held = [set(leaks._shingles(h).tolist()) for _, h in items]

    def weight(shingles):
        return sum(1 / max(1, sum(s in h for h in held)) for s in shingles)

    for i, j, alike in zip(m.tolist(), t.tolist(), index.similarity(document, m, t).tolist(), strict=True):
        a, b = set(leaks._shingles(document[i : i + 24]).tolist()), held[index.owner[j]]
        assert alike == pytest.approx(weight(a & b) / weight(a | b))
        assert (alike == 1.0) == (document[i : i + 24].tolist() == index.words[j].tolist())


def test_a_passage_is_a_succession(spark):
    """The same pairs of words in another order are no passage."""
    one, other = "a b a c a d a e a f a g a", "a c a b a d a e a f a g a"
    held = spark.createDataFrame([(1, one)], "item_id bigint, text string")
    assert [tuple(r) for r in leaks.leaks(docs(spark, [(1, one, "en"), (2, other, "en")]), held).collect()] == [(1, 1)]


def test_edited_passages(spark):
    """The radius finds passages with a word changed in every twelve, which hold no equal passage."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=100))) for i in range(30)] + [(90, None), (91, ""), (92, "too short")]
    rows = []
    for i, text in items[:30]:
        w = text.split()
        for k in range(5, 100, 12):
            w[k] = rng.choice(vocabulary)
        rows.append((i, " ".join([*rng.choices(vocabulary, k=40), *w, *rng.choices(vocabulary, k=20)]), "en"))
    rows += [(1000 + i, " ".join(rng.choices(vocabulary, k=200)), "en") for i in range(50)] + [(2000, None, None), (None, items[0][1], None)]
    held = spark.createDataFrame(items, "item_id bigint, text string")
    assert leaks.leaks(docs(spark, rows), held).collect() == []
    near = {(r.doc_id, r.item_id) for r in leaks.passages(docs(spark, rows), held, radius=12).collect()}
    some = {(r.doc_id, r.item_id) for r in leaks.passages(docs(spark, rows), held).collect()}
    none = {(r.doc_id, r.item_id) for r in leaks.passages(docs(spark, rows), held, radius=0).collect()}
    true = {(i, i) for i in range(30)}
    assert none < some < near <= true
    assert len(near) >= 15


PROSE = "The reader can open the file when it is ready, and the writer will close it before the end. If you have more than one of these, then all of them are kept. "
COMMON = [("en", w) for w in "the can when it is and will before if you have more than one of these then all them are a to in for".split()] + [("de", w) for w in "die der und ist nicht wenn mit von wird eine".split()]


def test_quality(spark):
    listed = "\n".join(f"- item {i} of the box" for i in range(40))
    table = "\n".join(f"| a{i} | {i} | b |" for i in range(40))
    code = "def f(x):\n" + "\n".join(f"    y{i} = g(x, {i});" for i in range(40))
    salad = " ".join(random.Random(1).choice("frost lantern meadow copper tunnel marble".split()) for _ in range(200))
    rows = [(i, PROSE * (1 + i % 7), "en") for i in range(80)]
    rows += [(100, listed, "en"), (101, table, None), (102, code, "XX"), (103, salad, "en"), (104, "deadbeef" * 40, "en"), (105, PROSE.upper() * 3, "EN"), (106, PROSE * 8 + listed[:200], "en"), (107, None, None), (108, "", "en"), (109, " \n\t", "en"), (None, listed, "en"), (110, "> " + PROSE.replace(". ", ".\n> ") * 4, "en"), (100, listed, "en"), (111, PROSE * 3000, "en")]
    common = spark.createDataFrame([(lang, w) for lang, w in COMMON], "lang string, word string")
    got = [r.doc_id for r in quality.found(docs(spark, rows), common).collect()]
    assert sorted(got) == [100, 101, 102, 103, 104]
    out = {r.doc_id: r for r in quality.outlierness(docs(spark, rows), common).collect()}
    assert len(out) == 80 + 9
    assert all(abs(sum(r.contributions) - r.distance) < 1e-6 * max(1, abs(r.distance)) for r in out.values())
    assert max(quality.STATISTICS, key=dict(zip(quality.STATISTICS, out[104].contributions, strict=True)).get) in ("mean_word_length", "common_words", "formed_share", "digit_ratio")
    assert quality.found(docs(spark, []), common).collect() == []


def test_prose_is_what_most_documents_are(spark):
    """Lists are no outliers where nothing but lists is known: the centre comes from the documents."""
    rows = [(i, "\n".join(f"- item {k} of the box {i}" for k in range(20 + i % 9)), "en") for i in range(60)]
    rows += [(100 + i, PROSE * (2 + i % 3), "en") for i in range(6)]
    common = spark.createDataFrame([(lang, w) for lang, w in COMMON], "lang string, word string")
    assert sorted(r.doc_id for r in quality.found(docs(spark, rows), common).collect()) == list(range(100, 106))
