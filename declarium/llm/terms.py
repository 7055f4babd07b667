"""Exact frequency of every distinct term, by heavy-light aggregation.

A first pass over the raw rows detects heavy terms: each partition names the terms that make up at
least ``1 / HEAVY`` of its own, and every term that makes up that share of the whole does so in at
least one partition. They are sent to all workers, whose tasks count them exactly in local counter
arrays, one cell per term; only the light terms, combined per task, are shuffled by term. The two
count tables are then united.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declarium.sources import columns, latest, materialize

FIELDS = ("norm_type", "external_packages", "env_vars")
#: A term is heavy from this share of all occurrences; so there are at most so many.
HEAVY = 256
#: At most so many items: rare. At least this share of all items: common.
RARE, COMMON = 2, 0.1
#: What surrounds a term: blanks, tabs, line breaks.
BLANK = " \t\n\r\x0b\x0c"
_FLUSH = 200_000


def _field_lists(items: DataFrame) -> dict[str, Column]:
    return {"norm_type": F.col("signature.params.norm_type"), "external_packages": F.col("deps.external_packages"), "env_vars": F.col("deps.env_vars")}


def term_lists(items: DataFrame, once: bool = True) -> DataFrame:
    """(norm_type, external_packages, env_vars: array<string>), one row per item (or delivered row)."""
    lists = [c.alias(n) for n, c in _field_lists(items).items()]
    if not once:
        return items.select(*lists)
    flat = items.select("project", "ordinal", "ingested_at", *lists)
    return latest(flat, ["project", "ordinal"], "ingested_at").select(*FIELDS)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(number of the field, the item's terms) of each list that has any."""
    for f in range(batch.num_columns):
        for values in batch.column(f).to_pylist():
            if values:
                terms = [t for v in values if v and (t := v.strip(BLANK))]
                if terms:
                    yield f, terms


def heavy_terms(lists: DataFrame, heavy: int = HEAVY) -> list[tuple[int, str]]:
    """Terms that make up at least ``1 / heavy`` of all occurrences; at most ``heavy`` of them."""

    def detect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a counter of at most 8 * heavy cells: when it is full, all cells lose the smallest count, so
        # that each count is too small by at most total / (4 * heavy)
        cells: Counter[tuple[int, str]] = Counter()
        total = 0
        for batch in batches:
            for f, terms in _rows(batch):
                total += len(terms)
                for t in terms:
                    cells[f, t] += 1
                if len(cells) > 8 * heavy:
                    cut = sorted(cells.values())[len(cells) // 2]
                    cells = Counter({k: n - cut for k, n in cells.items() if n > cut})
        kept = {k: n for k, n in cells.items() if n * 2 * heavy >= total}
        yield pa.record_batch([pa.array([f for f, _ in kept], pa.int32()), pa.array([t for _, t in kept], pa.string()), pa.array(kept.values(), pa.int64()), pa.array([total] * len(kept), pa.int64())], ["f", "t", "n", "total"])

    found = lists.mapInArrow(detect, "f int, t string, n bigint, total bigint")
    top = found.groupBy("f", "t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "f", "t").limit(heavy)
    return [(r.f, r.t) for r in top.collect()]


def frequencies(items: DataFrame, rare: int = RARE, common: float = COMMON, heavy: int = HEAVY) -> DataFrame:
    """(field_name, term string, occurrences bigint, items bigint, mark string) of every distinct term.

    An item, (``project``, ``ordinal``), counts once however often it is delivered, by its latest
    ``ingested_at``; rows without either key are left out. ``occurrences`` counts repeats within a
    list, ``items`` does not. Null and blank values, null lists and null ``deps`` hold no terms.
    ``mark`` is ``rare`` up to ``rare`` items, else ``common`` from the share ``common`` of all items,
    else null. No items: no rows.
    """
    needed = columns(items, "project", "ordinal", "signature", "deps", "ingested_at")
    detected = heavy_terms(term_lists(needed, once=False), heavy)
    sent = items.sparkSession.sparkContext.broadcast({k: i for i, k in enumerate(detected)})

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value
        hits = np.zeros(len(place), np.int64)
        rows = np.zeros(len(place), np.int64)
        light: dict[tuple[int, str], list[int]] = defaultdict(lambda: [0, 0])
        n_items = 0
        for batch in batches:
            n_items += batch.num_rows
            for f, terms in _rows(batch):
                for t in terms:
                    k = (f, t)
                    if (i := place.get(k)) is not None:
                        hits[i] += 1
                    else:
                        light[k][0] += 1
                for t in set(terms):
                    k = (f, t)
                    if (i := place.get(k)) is not None:
                        rows[i] += 1
                    else:
                        light[k][1] += 1
            if len(light) > _FLUSH:
                yield _counts(light.keys(), [n for n, _ in light.values()], [m for _, m in light.values()], False)
                light.clear()
        yield _counts(light.keys(), [n for n, _ in light.values()], [m for _, m in light.values()], False)
        some = np.flatnonzero(hits)
        keys = list(place)
        yield _counts([keys[i] for i in some], hits[some].tolist(), rows[some].tolist(), True)
        yield _counts([(-1, "")], [n_items], [n_items], True)

    parts = term_lists(needed).mapInArrow(count, "f int, term string, occurrences bigint, items bigint, heavy boolean")
    parts = materialize(parts, "terms")
    all_items = parts.where("f = -1").agg(F.sum("items")).head()[0] or 0

    def summed(p: DataFrame) -> DataFrame:
        return p.groupBy("f", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("items").alias("items"))

    both = summed(parts.where("heavy AND f >= 0")).unionByName(summed(parts.where("NOT heavy")))
    name = F.element_at(F.array(*[F.lit(x) for x in FIELDS]), F.col("f") + 1)
    mark = F.when(F.col("items") <= rare, "rare").when(F.col("items") >= common * all_items, "common")
    return both.select(name.alias("field_name"), "term", "occurrences", "items", mark.alias("mark"))


def _counts(keys: Iterable[tuple[int, str]], hits: list[int], rows: list[int], heavy: bool) -> pa.RecordBatch:
    keys = list(keys)
    return pa.record_batch(
        [pa.array([f for f, _ in keys], pa.int32()), pa.array([t for _, t in keys], pa.string()), pa.array(hits, pa.int64()), pa.array(rows, pa.int64()), pa.array([heavy] * len(keys), pa.bool_())],
        ["f", "term", "occurrences", "items", "heavy"],
    )


def found(items: DataFrame) -> DataFrame:
    """(field_name, term, mark string): the terms that are too rare or too common."""
    return frequencies(items).where("mark IS NOT NULL").select("field_name", "term", "mark")


_LONG = """
WITH one AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, ordinal ORDER BY ingested_at DESC) AS rn FROM items
                 WHERE project IS NOT NULL AND ordinal IS NOT NULL) WHERE rn = 1
), long AS (
  SELECT 'norm_type' AS field_name, project, ordinal, unnest(list_transform(signature.params, lambda p: p.norm_type)) AS v FROM one
  UNION ALL SELECT 'external_packages', project, ordinal, unnest(deps.external_packages) FROM one
  UNION ALL SELECT 'env_vars', project, ordinal, unnest(deps.env_vars) FROM one
), terms AS (
  SELECT field_name, project, ordinal, trim(v, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS term FROM long WHERE v IS NOT NULL
), counted AS (
  SELECT field_name, term, count(*) AS occurrences, count(DISTINCT (project, ordinal)) AS items FROM terms WHERE term <> '' GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN items <= 2 THEN 'rare' WHEN items >= 0.1 * (SELECT count(*) FROM one) THEN 'common' END AS mark FROM counted
)
"""
FOUND_SQL = _LONG + "SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL"
FREQUENCIES_SQL = _LONG + "SELECT field_name, term, occurrences, items, mark FROM marked"
