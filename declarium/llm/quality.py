"""Text statistics of each document and its robust distance from prose of its language.

A task reads each text once and measures it; the measures, not the texts, are kept. For each
language the centre of all documents' statistics is the first guess at what prose looks like; then
mean and covariance are taken over the part of all documents that lies nearest, again and again, so
that lists, tables and junk cannot bend them. A document's outlierness is its squared Mahalanobis
distance from that prose. It is a sum over statistics, so each statistic's share in it is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.sources import columns, latest, materialize

#: The statistics, and how finely each is worth telling apart (a standard deviation added to its own).
RESOLUTION = {
    "log_words": 2.0, "mean_word_length": 0.2, "symbol_ratio": 0.02, "digit_ratio": 0.02, "punctuated_lines": 0.25, "common_words": 0.05,
    "formed_share": 0.1, "log_line_length": 2.0, "log_distinct": 0.2, "letter_ratio": 0.03,
}
STATISTICS = tuple(RESOLUTION)
_K = len(STATISTICS)
_FINE = np.diag(np.square(list(RESOLUTION.values())))
#: Share of a language's documents that tell what prose looks like, how often they are chosen anew, and
#: the number of documents of all languages that a language's own are mixed with.
CORE, STEPS, PRIOR = 0.6, 3, 50
#: Least squared distance of an outlier: 99.9 % of normal rows of so many statistics lie below.
OUTLYING = 29.59
#: Distances are sorted into this many bins, each twelfth of a doubling wide, from 2 ** -10 on.
_BINS, _PER_DOUBLING, _FROM = 480, 12, -10

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Lines that are no running prose, by their form: a line that begins a list entry, a row or rule of a table, mark-up,
#: separated values, menus, log lines, encoded data, code.
_FORMED = re.compile(
    r"""^(?:
      [ \t]*(?:[-*•–—+‣◦▪·]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])[ \t]+\S
    | [ \t]*\|.*\|[ \t]*$ | [^|\n]*\|[^|\n]*\| | [ \t]*[-=_*+|:][-=_*+|: \t]{2,}$
    | [^<\n]*</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>\n]*)?/?>
    | [ \t]*[\w.\-]+[ \t]*(?:[,;|][ \t]*[\w.\-]*){3,}[ \t]*$
    | [^\w\s]?[ \t]*[\w'’-]+[ \t]*[·»|›/] | [^»\n]*»[ \t]*$
    | [ \t]*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d | [ \t]*\d\d:\d\d:\d\d
    | [ \t]*[A-Fa-f0-9]{24,}[ \t]*$ | [ \t]*[A-Za-z0-9+/=_-]{40,}[ \t]*$ | [ \t]*(?:0x)?[0-9a-fA-F]{4,}[: \t]+(?:[0-9a-fA-F]{2,}[ \t]+){3}
    | [ \t]*(?:\}|\)|\]|//|/\*|\#!|\#include|@\w)
    )[^\n]*""",
    re.X | re.M,
)
#: Lines that end a sentence, quotes and brackets after the mark aside.
_PUNCTUATED = re.compile(r"[.!?…][\"'”»)\]*_`]*[ \t]*$", re.M)
_LINE = re.compile(r"^.*\S", re.M)


def _solid(text: str) -> int:
    return len("".join(text.split()))


def measure(text: str, common: frozenset) -> list[float]:
    """The statistics of one text that is not blank, in the order of ``STATISTICS``."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    words = _WORD.findall(text.lower())
    solid = max(_solid(text), 1)
    lines = max(len(_LINE.findall(text)), 1)
    letters = sum(map(len, words))
    digits = sum(map(text.count, "0123456789"))
    n = max(len(words), 1)
    return [
        np.log1p(len(words)),
        letters / n,
        max(0, solid - letters - digits) / solid,
        digits / solid,
        len(_PUNCTUATED.findall(text)) / lines,
        sum(map(common.__contains__, words)) / n,
        sum(map(_solid, _FORMED.findall(text))) / solid,
        np.log1p(solid / lines),
        np.log1p(len(set(words))) / np.log1p(n),
        letters / solid,
    ]


def _commons(common_words: DataFrame) -> dict[str, frozenset]:
    """Common words by language; a fixed small table, read at most 10,000 rows per language."""
    rows = columns(common_words, "lang", "word").where("lang IS NOT NULL AND word IS NOT NULL").selectExpr("lower(trim(lang)) AS lang", "lower(trim(word)) AS word").distinct()
    if rows.count() > 100_000:
        raise ValueError("common_words is no short list of frequent words")
    out: dict[str, set] = {}
    for r in rows.collect():
        out.setdefault(r.lang, set()).add(r.word)
    return {k: frozenset(v) for k, v in out.items()}


def statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id bigint, lang string, stats array<double>) of each document with a text.

    ``lang`` is the language most of whose common words the text uses, that of its column on a tie.
    A document counts once, by its latest ``updated_at``; null, empty and blank texts and rows without
    an id give no row.
    """
    commons = _commons(common_words)
    everything = frozenset().union(*commons.values())
    languages = sorted(commons)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, stats, stamps = [], [], [], []
            for key, text, lang, stamp in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not text.strip():
                    continue
                words = set(_WORD.findall(text.lower()))
                named = (lang or "").strip().lower()
                hits = {x: len(words & commons[x]) for x in languages}
                best = max(languages, key=lambda x: (hits[x], x == named), default="")
                ids.append(key)
                langs.append(best if hits.get(best) else (named if named in commons else "en"))
                stats.append(measure(text, everything))
                stamps.append(stamp)
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(stats, pa.list_(pa.float64())), pa.array(stamps, pa.timestamp("us"))],
                ["doc_id", "lang", "stats", "updated_at"],
            )

    docs = columns(documents, "doc_id", "text", "lang", "updated_at").where("doc_id IS NOT NULL AND text IS NOT NULL")
    docs = docs.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    found = docs.mapInArrow(run, "doc_id bigint, lang string, stats array<double>, updated_at timestamp_ntz")
    return latest(found, ["doc_id"], "updated_at").select("doc_id", "lang", "stats")


def _distances(x: np.ndarray, langs: np.ndarray, models: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance of each row, and what each statistic adds to it (they sum to the distance)."""
    parts = np.zeros_like(x)
    for lang in set(langs):
        mean, inverse = models[lang]
        own = langs == lang
        off = x[own] - mean
        parts[own] = off * (off @ inverse)
    return parts.sum(axis=1), parts


def _bins(distances: np.ndarray) -> np.ndarray:
    place = (np.log2(np.maximum(distances, 2.0**_FROM)) - _FROM) * _PER_DOUBLING
    return np.minimum(place.astype(int), _BINS - 1)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.array(batch["lang"].to_pylist(), object), np.array(batch["stats"].flatten()).reshape(-1, _K)


def _sums(stats: DataFrame, models: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """For each language and bin of distances: number, sums and products of its documents' statistics.

    One pass over all documents. A task sends the sums of the bins it meets, whatever the number of
    its documents; what reaches the driver is bounded by languages and bins.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            langs, x = _rows(batch)
            at = _bins(_distances(x, langs, models)[0])
            full = np.hstack([np.ones((len(x), 1)), x])
            for lang in set(langs):
                own = langs == lang
                for b in np.unique(at[own]):
                    part = full[own & (at == b)]
                    sums[lang, int(b)] = sums.get((lang, int(b)), 0) + part.T @ part
        keys = list(sums)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].reshape(-1) for k in keys], pa.list_(pa.float64()))], ["lang", "bin", "sums"])

    held = stats.select("lang", "stats").mapInArrow(run, "lang string, bin int, sums array<double>")
    cells = held.select("lang", "bin", F.posexplode("sums").alias("cell", "value")).groupBy("lang", "bin", "cell").agg(F.sum("value").alias("value"))
    rows = cells.groupBy("lang", "bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "value"))), lambda c: c["value"]).alias("sums")).collect()
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.lang, np.zeros((_BINS, _K + 1, _K + 1)))[r.bin] = np.array(r.sums).reshape(_K + 1, _K + 1)
    return out


def _model(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(sums[0, 0], 1.0)
    mean = sums[0, 1:] / n
    return mean, np.linalg.inv(sums[1:, 1:] / n - np.outer(mean, mean) + _FINE)


def _core(bins: np.ndarray) -> np.ndarray:
    """The sums over the nearest bins that hold the share ``CORE`` of a language's documents."""
    number = np.cumsum(bins[:, 0, 0])
    return bins[: int(np.searchsorted(number, CORE * number[-1])) + 1].sum(axis=0)


def fitted(stats: DataFrame) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], float]:
    """Mean and inverse covariance of prose by language, and the squared distance from which a document is an outlier.

    Begins at each language's medians. A language's own sums are mixed with ``PRIOR`` documents of all
    languages, so that one with a few documents is described too. The limit is where all documents'
    logarithmic distances part best in two (least variance within), but at least ``OUTLYING``.
    """
    middle = stats.groupBy("lang").agg(F.array(*[F.percentile_approx(F.col("stats")[k], 0.5, 1000) for k in range(_K)]).alias("m")).collect()
    if not middle:
        return {}, OUTLYING
    models = {r.lang: (np.array(r.m), np.linalg.inv(_FINE)) for r in middle}
    for _ in range(STEPS):
        sums = {lang: _core(bins) for lang, bins in _sums(stats, models).items()}
        total = sum(sums.values())
        models = {lang: _model(s + total * (PRIOR / total[0, 0])) for lang, s in sums.items()}
    number = sum(bins[:, 0, 0] for bins in _sums(stats, models).values())
    below, place = np.cumsum(number), np.cumsum(number * np.arange(_BINS))
    above = below[-1] - below
    inside = (below > 0) & (above > 0)
    between = np.zeros(_BINS)
    between[inside] = (place[-1] * below[inside] - place[inside] * below[-1]) ** 2 / (below[inside] * above[inside])
    return models, max(OUTLYING, 2.0 ** (_FROM + (int(between.argmax()) + 1) / _PER_DOUBLING))


def outlierness(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id bigint, lang string, each statistic double, distance double, outlier boolean, contributions array<double>).

    ``distance`` is the squared Mahalanobis distance from prose of the document's language, and
    ``outlier`` whether it reaches the limit; ``contributions`` are the statistics' shares in it, in
    the order of ``STATISTICS``.
    """
    stats = materialize(statistics(documents, common_words), "stats")
    models, limit = fitted(stats)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, x = _rows(batch)
            d, parts = _distances(x, langs, models)
            yield pa.record_batch(
                [batch["doc_id"], batch["lang"], batch["stats"], pa.array(d), pa.array(d >= limit), pa.array(list(parts), pa.list_(pa.float64()))],
                ["doc_id", "lang", "stats", "distance", "outlier", "contributions"],
            )

    out = stats.mapInArrow(run, "doc_id bigint, lang string, stats array<double>, distance double, outlier boolean, contributions array<double>")
    return out.select("doc_id", "lang", *[F.col("stats")[i].alias(s) for i, s in enumerate(STATISTICS)], "distance", "outlier", "contributions")


def found(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id bigint): the outliers, documents that are far from running prose of their language."""
    return outlierness(documents, common_words).where("outlier").select("doc_id")
