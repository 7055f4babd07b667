"""Documents that hold passages of held-out items, word for word or edited.

An item is cut into windows: at every word one of ``WIDTH`` words, the shortest passage, and windows
of the item's own size class, ``WIDTH`` doubled as often as the item allows. Every window of every
document is compared with all of them without pairing: its fingerprint is the SimHash of its words,
the fingerprint is cut into ``radius + 1`` blocks, and two fingerprints that differ in at most
``radius`` bits agree in at least one block, so looking each block up finds every window within the
radius. A candidate is then verified by the exact weighted-shingle similarity of both windows.

Items are taken in blocks of at most ``words`` words; the index of a block is sent to all workers and
every document meets it. More items mean more passes, never another plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from declarium.sources import columns

#: Longest runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Successive words that make a passage.
WIDTH = 12
#: Bits in which fingerprints may differ: windows of a passage; windows of an item's size, edited.
RADIUS, EDITED = 1, 4
#: Least weighted share of common shingles of an edited window; words of a shingle.
ALIKE, SHINGLE = 0.6, 2
#: Words of a block of items, about 100 bytes each in its index.
WORDS = 1_000_000
_STEP = 1 << 15


class _Hashes(dict):
    """64-bit hash of a word in lower case; bounded, as a worker lives long."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.lower().encode())
        return value


_HASHES = _Hashes()


def word_hashes(text: str | None) -> list[int]:
    return [_HASHES[w] for w in WORD.findall(text)] if text else []


def fingerprints(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """SimHash of every window of ``width`` words: bit b is set if most words' hashes have it.

    Every word weighs the same; sums over windows are differences of running sums.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, _STEP):
        part = hashes[lo : lo + _STEP + width - 1]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.zeros((len(part) + 1, 64), np.uint16)  # differences stay right when the sums wrap around
        np.cumsum(bits, axis=0, dtype=np.uint16, out=sums[1:])
        most = (sums[width:] - sums[:-width]) > width // 2
        packed = np.packbits(most, axis=1)
        out[lo : lo + _STEP] = packed.view(np.uint64).reshape(-1)
    return out


def _blocks(prints: np.ndarray, radius: int) -> list[np.ndarray]:
    edges = np.linspace(0, 64, radius + 2).astype(int)
    return [(prints >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def size_class(n: int, width: int = WIDTH) -> int:
    """The item's window size: ``width`` doubled while two windows of it, half overlapping, fit in ``n`` words."""
    size = width
    while size * 2 <= n:
        size *= 2
    return size


class Index:
    """Windows of ``width`` words of some items, found by blocks of their fingerprints.

    ``step`` words lie between the windows of an item; its last words are always in one. Documents
    are read at every word, so a step loses no alignment.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], width: int = WIDTH, radius: int = RADIUS, step: int = 1):
        self.width, self.radius = width, radius
        owner, hashes, prints = [], [], []
        for item, h in items:
            n = len(h) - width + 1
            if n > 0:
                at = np.unique(np.append(np.arange(0, n, step), n - 1))
                hashes.append(np.lib.stride_tricks.sliding_window_view(h, width)[at])
                prints.append(fingerprints(h, width)[at])
                owner += [item] * len(at)
        self.owner = np.array(owner, np.int64)
        self.words = np.concatenate(hashes) if hashes else np.empty((0, width), np.uint64)
        self.prints = np.concatenate(prints) if prints else np.empty(0, np.uint64)
        self.blocks = []
        for b in _blocks(self.prints, radius):
            order = np.argsort(b, kind="stable")
            filt = np.zeros(1 << 20, bool)
            filt[b & np.uint64((1 << 20) - 1)] = True
            self.blocks.append((b[order], order, filt))
        # a shingle weighs the less the more items hold it
        held = [np.unique(_shingles(h)) for _, h in items if len(h) >= SHINGLE]
        self.known, number = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
        self.weights = 1.0 / number

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item window) of all pairs within the radius."""
        mine, theirs = [], []
        for b, (values, order, filt) in zip(_blocks(prints, self.radius), self.blocks, strict=True):
            at = np.flatnonzero(filt[b & np.uint64((1 << 20) - 1)])
            for lo in range(0, len(at), _STEP):
                some = at[lo : lo + _STEP]
                first, last = np.searchsorted(values, b[some]), np.searchsorted(values, b[some], "right")
                n = last - first
                m = np.repeat(some, n)
                t = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                near = np.bitwise_count(prints[m] ^ self.prints[t]) <= self.radius
                mine.append(m[near])
                theirs.append(t[near])
        none = np.empty(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(mine or [none]), np.concatenate(theirs or [none])]), axis=1)
        return pairs[0], pairs[1]

    def weigh(self, shingles: np.ndarray) -> np.ndarray:
        """Weights of shingles; one that no item holds weighs as one that one item holds."""
        if not len(self.known):
            return np.ones(shingles.shape)
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[at] == shingles, self.weights[at], 1.0)

    def similarity(self, hashes: np.ndarray, m: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Weight of the shingles in both windows over that of the shingles in either; 1 for windows equal word for word, and only for them."""
        out = np.empty(len(m))
        n = self.width - SHINGLE + 1
        if not len(m):
            return out
        mine = np.lib.stride_tricks.sliding_window_view(_shingles(hashes), n)
        windows = np.lib.stride_tricks.sliding_window_view(hashes, self.width)
        column = np.arange(n, dtype=np.uint64)
        for lo in range(0, len(m), 1 << 12):
            sides, weights = [], []
            theirs = _shingles(self.words[t[lo : lo + (1 << 12)]].T).T
            for k, side in enumerate((mine[m[lo : lo + (1 << 12)]], theirs)):
                rows = np.sort(side, axis=1)
                again = np.zeros(rows.shape, bool)
                again[:, 1:] = rows[:, 1:] == rows[:, :-1]
                w = np.where(again, 0.0, self.weigh(rows))
                # a repeated shingle counts once: the others become values that nothing else has
                sides.append(np.where(again, column + np.uint64(k * n), rows))
                weights.append(w)
            values, w = np.hstack(sides), np.hstack(weights)
            order = np.argsort(values, axis=1, kind="stable")
            values, w = np.take_along_axis(values, order, 1), np.take_along_axis(w, order, 1)
            common = np.where(values[:, 1:] == values[:, :-1], w[:, 1:], 0.0).sum(axis=1)
            alike = common / np.maximum(w.sum(axis=1) - common, 1e-9)
            # the same shingles may stand in another succession
            equal = (windows[m[lo : lo + (1 << 12)]] == self.words[t[lo : lo + (1 << 12)]]).all(axis=1)
            out[lo : lo + (1 << 12)] = np.where(equal, 1.0, np.minimum(alike, 1 - 1e-9))
        return out


def _shingles(hashes: np.ndarray) -> np.ndarray:
    out = hashes[: len(hashes) - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - SHINGLE + 1 + k]
    return out


def _item_blocks(items: DataFrame, words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items' words, in blocks; one block is on the driver at a time."""
    held = columns(items, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    block: list[tuple[int, np.ndarray]] = []
    n = 0
    for r in held.toLocalIterator():
        h = np.array(word_hashes(r.text), np.uint64)
        block.append((r.item_id, h))
        n += len(h)
        if n >= words:
            yield block
            block, n = [], 0
    if block:
        yield block


def _met(documents: DataFrame, indexes: list[Index], least: float) -> DataFrame:
    """(doc_id, item_id, similarity): documents' windows within the radius of an index and at least ``least`` alike, the best of each pair in a document."""
    docs = columns(documents, "doc_id", "text", "updated_at").where("doc_id IS NOT NULL").withColumn("updated_at", F.coalesce(F.col("updated_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")))
    sent = documents.sparkSession.sparkContext.broadcast(indexes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = [word_hashes(t) for t in part.column(1).to_pylist()]
                sizes = [len(x) for x in lists]
                hashes = np.array([h for x in lists for h in x], np.uint64)
                row = np.repeat(np.arange(len(sizes)), sizes)
                best: dict[tuple[int, int], float] = {}
                for own in sent.value:
                    m, t = own.candidates(fingerprints(hashes, own.width))
                    inside = row[m] == row[m + own.width - 1] if len(m) else m.astype(bool)
                    m, t = m[inside], t[inside]
                    for k, item, alike in zip(row[m].tolist(), own.owner[t].tolist(), own.similarity(hashes, m, t).tolist(), strict=True):
                        if alike >= least and alike > best.get((k, item), 0):
                            best[k, item] = alike
                # each delivery gives a row without an item, which tells that there was one
                at = pa.array([*range(len(sizes)), *(k for k, _ in best)], pa.int64())
                items = pa.array([*[None] * len(sizes), *(i for _, i in best)], pa.int64())
                alike = pa.array([*[None] * len(sizes), *best.values()], pa.float64())
                yield pa.record_batch([part.column(0).take(at), part.column(2).take(at), items, alike], ["doc_id", "stamp", "item_id", "similarity"])

    found = docs.mapInArrow(run, "doc_id bigint, stamp timestamp_ntz, item_id bigint, similarity double")
    last = F.max("stamp").over(Window.partitionBy("doc_id"))
    return found.withColumn("last", last).where("stamp = last AND item_id IS NOT NULL").select("doc_id", "item_id", "similarity")


def _united(parts: list[DataFrame], documents: DataFrame) -> DataFrame:
    out = documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, similarity double")
    for p in parts:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def leaks(documents: DataFrame, items: DataFrame, width: int = WIDTH, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """(doc_id bigint, item_id bigint): the document holds ``width`` successive words of the item.

    Each pair comes out once; a document counts by its latest ``updated_at``. Null texts, texts under ``width`` words and rows without an id give
    nothing. Of the windows within the radius those that are equal word for word count; equal windows
    have equal fingerprints, so this form has every such passage whatever the radius.
    """
    parts = [_met(documents, [Index(block, width, radius)], 1.0) for block in _item_blocks(items, words)]
    return _united(parts, documents).select("doc_id", "item_id")


def passages(documents: DataFrame, items: DataFrame, width: int = WIDTH, radius: int = EDITED, least: float = ALIKE, words: int = WORDS) -> DataFrame:
    """(doc_id bigint, item_id bigint, similarity double): the document holds a passage of the item, edited or not.

    Windows have the item's size class, so that a changed word moves few bits of a fingerprint; those
    within ``radius`` bits count if their weighted shingles are at least ``least`` alike. Passages of
    ``width`` words that are equal word for word count too, with similarity 1. An edited passage whose
    fingerprint moved further than the radius is missed: the README gives the recall by edits.
    """
    parts = []
    for block in _item_blocks(items, words):
        sized: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, h in block:
            if len(h) >= 2 * width:
                sized.setdefault(size_class(len(h), width), []).append((item, h))
        edited = [Index(held, size, radius, size // 4) for size, held in sorted(sized.items())]
        parts += [_met(documents, edited, least), _met(documents, [Index(block, width, RADIUS)], 1.0)]
    return _united(parts, documents)


FOUND_SQL = r"""WITH l AS (SELECT doc_id, text, rank() OVER (PARTITION BY doc_id ORDER BY updated_at DESC NULLS LAST) AS r FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM l WHERE r = 1 AND text IS NOT NULL),
e AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
places AS (SELECT unnest(generate_series(1, 20000)) AS i),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 11], ' ') AS p FROM d, places WHERE i <= len(w) - 11),
ew AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS p FROM e, places WHERE i <= len(w) - 11)
SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (p)"""
