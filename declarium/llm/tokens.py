"""Encoding of whole texts by a public byte-level vocabulary through a compiled word lexicon.

A byte-level vocabulary encodes a text word by word (a pattern splits it), so a word's ids never
depend on its neighbours. The frequent words of the corpus, counted over all of it, are compiled
with their ids into a minimal acyclic transducer: one automaton whose equal suffixes are shared,
each of whose transitions carries the number of words that sort before it, so that the sum along a
word's path is the word's place in the table of ids. It is written once, to the folder all
executors share, and memory-mapped by each worker. A batch's new words walk the automaton together,
one byte per step. A word that it does not hold is merged exactly by the vocabulary's ranks.
"""

from __future__ import annotations

import base64
import os
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.sources import checkpoint_dir, columns, latest

#: Place of the public vocabulary files; a parameter of every operator below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split of texts in ASCII without separator controls, by the faster engine.
_PLAIN = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s0-9A-Za-z]+|\s+(?!\S)|\s+")
_CONTROLS = re.compile("[\x1c-\x1f]")
#: Words in the lexicon at most, by falling count; others are merged, so the bound changes no result.
LEXICON_WORDS = 65_536
#: Longest word, in bytes, that the lexicon takes.
LEXICON_BYTES = 48

_WORKER: dict[str, object] = {}


def splitter() -> Callable[[str], list[str]]:
    """Cuts a text into the vocabulary's words."""
    full, plain, controls = regex.compile(PATTERN).findall, _PLAIN.findall, _CONTROLS.search

    def split(text: str) -> list[str]:
        return plain(text) if text.isascii() and not controls(text) else full(text)

    return split


def vocabulary(path: str) -> tiktoken.Encoding:
    """The vocabulary of a rank file, once per process; its special strings stay ordinary text."""
    if path not in _WORKER:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _WORKER[path] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _WORKER[path]


@dataclass
class Lexicon:
    """A minimal acyclic transducer over byte strings, as flat arrays.

    ``keys`` holds ``state * 256 + byte`` in rising order; ``targets`` and ``before`` are the next
    state and the number of words that sort before that branch; ``final`` tells states that end a
    word. The ids of word ``i`` are ``ids[starts[i]:starts[i + 1]]``.
    """

    keys: np.ndarray
    targets: np.ndarray
    before: np.ndarray
    final: np.ndarray
    starts: np.ndarray
    ids: np.ndarray

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        """Incremental construction over sorted words: a finished branch is replaced by its equal."""
        words = sorted(w for w in entries if w)
        register: dict[tuple, int] = {}
        done: list[tuple] = []

        def freeze(node: list) -> int:
            signature = (node[0], tuple(node[1]))
            at = register.get(signature)
            if at is None:
                at = register[signature] = len(done)
                done.append(signature)
            return at

        path: list[list] = [[False, []]]
        previous = b""
        for w in words:
            common = os.path.commonprefix([previous, w])
            while len(path) > len(common) + 1:
                node = path.pop()
                path[-1][1].append((previous[len(path) - 1], freeze(node)))
            path.extend([False, []] for _ in w[len(common) :])
            path[-1][0] = True
            previous = w
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((previous[len(path) - 1], freeze(node)))
        root = freeze(path[0])
        below = [0] * len(done)
        for i, (final, edges) in enumerate(done):  # children are frozen before their parents
            below[i] = int(final) + sum(below[t] for _, t in edges)
        # the root becomes state 0
        place = {root: 0}
        for i in range(len(done)):
            place.setdefault(i, len(place))
        rows = []
        final = np.zeros(len(done), np.uint8)
        for i, (ends, edges) in enumerate(done):
            final[place[i]] = ends
            sofar = int(ends)
            for byte, t in edges:
                rows.append((place[i] * 256 + byte, place[t], sofar))
                sofar += below[t]
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        lists = [entries[w] for w in words]
        return cls(
            table[:, 0].copy(),
            table[:, 1].astype(np.int32),
            table[:, 2].astype(np.int32),
            final,
            np.cumsum([0, *map(len, lists)]).astype(np.int32),
            np.array([i for x in lists for i in x], np.int32),
        )

    def find(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the lexicon, or -1; all words take each step together."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        offsets = np.cumsum(lengths) - lengths
        live = np.flatnonzero((lengths > 0) & (lengths <= LEXICON_BYTES))
        state, rank = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            over = live[lengths[live] == step]
            over = over[self.final[state[over]] == 1]
            out[over] = rank[over]
            live = live[lengths[live] > step]
            key = state[live] * 256 + flat[offsets[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            rank[live] += self.before[at]
            state[live] = self.targets[at]
            step += 1
        return out

    def to_bytes(self) -> bytes:
        """Six arrays behind a header of their lengths, each on a multiple of 8 bytes."""
        parts = [self.keys, self.targets, self.before, self.final, self.starts, self.ids]
        blob = np.array([len(p) for p in parts], np.int64).tobytes()
        for p in parts:
            blob += p.tobytes() + b"\0" * (-p.nbytes % 8)
        return blob

    @classmethod
    def over(cls, memory: np.ndarray) -> Lexicon:
        """The lexicon over mapped bytes, without a copy."""
        lengths = memory[:48].view(np.int64)
        at, out = 48, []
        for n, kind in zip(lengths, (np.int64, np.int32, np.int32, np.uint8, np.int32, np.int32), strict=True):
            size = int(n) * np.dtype(kind).itemsize
            out.append(memory[at : at + size].view(kind))
            at += size + -size % 8
        return cls(*out)


def _mapped(path: str) -> Lexicon:
    if path not in _WORKER:
        _WORKER[path] = Lexicon.over(np.memmap(path, np.uint8, "r"))
    return _WORKER[path]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n bigint) of every word of column ``text``, over all rows.

    Each partition counts its own words first, so what is shuffled grows with the number of
    different words, and a word that a third of all rows hold is one row per partition.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(split(text))
            if len(seen) > 500_000:
                yield _counted(seen)
                seen.clear()
        yield _counted(seen)

    parts = columns(texts, "text").mapInArrow(count, "word binary, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter[str]) -> pa.RecordBatch:
    kept = {b: n for w, n in seen.items() if len(b := w.encode()) <= LEXICON_BYTES}
    return pa.record_batch([pa.array(kept.keys(), pa.binary()), pa.array(kept.values(), pa.int64())], ["word", "n"])


def compile_lexicon(texts: DataFrame, vocabulary_path: str = VOCABULARY, words: int = LEXICON_WORDS) -> str:
    """Counts the corpus' words, compiles the most frequent, has it shipped to the workers, and returns its name.

    At most ``words`` words reach the driver, whatever the corpus' size.
    """
    spark = texts.sparkSession
    frequent = word_counts(texts).where("n > 1").orderBy(F.desc("n"), "word").limit(words).collect()
    vocab = vocabulary(vocabulary_path)
    blob = Lexicon.build({bytes(r.word): vocab._encode_single_piece(bytes(r.word)) for r in frequent}).to_bytes()
    return _publish(spark, blob)


def _publish(spark, blob: bytes) -> str:
    """Writes ``blob`` to the shared folder, whatever file system that is on, and has Spark ship it to every worker; gives its name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = system.create(target)
    try:
        stream.write(bytearray(blob))
    finally:
        stream.close()
    spark.sparkContext.addFile(system.makeQualified(target).toString())
    return name


def encode(
    documents: DataFrame,
    vocabulary_path: str = VOCABULARY,
    words: int = LEXICON_WORDS,
) -> DataFrame:
    """(doc_id bigint, ids array<int>): the ids of each document's whole text, without special tokens.

    Empty and null texts give an empty list. A document that is delivered more than once comes out
    once, with its latest ``updated_at`` (the greatest text among ties); rows without ``doc_id``
    are left out. Strings that look like special tokens are ordinary text.
    """
    docs = latest(columns(documents, "doc_id", "text", "updated_at"), ["doc_id"], "updated_at").select("doc_id", "text")
    name = compile_lexicon(documents, vocabulary_path, words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _mapped(SparkFiles.get(name))
        piece = vocabulary(vocabulary_path)._encode_single_piece
        split = splitter()
        known: dict[str, list[int]] = _WORKER.setdefault("known" + name, {})
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), 512):
                pieces = [split(t) if t else [] for t in texts[lo : lo + 512]]
                if len(known) > 400_000:  # a bound on the worker's memory; words are found again
                    known.clear()
                new = list({w for p in pieces for w in p} - known.keys())
                raw = [w.encode() for w in new]
                starts, ids = lexicon.starts, lexicon.ids
                for w, b, i in zip(new, raw, lexicon.find(raw).tolist(), strict=True):
                    known[w] = ids[starts[i] : starts[i + 1]].tolist() if i >= 0 else piece(b)
                get = known.__getitem__
                values: list[int] = []
                ends = [0]
                for p in pieces:
                    values.extend(chain.from_iterable(map(get, p)))
                    ends.append(len(values))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                yield pa.record_batch([batch.column(0).slice(lo, 512), lists], ["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id bigint, ids array<int>")
