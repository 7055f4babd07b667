"""Groups of declarations whose bodies are alike up to small edits: an exact set-similarity self-join.

A body is the set of its sequences of ``SHINGLE`` successive words; bodies with equal sets are one
class, and only classes are compared. The join uses the relations between sets at two levels.

*Index lists are skipped in blocks.* Under one global order, rarest shingle first, two sets that are
alike share a shingle within their prefixes. Each shingle's list is kept in the order of set sizes
and cut into blocks that know their sizes and positions; a pair of blocks that cannot hold a similar
pair is never formed. A block pair is one unit of work, so a shingle that a third of all bodies hold
is many units in many tasks.

*Answers are derived.* Sets with equal prefixes form a group whose first member alone is listed and
probed. Its overlap with another group's first member is computed once; that of any two members
follows from it by the few shingles in which each differs from its group's first member.

The order needs the number of sets that hold each shingle. Sets are not taken apart into rows for
that: a task packs them into chunks, sends each chunk's distinct shingles to their ranges as packed
gaps with a number beside each, and gets back the totals in the same order. A shingle that many sets
hold is one number a chunk. One plan serves every size; nothing is sent to all workers.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declarium.sources import columns, materialize

WORD = re.compile(r"[A-Za-z0-9_]+")
#: Successive words of a shingle; fewest words of a body that counts; least share of common shingles.
SHINGLE, LEAST_WORDS, SIMILAR = 3, 30, 0.5
#: Sets in a block of a shingle's list; members in a block of a group; copies in a block of a class.
BLOCK, MEMBERS, COPIES = 1024, 512, 4096
#: Shingles in a chunk; bits of a shingle's hash.
CHUNK, BITS = 1 << 20, 46

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.lower())
        return value


_HASHES = _Hashes()


def _mixed(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of ``BITS`` bits of each sequence of ``n`` successive words."""
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = (out * _M1) ^ (out >> np.uint64(29))
        out += words[k : len(words) - n + 1 + k] * _M2
    out ^= out >> np.uint64(33)
    out *= _M3
    return (out ^ (out >> np.uint64(32))) >> np.uint64(64 - BITS)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 as bytes of seven bits each, the last of a number below 128."""
    n = numbers.astype(np.uint64)
    size = np.ones(len(n), np.int64)
    for k in range(1, 10):
        size += n >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(n) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[ends[has] - size[has] + k] = ((n[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The numbers of ``packed``."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], raw[:-1] < 128]))
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def _gaps(values: np.ndarray) -> bytes:
    """Rising numbers as the packed differences of neighbours."""
    return packed(np.diff(values, prepend=np.uint64(0)))


def _rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


#: A range's part of a chunk (``values``, ``numbers``), or a chunk's own account, which has no values.
_PART = "range int, chunk bigint, values binary, numbers binary, decls binary, classes binary, stamps binary, sets binary, sizes binary, owners binary"
_PARTS = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), *[(n.split()[0], pa.binary()) for n in _PART.split(", ")[2:]]])


class _Chunk:
    """Bodies of one task until their sets hold ``CHUNK`` shingles."""

    def __init__(self, number: int, ranges: int):
        self.number, self.ranges = number, ranges
        self.decls: list[int] = []
        self.classes: list[int] = []
        self.stamps: list[int] = []
        self.sets: list[np.ndarray] = []
        self.names: list[int] = []
        self.held = 0

    def rows(self) -> pa.RecordBatch:
        every = np.concatenate(self.sets) if self.sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(self.sets), dtype=np.uint32), [len(s) for s in self.sets])
        order = np.argsort(every, kind="stable")
        values, numbers = np.unique(every, return_counts=True)
        small = np.uint16 if len(self.sets) <= 1 << 16 else np.uint32
        shift = np.uint64(BITS - (self.ranges.bit_length() - 1))
        edges = np.searchsorted(values >> shift, np.arange(self.ranges + 1, dtype=np.uint64))
        rows = [
            (r, self.number, _gaps(values[a:b] - (np.uint64(r) << shift)), packed(numbers[a:b]), None, None, None, None, None, None)
            for r, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            if b > a
        ]
        arrays = (np.array(self.decls, np.int64), np.array(self.classes, np.int64), np.array(self.stamps, np.int64), np.array(self.names, np.int64), np.array([len(s) for s in self.sets], np.int32), owner[order].astype(small))
        rows.append((self.number % self.ranges, self.number, None, packed(numbers), *[a.tobytes() for a in arrays]))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARTS, strict=True)], schema=_PARTS)


def _chunks(decls: DataFrame, ranges: int, shingle: int, least_words: int, chunk: int) -> DataFrame:
    """Every delivered body packed into chunks: the parts of each range, and each chunk's own account.

    A body that does not count has no class. A task gives a set with the first body that has it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        get = _HASHES.__getitem__
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        part = _Chunk(number, ranges)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                few = batch.slice(lo, 512)
                for key, text, stamp in zip(*(few.column(i).to_pylist() for i in range(3)), strict=True):
                    found = WORD.findall(text) if text else ()
                    part.decls.append(key)
                    part.stamps.append(stamp)
                    if len(found) < max(least_words, shingle):
                        part.classes.append(_NONE)
                        continue
                    own = np.unique(_mixed(np.fromiter(map(get, found), np.uint64, len(found)), shingle))
                    cls = max(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63), _NONE + 1)
                    part.classes.append(cls)
                    if cls not in seen:
                        seen.add(cls)
                        part.sets.append(own)
                        part.names.append(cls)
                        part.held += len(own)
                    if part.held >= chunk or len(part.decls) >= chunk:
                        yield part.rows()
                        number += 1
                        part = _Chunk(number, ranges)
            if len(seen) > 2_000_000:
                seen.clear()
        if part.decls:
            yield part.rows()

    stamp = F.coalesce(F.unix_micros(F.col("extracted_at").cast("timestamp")), F.lit(-(1 << 62)))
    bodies = columns(decls, "decl_id", "body_text", "extracted_at").where("decl_id IS NOT NULL").select("decl_id", "body_text", stamp.alias("stamp"))
    return bodies.mapInArrow(run, _PART)


#: Class of a body that does not count.
_NONE = -(1 << 63)


def _totals(parts: pa.Table) -> pa.Table:
    """One range: the number of sets that hold each value, for each chunk in the order of its values.

    The values themselves go back where more than one set holds them. Accounts pass unchanged.
    """
    own = parts.filter(pc.is_null(parts["values"]))
    asked = parts.filter(pc.is_valid(parts["values"]))
    lists = [_rising(v.as_py()) for v in asked["values"]]
    numbers = [unpacked(n.as_py()) for n in asked["numbers"]]
    if not lists:
        return own
    known, place = np.unique(np.concatenate(lists), return_inverse=True)
    totals = np.bincount(place, weights=np.concatenate(numbers).astype(np.float64)).astype(np.uint64)
    answers, values, at = [], [], 0
    for mine in lists:
        total = totals[place[at : at + len(mine)]]
        at += len(mine)
        answers.append(packed(total - np.uint64(1)))
        values.append(_gaps(mine[total > 1]))
    out = {"range": asked["range"], "chunk": asked["chunk"], "values": pa.array(values, pa.binary()), "numbers": pa.array(answers, pa.binary())}
    rest = {f.name: pa.nulls(len(lists), pa.binary()) for f in _PARTS if f.name not in out}
    return pa.concat_tables([own, pa.table(out | rest, schema=_PARTS)])


_SETS = "decl_id bigint, stamp bigint, cls bigint, size int, own array<bigint>, prefix int"


def _assembled(shift: int, similar: float):
    """One chunk with all its answers: its bodies' classes, and the sets whose prefix is not empty."""

    def run(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("range")
        account = parts.filter(pc.is_valid(parts["decls"])).to_pylist()[0]
        asked = parts.filter(pc.is_null(parts["decls"])).to_pylist()
        decls, classes, stamps, names = (np.frombuffer(account[k], np.int64) for k in ("decls", "classes", "stamps", "sets"))
        sizes = np.frombuffer(account["sizes"], np.int32).astype(np.int64)
        n = len(decls)
        outs = {"decl_id": decls, "stamp": stamps, "cls": pa.array(classes, mask=classes == _NONE), "size": pa.nulls(n, pa.int32()), "own": pa.nulls(n, pa.list_(pa.int64())), "prefix": pa.nulls(n, pa.int32())}
        members = pa.table(outs)
        if not asked:
            return members
        owners = np.frombuffer(account["owners"], np.uint16 if len(names) <= 1 << 16 else np.uint32).astype(np.int64)
        numbers = unpacked(account["numbers"]).astype(np.int64)
        totals = np.concatenate([unpacked(p["numbers"]) for p in asked]).astype(np.int64)  # less one
        values = np.concatenate([_rising(p["values"]) + (np.uint64(p["range"]) << np.uint64(shift)) for p in asked]).astype(np.int64)
        shared = totals > 0
        each = np.repeat(shared, numbers)
        owner = owners[each]
        value, total = np.repeat(values, numbers[shared]), np.repeat(totals[shared], numbers[shared])
        order = np.lexsort((value, total, owner))
        held = np.bincount(owner, minlength=len(names))
        # shingles that only one set holds come first in the order and find nothing: only their number matters
        prefix = sizes - np.ceil(sizes * similar - 1e-9).astype(np.int64) + 1 - (sizes - held)
        kept = prefix > 0
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held[kept])]), pa.int32()), pa.array(value[order][kept[owner[order]]]))
        m = int(kept.sum())
        some = pa.table({"decl_id": pa.nulls(m, pa.int64()), "stamp": pa.nulls(m, pa.int64()), "cls": names[kept], "size": sizes[kept].astype(np.int32), "own": lists, "prefix": prefix[kept].astype(np.int32)})
        return pa.concat_tables([members, some])

    return run


def sets(decls: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE, least_words: int = LEAST_WORDS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(decl_id, cls bigint), and (cls bigint, size, prefix int, own array<bigint>) of the classes that can be alike to another.

    ``own`` holds the shingles that other sets have too, rarest first; the first ``prefix`` of them
    find every set that is alike. A declaration has the class of its latest delivery, and is left out
    if that does not count.
    """
    # about 65 shingles a body, at most four million to a range, and at least as many ranges as a small job has tasks
    ranges = 1 << min(18, max(5, (decls.select("decl_id").count() * 65 >> 22).bit_length()))
    parts = _chunks(decls, ranges, shingle, least_words, max(chunk, ranges * 32))
    answered = parts.groupBy("range").applyInArrow(_totals, _PART)
    shift = BITS - (ranges.bit_length() - 1)
    rows = materialize(answered.groupBy("chunk").applyInArrow(_assembled(shift, similar), _SETS), "sets")
    latest = rows.where("decl_id IS NOT NULL").groupBy("decl_id").agg(F.max(F.struct("stamp", "cls")).alias("r"))
    return latest.select("decl_id", F.col("r.cls").alias("cls")).where("cls IS NOT NULL"), rows.where("own IS NOT NULL").select("cls", "size", "prefix", "own")


def _enough(overlap: Column, size_a: Column, size_b: Column, similar: float) -> Column:
    """Jaccard similarity of at least ``similar``, from the overlap and both sizes."""
    return overlap * (1 + similar) >= (size_a + size_b) * similar - 1e-9


def _met(groups: DataFrame, similar: float, block: int) -> DataFrame:
    """(gx, gy): the pairs of groups that can hold a similar pair, by the blocks of their shingles' lists."""
    entries = groups.select("g", "lo", "hi", "held", F.posexplode("prefix").alias("i", "s"))
    entries = entries.select("s", "g", "lo", "hi", (F.col("held") - F.col("i")).alias("rest"))
    rank = F.row_number().over(Window.partitionBy("s").orderBy("lo", "g"))
    entries = materialize(entries.withColumn("b", F.floor((rank - 1) / block).cast("int")), "entries")
    blocks = entries.groupBy("s", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("rest").alias("rest"), F.count("*").alias("n"))
    x, y = blocks.alias("x"), blocks.alias("y")
    may = (F.col("y.lo") * similar <= F.col("x.hi")) & _enough(F.least("x.rest", "y.rest"), F.col("x.lo"), F.col("y.lo"), similar)
    units = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.b") <= F.col("y.b")) & may).where("x.b < y.b OR x.n > 1").select(F.col("x.s").alias("s"), F.col("x.b").alias("bx"), F.col("y.b").alias("by"))

    def side(of: str, tag: str) -> DataFrame:
        cols = [F.col(c).alias(f"{c}_{tag}") for c in ("g", "lo", "hi", "rest")]
        return entries.withColumnRenamed("b", of).join(units, ["s", of]).select("s", "bx", "by", *cols)

    met = side("bx", "x").join(side("by", "y"), ["s", "bx", "by"])
    met = met.where("(bx < by OR g_x < g_y) AND g_x <> g_y")
    met = met.where((F.col("lo_y") * similar <= F.col("hi_x")) & (F.col("lo_x") * similar <= F.col("hi_y")) & _enough(F.least("rest_x", "rest_y"), F.col("lo_x"), F.col("lo_y"), similar))
    return met.select(F.least("g_x", "g_y").alias("gx"), F.greatest("g_x", "g_y").alias("gy")).distinct()


def class_pairs(listed: DataFrame, similar: float = SIMILAR, block: int = BLOCK, members: int = MEMBERS) -> DataFrame:
    """(a, b bigint), a < b: the pairs of different classes that are alike, from the second of ``sets``."""
    listed = listed.groupBy("cls").agg(F.max(F.struct("size", "prefix", "own")).alias("r")).select("cls", "r.*")
    listed = listed.withColumn("g", F.xxhash64(F.slice("own", 1, F.col("prefix"))))
    listed = materialize(listed, "lists")
    groups = listed.groupBy("g").agg(F.min(F.struct("cls", "own", "prefix")).alias("h"), F.min("size").alias("lo"), F.max("size").alias("hi"), F.max(F.size("own")).alias("held"), F.count("*").alias("n"))
    groups = materialize(groups.select("g", F.col("h.own").alias("head"), F.slice("h.own", 1, F.col("h.prefix")).alias("prefix"), "lo", "hi", "held", "n"), "groups")

    met = _met(groups, similar, block).unionByName(groups.where("n > 1").select(F.col("g").alias("gx"), F.col("g").alias("gy")))
    # a group's members in blocks, each with the first member and what tells them from it
    split = F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / members))
    own = listed.select("g", "cls", "size", "own").join(groups.select("g", "head", "n"), "g")
    own = own.select("g", split.alias("k"), "head", F.struct("cls", "size", F.array_except("head", "own").alias("less"), F.array_except("own", "head").alias("more")).alias("m"))
    blocks = materialize(own.groupBy("g", "k").agg(F.min("head").alias("head"), F.min("m.size").alias("lo"), F.max("m.size").alias("hi"), F.collect_list("m").alias("ms")), "members")
    sizes = blocks.select("g", "k", "lo", "hi")
    sx, sy = (sizes.select(F.col("g").alias(f"g{t}"), F.col("k").alias(f"k{t}"), F.col("lo").alias(f"lo{t}"), F.col("hi").alias(f"hi{t}")) for t in "xy")
    units = met.join(sx, "gx").join(sy, "gy").where((F.col("hix") >= F.col("loy") * similar) & (F.col("hiy") >= F.col("lox") * similar)).where("gx < gy OR kx <= ky").select("gx", "kx", "gy", "ky")
    bx, by = (blocks.select(F.col("g").alias(f"g{t}"), F.col("k").alias(f"k{t}"), F.col("head").alias(f"h{t}"), F.col("ms").alias(f"ms{t}")) for t in "xy")
    first = units.join(bx, ["gx", "kx"]).join(by, ["gy", "ky"]).withColumn("o", F.size(F.array_intersect("hx", "hy")))
    pairs = first.withColumn("x", F.explode("msx")).drop("msx").withColumn("y", F.explode("msy")).drop("msy")
    pairs = pairs.where("gx < gy OR kx < ky OR x.cls < y.cls").where((F.col("x.size") >= F.col("y.size") * similar) & (F.col("y.size") >= F.col("x.size") * similar))

    def common(few: str, many: str) -> Column:
        return F.when(F.size(few) == 0, 0).otherwise(F.size(F.array_intersect(few, many)))

    # x = hx - x.less + x.more and y likewise, so the overlap follows from that of hx and hy
    with_head = common("y.more", "hx") - common("y.less", "hx") - common("y.more", "x.less") + common("y.less", "x.less") + common("y.more", "x.more") - common("y.less", "x.more")
    overlap = F.col("o") - common("x.less", "hy") + common("x.more", "hy") + with_head
    alike = pairs.where(_enough(overlap, F.col("x.size"), F.col("y.size"), similar))
    return alike.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))


def found(decls: DataFrame, similar: float = SIMILAR, block: int = BLOCK, copies: int = COPIES) -> DataFrame:
    """(decl_id_a bigint, decl_id_b bigint), a < b: every pair of declarations whose bodies are alike.

    A declaration counts once, by its latest delivery. Null bodies, bodies under ``LEAST_WORDS`` words
    and rows without an id are in no pair. Equal sets are alike. Copies of a body are met in blocks, so
    that no task has more than ``copies`` times ``copies`` pairs of one class.
    """
    member, listed = sets(decls, similar)
    member = materialize(member, "member")
    kinds = member.groupBy("cls").agg(F.ceil(F.count("*") / copies).cast("int").alias("k"), F.count("*").alias("n"))
    member = member.join(kinds, "cls").select("decl_id", "cls", F.pmod(F.xxhash64("decl_id"), F.col("k")).cast("int").alias("p"))
    pairs = class_pairs(listed, similar, block).unionByName(kinds.where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b")))
    ka, kb = (kinds.select(F.col("cls").alias(t), F.col("k").alias(f"k{t}")) for t in "ab")
    units = pairs.join(ka, "a").join(kb, "b").withColumn("pa", F.explode(F.sequence(F.lit(0), F.col("ka") - 1))).withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)))
    units = units.where("a < b OR pa <= pb").select("a", "b", "pa", "pb")
    ma, mb = (member.select(F.col("decl_id").alias(f"d{t}"), F.col("cls").alias(t), F.col("p").alias(f"p{t}")) for t in "ab")
    both = units.join(ma, ["a", "pa"]).join(mb, ["b", "pb"]).where("a < b OR pa < pb OR da < db")
    return both.select(F.least("da", "db").alias("decl_id_a"), F.greatest("da", "db").alias("decl_id_b"))


def classes(decls: DataFrame, similar: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """(decl_id, class_id, copies, links bigint): the compact form, one row per declaration that counts.

    ``class_id`` is the least id with the same set, ``copies`` the number of other declarations with
    it, and ``links`` that of classes alike: no copies are expanded into pairs.
    """
    member, listed = sets(decls, similar)
    member = materialize(member, "member")
    least = member.groupBy("cls").agg(F.min("decl_id").alias("class_id"), (F.count("*") - 1).alias("copies"))
    pairs = class_pairs(listed, similar, block)
    # a class only stale deliveries have counts for nothing
    pairs = pairs.join(least.select(F.col("cls").alias("a")), "a", "left_semi").join(least.select(F.col("cls").alias("b")), "b", "left_semi")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
    links = ends.groupBy("cls").agg(F.count("*").alias("links"))
    return member.join(least, "cls").join(links, "cls", "left").select("decl_id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


_SQL = r"""WITH one AS (SELECT decl_id, body_text FROM (SELECT *, row_number() OVER (PARTITION BY decl_id ORDER BY extracted_at DESC) AS rn FROM raw_decls WHERE decl_id IS NOT NULL) WHERE rn = 1),
words AS (SELECT decl_id, list_transform(regexp_extract_all(body_text, '[A-Za-z0-9_]+'), lambda w: lower(w)) AS w FROM one WHERE body_text IS NOT NULL),
shingles AS (SELECT DISTINCT decl_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM words, (SELECT unnest(generate_series(1, 5000)) AS i) WHERE len(w) >= 30 AND i <= len(w) - 2),
sizes AS (SELECT decl_id, count(*) AS n FROM shingles GROUP BY ALL),
pairs AS (SELECT a.decl_id AS decl_id_a, b.decl_id AS decl_id_b, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.decl_id < b.decl_id GROUP BY ALL),
alike AS (SELECT decl_id_a, decl_id_b, o, x.n AS na, y.n AS nb FROM pairs JOIN sizes x ON x.decl_id = decl_id_a JOIN sizes y ON y.decl_id = decl_id_b WHERE 2 * o >= x.n + y.n - o)
"""
FOUND_SQL = _SQL + "SELECT decl_id_a, decl_id_b FROM alike"
CLASSES_SQL = _SQL.rstrip() + """,
equal AS (SELECT decl_id_a AS a, decl_id_b AS b FROM alike WHERE o = na AND o = nb),
class AS (SELECT s.decl_id, coalesce(min(e.a), s.decl_id) AS class_id FROM sizes s LEFT JOIN equal e ON e.b = s.decl_id GROUP BY s.decl_id),
copies AS (SELECT class_id, count(*) - 1 AS copies FROM class GROUP BY ALL),
links AS (SELECT c, count(DISTINCT d) AS links FROM (SELECT x.class_id AS c, y.class_id AS d FROM alike JOIN class x ON x.decl_id = decl_id_a JOIN class y ON y.decl_id = decl_id_b UNION ALL SELECT y.class_id, x.class_id FROM alike JOIN class x ON x.decl_id = decl_id_a JOIN class y ON y.decl_id = decl_id_b) WHERE c <> d GROUP BY ALL)
SELECT c.decl_id, c.class_id, copies, coalesce(links, 0) AS links FROM class c JOIN copies USING (class_id) LEFT JOIN links l ON l.c = c.class_id"""
