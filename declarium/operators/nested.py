"""Deeply nested documents as flat, typed tables that keep every parent-child link.

One depth-first traversal labels each node of a document: ``pre`` is its place on entry, ``post``
the greatest ``pre`` below it, so that node a encloses node b exactly if ``a.pre < b.pre`` and
``b.pre <= a.post``. Nodes are emitted with their type, level and key; a link is found again from
the labels alone, whatever the depth: the parent is the last node of the level above that begins
before the child, and it must contain the child's interval.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from declarium.sources import columns, latest, materialize

NODE_TYPES = ("document", "item", "param", "group", "op_array", "pipeline", "edge")
NODES = "index_id bigint, type string, pre int, post int, level int, key string, name string, kind string, value string"
_ARROW = pa.schema([("index_id", pa.int64()), ("type", pa.string()), ("pre", pa.int32()), ("post", pa.int32()), ("level", pa.int32()), *[(c, pa.string()) for c in ("key", "name", "kind", "value")]])


def _constant(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


def _read(text: str | None) -> dict | None:
    """The document, or None where the text is no valid JSON object."""
    if text is None:
        return None
    try:
        found = json.loads(text, parse_constant=_constant)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _list(value: Any) -> list:
    """A list as it is, nothing for null, and a lone member as a list of one."""
    if value is None:
        return []
    return value if isinstance(value, list) else [value]


def _text(value: Any) -> str:
    """Scalars as text without surrounding blanks, null as the empty text; whole numbers without a fraction."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    if isinstance(value, (dict, list)):
        return json.dumps(value, ensure_ascii=False)
    return str(value).strip()


def _pipelines(value: Any) -> list[tuple[str, dict]]:
    """Pipelines from a list, from a lone one, or from an object keyed by name."""
    if isinstance(value, dict) and not isinstance(value.get("name"), str) and not isinstance(value.get("stages"), list):
        return [(_text(k) if not isinstance(v.get("name"), str) else _text(v["name"]), v) for k, v in value.items() if isinstance(v, dict)]
    return [(_text(v.get("name")), v) for v in _list(value) if isinstance(v, dict)]


def _children(kind: str, key: str, node: dict) -> list[tuple[str, str, dict | None, dict]]:
    """(type, key, node to descend into, attributes) of each child, in document order."""
    out: list[tuple[str, str, dict | None, dict]] = []
    if kind == "document":
        for x in _list(node.get("items")):
            if isinstance(x, dict):
                out.append(("item", _text(x.get("ordinal")), x, {"name": x.get("name"), "value": x.get("sig_class")}))
        out += _groups(node.get("groups"), "")
        for name, x in _pipelines(node.get("pipelines")):
            out.append(("pipeline", name, x, {"name": name, "value": json.dumps(_list(x.get("stages")))}))
    elif kind == "item":
        signature = node.get("signature")
        for i, x in enumerate(_list(signature.get("params")) if isinstance(signature, dict) else []):
            if isinstance(x, dict):
                out.append(("param", str(i), None, {"name": x.get("name"), "kind": x.get("kind"), "value": x.get("norm_type")}))
    elif kind == "group":
        arrays = node.get("op_arrays")
        for sig, ordinals in arrays.items() if isinstance(arrays, dict) else ():
            for o in _list(ordinals):
                if o is not None:
                    out.append(("op_array", f"{sig}|{_text(o)}", None, {"name": sig, "value": _text(o)}))
        out += _groups(node.get("children"), key)
    elif kind == "pipeline":
        for x in _list(node.get("edges")):
            if isinstance(x, dict):
                out.append(("edge", "|".join(_text(x.get(f)) for f in ("after", "from_key", "to_key")), None, {}))
    return out


def _groups(value: Any, above: str) -> list[tuple[str, str, dict | None, dict]]:
    out: list[tuple[str, str, dict | None, dict]] = []
    for x in _list(value):
        if isinstance(x, dict):
            name = _text(x.get("name"))
            path = _text(x.get("path")) or (f"{above}.{name}" if above else name)
            out.append(("group", path, x, {"name": name, "kind": x.get("kind")}))
    return out


def label(document: dict) -> list[list]:
    """[type, pre, post, level, key, name, kind, value] of each node; no recursion, so any depth will do."""
    rows: list[list] = [["document", 0, 0, 0, "", None, None, _text(document.get("spi_version", document.get("sca_version")))]]
    stack = [(0, iter(_children("document", "", document)))]
    while stack:
        at, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            rows[at][2] = len(rows) - 1
            continue
        kind, key, node, more = child
        row = [kind, len(rows), len(rows), len(stack), key, *[None if more.get(c) is None else _text(more[c]) for c in ("name", "kind", "value")]]
        rows.append(row)
        if node is not None:
            stack.append((len(rows) - 1, iter(_children(kind, key, node))))
    return rows


def nodes(index_docs: DataFrame) -> DataFrame:
    """Every node of every document, labelled: columns as in ``NODES``.

    A document that is delivered more than once counts once, by its latest ``loaded_at``. Null
    texts, texts that are no valid JSON, or no object, give no rows; neither do rows without an id.
    Missing, null and empty optional fields give no nodes; a lone member counts as a list of one; a
    null in a list is no node but keeps its place.
    """
    docs = latest(columns(index_docs, "index_id", "index_json", "loaded_at"), ["index_id"], "loaded_at")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, table = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                document = _read(text)
                if document is not None:
                    rows = label(document)
                    ids += [key] * len(rows)
                    table += rows
                if len(table) > 20_000:
                    yield _batch(ids, table)
                    ids, table = [], []
            if table:
                yield _batch(ids, table)

    return docs.select("index_id", "index_json").mapInArrow(run, NODES)


def _batch(ids: list, rows: list[list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip([ids, *zip(*rows, strict=True)], _ARROW, strict=True)], schema=_ARROW)


def tables(index_docs: DataFrame) -> dict[str, DataFrame]:
    """The node table of each type, over one labelling, which is written once."""
    all_nodes = materialize(nodes(index_docs), "nodes")
    return {t: all_nodes.where(F.col("type") == t).drop("type") for t in NODE_TYPES}


def links(labelled: DataFrame) -> DataFrame:
    """(index_id, child_type, child_key, parent_type, parent_key) by interval containment.

    Each node stands once as a child in its own level and once as a possible parent in the level
    below. In one (document, level), ordered by ``pre``, the last possible parent before a child is
    the only one whose interval can hold it. One shuffle and one sort, linear in the nodes.
    """
    n = columns(labelled, "index_id", "type", "pre", "post", "level", "key")
    none, no_parent = F.lit(None).cast("string"), F.lit(None).cast("struct<post:int,type:string,key:string>")
    as_child = F.struct(F.col("level").alias("level"), F.col("type").alias("child_type"), F.col("key").alias("child_key"), no_parent.alias("p"))
    as_parent = F.struct((F.col("level") + 1).alias("level"), none.alias("child_type"), none.alias("child_key"), F.struct("post", "type", "key").alias("p"))
    # both from one row, so that documents are parsed once
    roles = F.when(F.col("post") > F.col("pre"), F.array(as_child, as_parent)).otherwise(F.array(as_child))
    order = Window.partitionBy("index_id", "level").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = n.select("index_id", "pre", F.explode(roles).alias("r")).select("index_id", "pre", "r.*").withColumn("p", F.last("p", ignorenulls=True).over(order))
    kept = found.where("child_type IS NOT NULL AND pre <= p.post")
    return kept.select("index_id", "child_type", "child_key", F.col("p.type").alias("parent_type"), F.col("p.key").alias("parent_key"))


def found(index_docs: DataFrame) -> DataFrame:
    """(index_id bigint, rel, parent_key, child_key string): links of groups, op arrays, params and edges."""
    kept = links(nodes(index_docs)).where(F.col("child_type").isin("group", "op_array", "param", "edge"))
    return kept.select("index_id", F.col("child_type").alias("rel"), "parent_key", "child_key").distinct()
