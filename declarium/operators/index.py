"""Whole catalog documents: built from a source tree, read back as tables, judged by all rules."""

from __future__ import annotations

import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declarium.functions import columns as C
from declarium.operators import build, catalog, nested, validate
from declarium.sources import catalogs, materialize, trees

VERSION = "1"
VOCABULARY = "core-1"


def with_context(items: DataFrame) -> DataFrame:
    """Adds ``ctx_adapter``: what each item needs and gives, under the keys that ``build.context_keys`` places."""
    keys = build.context_keys(items)
    entry = F.struct(F.col("key").alias("key"), F.col("type").alias("value"))
    mapped = F.struct(F.col("param").alias("key"), F.concat(F.lit("ctx."), "key").alias("value"))
    needs = F.col("side") == "requires"
    adapters = keys.groupBy("project", "ordinal").agg(
        F.struct(
            F.array_sort(F.collect_set(F.when(needs & F.col("required"), entry))).alias("requires"),
            F.array_sort(F.collect_set(F.when(~needs, entry))).alias("provides"),
            F.array_sort(F.collect_set(F.when(needs, mapped))).alias("param_map"),
            F.max(F.when(~needs, F.col("key"))).alias("return_key"),
        ).alias("ctx_adapter")
    )
    none = F.array().cast("array<struct<key:string,value:string>>")
    empty = F.struct(none.alias("requires"), none.alias("provides"), none.alias("param_map"), F.lit(None).cast("string").alias("return_key"))
    return items.join(adapters, ["project", "ordinal"], "left").withColumn("ctx_adapter", F.coalesce("ctx_adapter", empty))


def build_document(spark: SparkSession, root: str, name: str, languages: list[str] | None = None, old: dict | None = None) -> dict:
    """The catalog document of a source tree; ``old`` keeps its ordinals, retired ones, and pipelines.

    One project's document passes the driver; catalogs of many projects are kept as tables instead.
    """
    files = trees.read(spark, root, name, languages)
    declared = materialize(trees.declarations(files), "declared")
    raw = declared.where("error IS NULL").withColumn("decl_id", F.xxhash64("file", "start_line", "end_line", "name", "kind", "body_text")).withColumn("extracted_at", F.lit(None).cast("timestamp"))
    known = [(name, i["address"], i["ordinal"]) for i in (old or {}).get("items", [])]
    gone = sorted({*(old or {}).get("retired_ordinals", [])})
    before = spark.createDataFrame(known, "project string, address string, ordinal int") if known else None
    retired = spark.createDataFrame([(name, o) for o in gone], "project string, ordinal int") if gone else None
    items = materialize(with_context(build.items(raw, before, retired)), "items")
    if before is not None:
        gone = sorted({*gone, *(r.ordinal for r in build.retired(items, before).collect())})
    rows = [r.asDict(recursive=True) for r in items.orderBy("ordinal").collect()]
    return {
        "spi_version": VERSION, "project": {"name": name, "root": os.path.abspath(root), "generated_at": datetime.now(UTC).isoformat(timespec="seconds")}, "type_vocabulary": VOCABULARY,
        "items": [_item(r) for r in rows], "groups": _tree(catalog.groups(items), items),
        "signature_classes": {r.sig_class: {"params": r.params, "returns": r.returns, "members": r.members} for r in catalog.signature_classes(items).orderBy("sig_class").collect()},
        "pipelines": (old or {}).get("pipelines", []), "ctx_schema": {r.key: r.type for r in build.context_keys(items).select("key", "type").distinct().orderBy("key").collect()},
        "retired_ordinals": gone, "parse_errors": sorted(r.error for r in trees.parse_errors(declared).collect()),
    }


def _item(r: dict) -> dict:
    adapter = {k: v if k == "return_key" else {e["key"]: e["value"] for e in v} for k, v in r["ctx_adapter"].items()}
    params = [{"default" if k == "default_value" else k: v for k, v in p.items()} for p in r["signature"]["params"]]
    out = {k: r[k] for k in ("ordinal", "address", "name", "kind", "language", "file", "span")}
    return out | {
        "group": r["group_path"], "signature": {**r["signature"], "params": params}, "sig_class": r["sig_class"], "state_capture": r["state_capture"], "rust_fn_trait": r["trait"], "ctx_adapter": adapter,
        "deps": {**r["deps"], "ctx_keys_required": sorted(adapter["requires"])}, "doc": r["doc"], "hash": r["hash"],
    }


def _tree(groups: DataFrame, items: DataFrame) -> list[dict]:
    """The groups inside each other, with their members and op arrays."""
    arrays: dict[str, dict[str, list[int]]] = {}
    for r in catalog.op_arrays(items).collect():
        arrays.setdefault(r.path, {})[r.sig_class] = r.ordinals
    made: dict[str, dict] = {}
    for r in catalog.walk(groups).collect():
        own = arrays.get(r.path, {})
        made[r.path] = {"name": r.name, "kind": r.kind, "path": r.path, "op_arrays": dict(sorted(own.items())), "children": [], "member_ordinals": sorted(o for held in own.values() for o in held)}
    for path, group in made.items():
        above = path.rpartition(".")[0]
        if above in made:
            made[above]["children"].append(group)
    return [g for p, g in made.items() if p.rpartition(".")[0] not in made]


def items_of(docs: DataFrame) -> DataFrame:
    """The items of documents as the operators read them."""
    return catalogs.comparable(catalogs.items(docs))


def violations(docs: DataFrame, texts: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(project, rule, level, subject, message): all rules over catalog documents.

    ``texts`` (index_id, index_json, loaded_at) are the same documents as texts: their groups are read
    from there, as they nest without end.
    """
    name = F.col("project.name").alias("project")
    held = items_of(docs)
    classes = docs.select(name, F.explode("signature_classes").alias("sig_class", "c")).select("project", "sig_class", F.col("c.members").alias("members"))
    schema = docs.select(name, F.explode("ctx_schema").alias("key", "type"))
    lines = catalogs.pipelines(docs).select("project", "name", "stages")
    retired = docs.select(name, F.explode("retired_ordinals").alias("ordinal"))
    parts = [
        validate.skipped_files(docs.select(name, F.explode("parse_errors").alias("error")), strict), validate.duplicate_ordinals(held), validate.retired_in_use(held, retired), validate.wrong_classes(held),
        validate.untyped_slots(held, strict), validate.class_members(classes, held), validate.context_conflicts(held, schema), validate.pipeline_stages(lines, held),
    ]
    if texts is not None:
        nodes = nested.nodes(texts)
        project = docs.select(name).distinct()
        arrays = nodes.where("type = 'op_array'").select(F.col("name").alias("sig_class"), F.expr("try_cast(value AS int)").alias("ordinal"), F.col("key").alias("subject")).where("ordinal IS NOT NULL").distinct()
        parts.append(validate.members(arrays.crossJoin(F.broadcast(project.limit(1))), held, "op_array_member"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary_line(items: DataFrame, name: str) -> str:
    """What an index holds, on one line."""
    r = catalog.summary(items).where(F.col("project") == name).head()
    if r is None:
        return f"indexed {name}: 0 items, 0 signature classes, 0 ctx keys, languages: none"
    return f"indexed {name}: {r['items']} items, {r.classes} signature classes, {r.ctx_keys} ctx keys, languages: {r.languages.replace(',', ', ') or 'none'}"


def shown(items: DataFrame) -> DataFrame:
    """The items with the columns that texts about them need."""
    return items.withColumn("trait", C.trait(F.col("state_capture")))
