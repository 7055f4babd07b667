"""The catalog's views: one row per item, and its lists as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.functions import columns as C
from declarium.sources import columns, latest
from declarium.sources.catalogs import comparable

ITEM_COLUMNS = (
    "project", "ordinal", "address", "name", "kind", "language", "file", "group_path", "signature",
    "sig_class", "state_capture", "ctx_adapter", "deps", "doc", "hash", "ingested_at",
)


def items(raw: DataFrame, *wanted: str) -> DataFrame:
    """One row per (project, ordinal), the latest delivery; only the ``wanted`` columns reach the shuffle."""
    names = [c for c in (wanted or ITEM_COLUMNS) if c not in ("project", "ordinal", "ingested_at")]
    stamped = columns(raw, "project", "ordinal", "ingested_at", *names)
    if "ctx_adapter" in names:  # maps cannot be compared: as sorted entries they can, and tell the same
        return latest(comparable(stamped), ["project", "ordinal"], "ingested_at").drop("ingested_at")
    return latest(stamped, ["project", "ordinal"], "ingested_at").drop("ingested_at")


def keys(side: str):
    """Context keys of an item's adapter on one side, sorted; none for null."""
    return C.list_of(F.transform(F.col(f"ctx_adapter.{side}"), lambda e: e["key"]))


def params(catalog: DataFrame) -> DataFrame:
    """(project, ordinal, pos, name, raw_type, norm_type, default_value, kind): one row per parameter."""
    return catalog.select("project", "ordinal", F.posexplode(C.params()).alias("pos", "p")).select("project", "ordinal", "pos", "p.*")


def call_edges(catalog: DataFrame) -> DataFrame:
    """(project, ordinal, caller, pos, callee, is_external): one row per call in order."""
    rows = catalog.select("project", "ordinal", F.col("address").alias("caller"), F.posexplode(C.list_of(F.col("deps.calls"))).alias("pos", "callee"))
    return rows.where("callee IS NOT NULL").withColumn("is_external", F.col("callee").startswith("external:"))


def ctx_edges(catalog: DataFrame) -> DataFrame:
    """(project, ordinal, address, side, key, type): one row per context key that an item needs or gives."""
    sides = [catalog.select("project", "ordinal", "address", F.lit(s).alias("side"), F.explode(F.col(f"ctx_adapter.{s}")).alias("e")).select("project", "ordinal", "address", "side", "e.key", F.col("e.value").alias("type")) for s in ("requires", "provides")]
    return sides[0].unionByName(sides[1])


def signature_classes(catalog: DataFrame) -> DataFrame:
    """(project, sig_class, params array<string>, returns, members): each class' types, read from its id, and its ordinals, ascending."""
    held = catalog.where("sig_class IS NOT NULL").groupBy("project", "sig_class").agg(F.array_sort(F.collect_list("ordinal")).alias("members"))
    return held.select("project", "sig_class", C.class_params(F.col("sig_class")).alias("params"), C.class_returns(F.col("sig_class")).alias("returns"), "members")


def op_arrays(catalog: DataFrame) -> DataFrame:
    """(project, path, sig_class, ordinals) of each group and class."""
    return catalog.where("group_path IS NOT NULL AND sig_class IS NOT NULL").groupBy("project", F.col("group_path").alias("path"), "sig_class").agg(F.array_sort(F.collect_list("ordinal")).alias("ordinals"))


def groups(catalog: DataFrame) -> DataFrame:
    """(project, path, parent_path, name, kind, members): every group and the groups that enclose it.

    A path is a package above a module, the module of a file, or a class in it; a path that is more
    than one of them is the first in that order of ordinals.
    """
    base = catalog.where("group_path IS NOT NULL AND group_path <> ''").select("project", "ordinal", F.split("group_path", r"\.").alias("parts"), F.size(C.module_parts(F.col("file"))).alias("depth"))
    steps = base.select("project", "ordinal", "depth", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n"))
    kind = F.when(F.col("n") < F.col("depth"), "package").when(F.col("n") == F.col("depth"), "module").otherwise("class")
    rows = steps.select("project", "ordinal", "n", F.array_join(F.slice("parts", 1, F.col("n")), ".").alias("path"), kind.alias("kind"), (F.col("n") == F.size("parts")).cast("int").alias("own"))
    out = rows.groupBy("project", "path").agg(F.min_by("kind", F.struct("ordinal", "n")).alias("kind"), F.sum("own").alias("members"))
    name = F.substring_index("path", ".", -1)
    parent = F.when(F.contains("path", F.lit(".")), F.expr("left(path, length(path) - length(substring_index(path, '.', -1)) - 1)")).otherwise("")
    return out.select("project", "path", parent.alias("parent_path"), name.alias("name"), "kind", "members")


def summary(catalog: DataFrame) -> DataFrame:
    """(project, items, classes, ctx_keys, languages) of each project."""
    counts = catalog.groupBy("project").agg(F.count("*").alias("items"), F.count_distinct("sig_class").alias("classes"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    named = ctx_edges(catalog).groupBy("project").agg(F.count_distinct("key").alias("ctx_keys"))
    return counts.join(named, "project", "left").select("project", "items", "classes", F.coalesce("ctx_keys", F.lit(0)).alias("ctx_keys"), "languages")


def walk(groups: DataFrame, project: str | None = None, path: str | None = None) -> DataFrame:
    """The groups below ``path``, itself included, in pre-order: a path sorts before those that it encloses and they before its next sibling."""
    out = groups if project is None else groups.where(F.col("project") == project)
    if path is not None:
        out = out.where((F.col("path") == path) | F.col("path").startswith(path + "."))
    return out.orderBy("project", F.split("path", r"\."))


def at_group(groups: DataFrame, project: str, path: str) -> DataFrame:
    """The one group of a path, or none."""
    return groups.where((F.col("project") == project) & (F.col("path") == path))
