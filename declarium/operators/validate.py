"""Integrity rules of a catalog: each gives rows (project, rule, level, subject, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declarium.functions import columns as C
from declarium.operators import catalog as K

COLUMNS = ("project", "rule", "level", "subject", "message")


def _rows(df: DataFrame, rule: str, subject: Column, message: Column, level: str = "error") -> DataFrame:
    return df.select("project", F.lit(rule).alias("rule"), F.lit(level).alias("level"), subject.cast("string").alias("subject"), message.alias("message"))


def skipped_files(parse_errors: DataFrame, strict: bool = False) -> DataFrame:
    """V1: files (project, error) that were not read; an error if strict, else a warning."""
    return _rows(parse_errors, "skipped_file", F.col("error"), F.concat(F.lit("file skipped during indexing: "), F.col("error")), "error" if strict else "warning")


def duplicate_ordinals(raw: DataFrame) -> DataFrame:
    """V2: ordinals that different addresses of a project share; one row per address after the first."""
    seen = raw.where("ordinal IS NOT NULL").select("project", "ordinal", "address").distinct()
    w = Window.partitionBy("project", "ordinal").orderBy("address")
    later = seen.withColumn("before", F.lag("address").over(w)).where("before IS NOT NULL")
    return _rows(later, "duplicate_ordinal", F.col("ordinal"), F.format_string("duplicate ordinal %d: '%s' and '%s'", F.col("ordinal"), F.col("before"), F.col("address")))


def retired_in_use(catalog: DataFrame, retired: DataFrame) -> DataFrame:
    """V3: items whose ordinal is retired (project, ordinal)."""
    return _retired(catalog.join(retired.select("project", "ordinal").distinct(), ["project", "ordinal"], "left_semi"))


def unheld_in_use(catalog: DataFrame, held: DataFrame) -> DataFrame:
    """V3 where every ordinal that ``held`` (project, ordinal) lacks counts as retired: the holes are never listed, however wide."""
    return _retired(catalog.join(held.select("project", "ordinal"), ["project", "ordinal"], "left_anti"))


def _retired(hit: DataFrame) -> DataFrame:
    return _rows(hit, "retired_ordinal", F.col("ordinal"), F.format_string("ordinal %d ('%s') is in retired_ordinals", F.col("ordinal"), F.col("address")))


def wrong_classes(catalog: DataFrame) -> DataFrame:
    """V4: items whose class is not that of their signature."""
    off = catalog.withColumn("actual", C.sig_class()).where("NOT (sig_class <=> actual)")
    message = F.concat(F.lit("declared "), F.coalesce("sig_class", F.lit("none")), F.lit(", actual "), F.col("actual"))
    return _rows(off, "wrong_sig_class", F.col("address"), message)


def untyped_slots(catalog: DataFrame, strict: bool = False) -> DataFrame:
    """V5: items with untyped parameters or return; an error if strict, else a warning."""
    named = catalog.withColumn("names", C.untyped_names()).where("size(names) > 0")
    return _rows(named, "untyped", F.col("address"), F.concat(F.lit("untyped ('any') in "), F.array_join("names", ", ")), "error" if strict else "warning")


def members(rows: DataFrame, catalog: DataFrame, rule: str) -> DataFrame:
    """V6, V7, V9, V10: members (project, sig_class, ordinal, subject) that are unknown or of another class."""
    known = catalog.select("project", "ordinal", F.col("sig_class").alias("actual"), F.lit(True).alias("known"))
    held = rows.join(known, ["project", "ordinal"], "left")
    off = held.where("known IS NULL OR NOT (actual <=> sig_class)")
    message = F.when(F.col("known").isNull(), F.format_string("'%s' references unknown ordinal %d", F.col("sig_class"), F.col("ordinal"))).otherwise(F.concat(F.lit("member "), F.col("ordinal"), F.lit(" has sig_class "), F.coalesce("actual", F.lit("none")), F.lit(", not "), F.col("sig_class")))
    return _rows(off, rule, F.col("subject"), message)


def class_members(classes: DataFrame, catalog: DataFrame) -> DataFrame:
    """V6, V7 over signature classes (project, sig_class, members)."""
    rows = classes.select("project", "sig_class", F.explode("members").alias("ordinal"), F.col("sig_class").alias("subject"))
    return members(rows, catalog, "class_member")


def array_members(arrays: DataFrame, catalog: DataFrame) -> DataFrame:
    """V9, V10 over op arrays (project, path, sig_class, ordinals)."""
    rows = arrays.select("project", "sig_class", F.explode("ordinals").alias("ordinal"), F.col("path").alias("subject"))
    return members(rows, catalog, "op_array_member")


def group_members(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """V8: members (project, path, ordinal) of groups that no item has."""
    lost = rows.join(catalog.select("project", "ordinal"), ["project", "ordinal"], "left_anti")
    return _rows(lost, "group_member", F.col("path"), F.format_string("group '%s' references unknown ordinal %d", F.col("path"), F.col("ordinal")))


def context_schema(catalog: DataFrame) -> DataFrame:
    """(project, key, type): the type of each context key at the first item that names it."""
    edges = K.ctx_edges(catalog)
    return edges.groupBy("project", "key").agg(F.min(F.struct("ordinal", "side", "type")).alias("f")).select("project", "key", "f.type")


def context_conflicts(catalog: DataFrame, schema: DataFrame) -> DataFrame:
    """V11, V12: adapter keys that the schema (project, key, type) lacks or types otherwise."""
    declared = schema.select("project", "key", F.col("type").alias("declared"))
    off = K.ctx_edges(catalog).join(declared, ["project", "key"], "left").where("declared IS NULL OR NOT (declared <=> type)")
    message = F.when(F.col("declared").isNull(), F.concat(F.lit("ctx key missing from ctx_schema: "), F.col("key"))).otherwise(F.concat(F.lit("ctx key type conflict: schema "), F.col("declared"), F.lit(", item "), F.coalesce("type", F.lit("none"))))
    return _rows(off, "ctx_key", F.concat_ws(":", "address", "key"), message).distinct()


def stages(pipelines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stages of pipelines (project, name, stages array<int>) in order, with what each needs and gives.

    (project, name, pos, ordinal, address, needs, gives, required array<string>, returns, return_key); the
    item's columns are null for an unknown ordinal.
    """
    needed = F.filter(C.params(), lambda p: ~F.coalesce(p["kind"], F.lit("positional")).isin("receiver", "kwvariadic") & p["default_value"].isNull())
    offered = catalog.select("project", "ordinal", "address", K.keys("requires").alias("needs"), K.keys("provides").alias("gives"), F.transform(needed, lambda p: C.typed(p["norm_type"])).alias("required"), F.transform(needed, lambda p: p["name"]).alias("required_names"), C.typed(F.col("signature.returns.norm_type")).alias("returns"), F.col("ctx_adapter.return_key").alias("return_key"), F.map_from_entries(F.coalesce(F.col("ctx_adapter.param_map"), F.array().cast("array<struct<key:string,value:string>>"))).alias("param_map"))
    rows = pipelines.select("project", "name", F.posexplode("stages").alias("pos", "ordinal"))
    return rows.join(offered, ["project", "ordinal"], "left")


def pipeline_stages(pipelines: DataFrame, catalog: DataFrame) -> DataFrame:
    """V13, V14: pipelines with unknown ordinals; stages that neither chain nor find their keys.

    The keys available to a stage are those that the first stage needs and all earlier stages give: a
    running union over each pipeline. Pipelines with unknown ordinals are judged no further.
    """
    held = stages(pipelines, catalog)
    broken = held.where("address IS NULL").groupBy("project", "name").agg(F.array_join(F.array_sort(F.collect_list("ordinal")), ", ").alias("lost"))
    unknown = _rows(broken, "pipeline_ordinal", F.col("name"), F.concat(F.lit("references unknown ordinals "), F.col("lost")))
    whole = held.join(broken, ["project", "name"], "left_anti")
    w = Window.partitionBy("project", "name").orderBy("pos")
    offered = F.when(F.col("pos") == 0, F.array_union("needs", "gives")).otherwise(F.col("gives"))
    so_far = F.array_distinct(F.flatten(F.collect_list(offered).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    seen = whole.select("*", so_far.alias("available"), F.lag("returns").over(w).alias("before"), F.lag("address").over(w).alias("after"))
    direct = (F.size("required") == 1) & (F.col("required")[0] == F.col("before"))
    lacking = F.array_sort(F.array_except("needs", "available"))
    off = seen.where((F.col("pos") > 0) & ~F.coalesce(direct, F.lit(False))).withColumn("lacking", lacking).where("size(lacking) > 0")
    message = F.concat(F.lit("stage "), F.col("address"), F.lit(" cannot follow "), F.col("after"), F.lit(": unprovided "), F.array_join("lacking", ", "))
    return unknown.unionByName(_rows(off, "pipeline_stage", F.col("name"), message))


def counts(violations: DataFrame) -> DataFrame:
    """(project, level, n) of violations."""
    return violations.groupBy("project", "level").agg(F.count("*").alias("n"))
