"""Building a catalog from declarations: addresses, ordinals, resolved calls, context keys.

Declarations carry their project; all projects are built in one plan. Only the naming of context keys
is sequential within a project; it sees names and types, no texts.
"""

from __future__ import annotations

import itertools
import re
import sys

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from declarium.functions import columns as C
from declarium.functions.types import normalized
from declarium.sources import columns, latest, materialize

#: Roots of Rust paths that name no package.
RUST_ROOTS = ("crate", "self", "super", "std", "core", "alloc", "test", "proc_macro")
#: Roots of Java names that the platform brings.
JAVA_ROOTS = ("java", "javax", "jdk")


def declarations(raw: DataFrame, body: bool = True) -> DataFrame:
    """One row per ``decl_id``, its latest delivery, the language spelled one way, by the file's ending where it is missing.

    Without ``body`` the texts stay behind: ``hash`` and ``env_vars`` take their place before anything moves.
    """
    names = ("project", "name", "kind", "language", "file", "start_line", "end_line", "scope_chain", "class_chain", "params", "returns_raw", "returns_norm", "is_async", "doc", "calls", "imports", "state_capture")
    language = F.coalesce(C.language(F.col("language")), C.language(F.regexp_extract("file", r"\.([a-z]+)$", 1)), F.col("language"))
    out = columns(raw, "decl_id", "extracted_at", *names, "body_text").withColumn("language", language).withColumn("file", F.regexp_replace("file", r"^(?:\./)+", ""))
    if not body:
        out = out.withColumn("hash", C.body_hash(F.col("body_text"))).withColumn("env_vars", C.env_vars(F.coalesce("body_text", F.lit("")), F.col("language"))).drop("body_text")
    return latest(out, ["decl_id"], "extracted_at").drop("extracted_at")


def addressed(decls: DataFrame) -> DataFrame:
    """Adds ``address``, unique in its project: the second of a name gets ``~2``, and so on, in order of file, line, name."""
    base = C.address(F.col("file"), F.col("scope_chain"), F.col("name"), F.col("start_line"))
    w = Window.partitionBy("project", "base").orderBy("file", "start_line", "name", "decl_id")
    rows = decls.withColumn("base", base).withColumn("rn", F.row_number().over(w))
    out = F.when(F.col("rn") == 1, F.col("base")).otherwise(F.concat("base", F.lit("~"), "rn"))
    return rows.withColumn("address", out).drop("base", "rn")


def places(rows: DataFrame) -> DataFrame:
    """(project, address, place): each row's place in its project from 0, by file, line, name and address.

    Rows are ranked within their file; a running sum over the files' sizes gives where a file begins, so
    no task sees a whole project, and nothing but the order's columns moves.
    """
    few = rows.select("project", "file", "start_line", "name", "address")
    sizes = few.groupBy("project", "file").agg(F.count("*").alias("n"))
    before = Window.partitionBy("project").orderBy(F.asc_nulls_first("file")).rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("project", F.col("file").alias("f"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("project", "file").orderBy("start_line", "name", "address")))
    met = ranked.join(begins, (ranked["project"].eqNullSafe(begins["project"])) & ranked["file"].eqNullSafe(begins["f"]))
    return met.select(ranked["project"], "address", (F.col("begin") + F.col("rank") - 1).cast("int").alias("place"))


def numbered(rows: DataFrame, old: DataFrame | None = None, retired: DataFrame | None = None) -> DataFrame:
    """Adds ``ordinal``: that of the ``old`` catalog (project, address, ordinal) where it has the address.

    New addresses are numbered on from the greatest ordinal ever used in the project, ``retired``
    (project, ordinal) ones included, in order of file, line and name. Rows have different addresses.
    """
    if old is None:
        return rows.join(places(rows).withColumnRenamed("place", "ordinal"), ["project", "address"])
    used = old.select("project", "ordinal")
    if retired is not None:
        used = used.unionByName(retired.select("project", "ordinal"))
    base = used.groupBy("project").agg((F.max("ordinal") + 1).alias("base"))
    kept = old.select("project", "address", F.col("ordinal").alias("kept"))
    fresh = places(rows.join(kept, ["project", "address"], "left_anti"))
    known = rows.join(kept, ["project", "address"], "left").join(fresh, ["project", "address"], "left").join(base, "project", "left")
    return known.withColumn("ordinal", F.coalesce("kept", F.coalesce("base", F.lit(0)) + F.col("place"))).drop("kept", "base", "place")


def retired(rows: DataFrame, old: DataFrame) -> DataFrame:
    """(project, ordinal) of old items whose address is gone."""
    return old.join(rows.select("project", "address"), ["project", "address"], "left_anti").select("project", "ordinal")


def resolved_calls(rows: DataFrame) -> DataFrame:
    """(project, address, calls): called names as addresses where exactly one item can be meant.

    A name means the only item of that name in the caller's module, else the only one of the project,
    else it stays external. One join on (project, name) against counts, so a name that a third of all
    calls hold meets one row.
    """
    grouped = rows.withColumn("grp", F.array_join(F.concat(C.module_parts(F.col("file")), C.list_of(F.col("class_chain"))), "."))
    calls = grouped.select("project", "address", "grp", F.posexplode(C.list_of(F.col("calls"))).alias("pos", "raw")).where("raw IS NOT NULL")
    calls = calls.withColumn("callee", F.substring_index("raw", ".", -1))
    # every group that encloses an item, with the number of items of each name below it
    names = rows.select("project", F.col("name").alias("callee"), F.col("address").alias("target"))
    everywhere = names.groupBy("project", "callee").agg(F.count("*").alias("n"), F.min("target").alias("only"))
    parts = F.split("target", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    inside = names.where(F.contains("target", F.lit("."))).select("project", "callee", "target", F.explode(above).alias("grp")).groupBy("project", "callee", "grp").agg(F.count("*").alias("near"), F.min("target").alias("nearest"))
    met = calls.join(everywhere, ["project", "callee"], "left").join(inside, ["project", "callee", "grp"], "left")
    target = F.when(F.col("near") == 1, F.col("nearest")).when(F.col("n") == 1, F.col("only")).otherwise(F.concat(F.lit("external:"), "raw"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", target.alias("t"))))
    return met.groupBy("project", "address").agg(F.array_distinct(F.transform(ordered, lambda x: x["t"])).alias("calls"))


def external_packages(rows: DataFrame) -> DataFrame:
    """(project, decl_id, packages): the packages outside the project that each declaration's file imports, sorted."""
    roots = rows.select("project", F.element_at(C.module_parts(F.col("file")), 1).alias("root")).where("root IS NOT NULL").distinct().withColumn("local", F.lit(True))
    imports = rows.select("project", "decl_id", "language", F.explode(C.list_of(F.col("imports"))).alias("i")).withColumn("i", F.trim("i")).where("i <> ''")
    lang = F.col("language")
    script = lang.isin("javascript", "typescript")
    split = F.split("i", "/")
    scoped = F.when(F.startswith("i", F.lit("@")), F.array_join(F.slice(split, 1, 2), "/")).otherwise(split[0])
    first = F.when(lang == "rust", F.split_part("i", F.lit("::"), F.lit(1))).when(lang == "go", split[0]).otherwise(F.split_part("i", F.lit("."), F.lit(1)))
    name = F.when(script, scoped).when(lang.isin("go", "bash"), F.col("i")).when(lang == "java", F.when(F.contains("i", F.lit(".")), F.regexp_replace("i", r"\.[^.]*$", "")).otherwise(F.col("i"))).otherwise(first)
    own = (
        F.when(script, F.startswith("i", F.lit(".")) | F.startswith("i", F.lit("/")) | F.startswith("i", F.lit("node:")))
        .when(lang == "python", first.isin(*sorted(sys.stdlib_module_names)))
        .when(lang == "go", ~F.contains(first, F.lit(".")))
        .when(lang == "rust", first.isin(*RUST_ROOTS))
        .when(lang == "java", first.isin(*JAVA_ROOTS))
        .when(lang == "bash", F.lit(False))
        .otherwise(F.lit(True))
    )
    kept = imports.select("project", "decl_id", "language", first.alias("root"), name.alias("package"), own.alias("own")).where("NOT own")
    met = kept.join(roots, ["project", "root"], "left").where(F.col("local").isNull() | script | (lang == "bash"))
    return met.groupBy("project", "decl_id").agg(F.array_sort(F.collect_set("package")).alias("packages"))


def _key(text: str) -> str:
    """A name as a context key, as ``columns.context_key`` spells it."""
    key = re.sub("[^A-Za-z0-9_]", "_", text)
    return key if re.match("[A-Za-z_]", key) else f"_{key}"


def _placed(schema: dict[str, str], kind: str, wishes: list[str]) -> str:
    """The first of the wishes that is free or has this type already; then the last one with a number from 2 on."""
    keys = [_key(w) for w in wishes]
    chosen = next(k for k in itertools.chain(keys, (f"{keys[-1]}{n}" for n in itertools.count(2))) if schema.get(k, kind) == kind)
    schema[chosen] = kind
    return chosen


def context_keys(catalog: DataFrame) -> DataFrame:
    """(project, ordinal, param, side, key, type, required): the context key of each parameter and return.

    In ordinal order the first to use a key fixes its type; a later item that needs it with another
    type gets a key with its own name before it, then with its group's, then numbered. Sequential by
    definition, so each project is one group, of names and types only. ``param`` is null for a return.
    """
    slots = F.transform(F.filter(C.params(), lambda p: ~F.coalesce(p["kind"], F.lit("positional")).isin("receiver", "kwvariadic")), lambda p: F.struct(F.coalesce(p["name"], F.lit("")).alias("name"), C.typed(p["norm_type"]).alias("type"), p["default_value"].isNull().alias("required")))
    rows = catalog.select("project", "ordinal", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("group_path", F.lit("")).alias("grp"), slots.alias("slots"), C.typed(F.col("signature.returns.norm_type")).alias("returns"))

    def place(part: pd.DataFrame) -> pd.DataFrame:
        schema: dict[str, str] = {}  # types by key: the first item to name a key owns its type
        out = []
        for r in part.sort_values(["ordinal", "name"], kind="stable").itertuples(index=False):
            group = _key(r.grp.replace(".", "_"))
            for s in r.slots:
                out.append((r.project, r.ordinal, s["name"], "requires", _placed(schema, s["type"], [s["name"], f"{r.name}_{s['name']}", f"{group}_{s['name']}"]), s["type"], bool(s["required"])))
            if r.returns != "unit":
                out.append((r.project, r.ordinal, None, "provides", _placed(schema, r.returns, [f"{r.name}_result", f"{group}_{r.name}_result"]), r.returns, True))
        return pd.DataFrame(out, columns=["project", "ordinal", "param", "side", "key", "type", "required"])

    return rows.groupBy("project").applyInPandas(place, "project string, ordinal int, param string, side string, key string, type string, required boolean")


def items(raw: DataFrame, old: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """The catalog of ``raw`` declarations: items with addresses, ordinals, types, classes, calls, packages, hashes.

    ``old`` (project, address, ordinal) and ``gone`` (project, ordinal) keep ordinals over rebuilds.
    """
    rows = materialize(numbered(addressed(declarations(raw, body=False)), old, gone), "declared")
    typed = normalized(rows)
    calls = resolved_calls(rows).withColumnRenamed("calls", "resolved")
    packages = external_packages(rows).select("decl_id", "packages")
    out = typed.join(calls, ["project", "address"], "left").join(packages, "decl_id", "left")
    group = F.array_join(F.concat(C.module_parts(F.col("file")), C.list_of(F.col("class_chain"))), ".")
    name = F.when(F.col("name").startswith("<"), F.substring_index("address", ".", -1)).otherwise(F.col("name"))
    deps = F.struct(C.list_of(F.col("resolved")).alias("calls"), F.array_sort(F.array_distinct(C.list_of(F.col("imports")))).alias("imports"), C.list_of(F.col("packages")).alias("external_packages"), F.col("env_vars"))
    return out.select(
        "project", "ordinal", "decl_id", "address", name.alias("name"), "kind", "language", "file", F.array("start_line", "end_line").alias("span"), group.alias("group_path"),
        "signature", C.sig_class().alias("sig_class"), "state_capture", C.trait(F.col("state_capture")).alias("trait"), deps.alias("deps"), "doc", "hash",
    )
