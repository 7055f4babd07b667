"""Catalogs on disk: JSON documents of one project each, the registry of projects, written tables."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declarium.sources.tables import columns, latest

_PARAM = "struct<name:string,raw_type:string,norm_type:string,default:string,kind:string>"
_ITEM = (
    f"struct<ordinal:int,address:string,name:string,kind:string,language:string,file:string,span:array<int>,`group`:string,signature:struct<params:array<{_PARAM}>,returns:struct<raw_type:string,norm_type:string>,is_async:boolean>,"
    "sig_class:string,state_capture:string,rust_fn_trait:string,ctx_adapter:struct<requires:map<string,string>,provides:map<string,string>,param_map:map<string,string>,return_key:string>,"
    "deps:struct<calls:array<string>,imports:array<string>,external_packages:array<string>,env_vars:array<string>,ctx_keys_required:array<string>>,doc:string,hash:string>"
)
#: Schema of a catalog document. Groups nest without end, so they stay text; ``nested`` flattens them.
DOCUMENT = (
    "spi_version string, sca_version string, project struct<name:string,root:string,generated_at:string>, type_vocabulary string,"
    f" items array<{_ITEM}>, groups string, signature_classes map<string, struct<params:array<string>,returns:string,members:array<int>>>,"
    " pipelines array<struct<name:string,stages:array<int>,checked:boolean,edges:array<struct<after:int,from_key:string,to_key:string>>>>, ctx_schema map<string,string>, retired_ordinals array<int>, parse_errors array<string>"
)
#: What the enumerated columns of an item may hold.
ENUMS = {
    "kind": ("function", "method", "closure", "lambda", "script_main"),
    "state_capture": ("pure", "reads_captured", "mutates_captured", "consumes", "reads_instance", "mutates_instance"),
    "rust_fn_trait": ("fn", "Fn", "FnMut", "FnOnce"),
}


def load(spark: SparkSession, paths: list[str], projects: list[str] | None = None) -> DataFrame:
    """Catalog documents of any number of projects in one scan; paths that do not exist are skipped.

    The old name of the version field counts. Texts that are no catalog are skipped.
    """
    there = [p for p in paths if "://" in p or os.path.exists(p)]
    if not there:
        return spark.createDataFrame([], DOCUMENT)
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "DROPMALFORMED").json(there)
    docs = docs.withColumn("spi_version", F.coalesce("spi_version", "sca_version")).where("spi_version IS NOT NULL AND project.name IS NOT NULL")
    return docs.where(F.col("project.name").isin(*projects)) if projects is not None else docs


def from_texts(texts: DataFrame, column: str = "index_json") -> DataFrame:
    """Catalog documents from a column of JSON texts; texts that are no catalog are skipped, as in ``load``."""
    docs = texts.select(F.from_json(column, DOCUMENT, {"mode": "PERMISSIVE"}).alias("d")).select("d.*")
    return docs.withColumn("spi_version", F.coalesce("spi_version", "sca_version")).where("spi_version IS NOT NULL AND project.name IS NOT NULL")


def items(docs: DataFrame) -> DataFrame:
    """The items of catalog documents, as the catalog's operators read them."""
    rows = docs.select(F.col("project.name").alias("project"), F.explode("items").alias("i")).select("project", "i.*").withColumnRenamed("group", "group_path")
    params = F.transform("signature.params", lambda p: F.struct(p["name"].alias("name"), p["raw_type"].alias("raw_type"), p["norm_type"].alias("norm_type"), p["default"].alias("default_value"), p["kind"].alias("kind")))
    return rows.withColumn("signature", F.struct(params.alias("params"), F.col("signature.returns").alias("returns"), F.col("signature.is_async").alias("is_async"))).withColumn("ingested_at", F.lit(None).cast("timestamp_ntz"))


def pipelines(docs: DataFrame) -> DataFrame:
    """(project, name, stages, checked, edges) of catalog documents."""
    return docs.select(F.col("project.name").alias("project"), F.explode("pipelines").alias("p")).select("project", "p.*")


def schema_violations(rows: DataFrame) -> DataFrame:
    """(project, subject, message): items without a needed field, or with a value that its list does not have."""
    needed = [(c, F.col(c).isNull(), "missing") for c in ("ordinal", "address", "name", "kind", "sig_class") if c in rows.columns]
    listed = [(c, F.col(c).isNotNull() & ~F.col(c).isin(*v), "not allowed") for c, v in ENUMS.items() if c in rows.columns]
    checks = F.array(*[F.when(cond, F.concat(F.lit(f"{c} {what}: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))) for c, cond, what in [*needed, *listed]])
    return rows.select("project", F.coalesce("address", F.lit("")).alias("subject"), F.explode(F.filter(checks, lambda m: m.isNotNull())).alias("message"))


def write(catalog: DataFrame, path: str) -> None:
    """The catalog as Parquet, one folder per project, so that a project filter reads only its own."""
    catalog.repartition("project", F.pmod(F.xxhash64("ordinal"), F.lit(8))).sortWithinPartitions("project", "ordinal").write.mode("overwrite").partitionBy("project").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export(catalog: DataFrame) -> DataFrame:
    """(project, item_json): one JSON text per item, in the documents' spelling."""
    return catalog.select("project", "ordinal", F.to_json(F.struct(*[c for c in catalog.columns if c != "project"])).alias("item_json"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(name, root, index, last_indexed) of a registry file; a missing or broken file is an empty registry."""
    try:
        with open(path) as f:
            held = json.load(f)
        rows = [(k, v.get("root"), v.get("index"), v.get("last_indexed")) for k, v in sorted(held.items())]
    except (OSError, ValueError, AttributeError):
        rows = []
    return spark.createDataFrame(rows, "name string, root string, index string, last_indexed string")


def register(path: str, name: str, root: str, index: str, stamp: str) -> None:
    """Adds a project to a registry file, or replaces the one of that name."""
    _update(path, lambda held: held.update({name: {"root": root, "index": index, "last_indexed": stamp}}))


def unregister(path: str, name: str) -> None:
    _update(path, lambda held: held.pop(name, None))


def index_path(root: str) -> str | None:
    """Where a root's catalog document lies: the present folder, else the older ones; None if there is none."""
    options = [os.path.join(root, folder, "index.json") for folder in (".declarium", ".spi", ".sca")]
    return next((p for p in options if os.path.exists(p)), None)


def registered(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    """The documents of the registry's projects, or of one, each under its registered name; missing documents are skipped.

    One scan over all paths; a document is known by its file, which the registry names.
    """
    known = [r for r in registry(spark, path).collect() if r["index"] and (project is None or r.name == project)]
    docs = load(spark, [r["index"] for r in known])
    if not docs.columns or not known:
        return spark.createDataFrame([], DOCUMENT)
    names = spark.createDataFrame([(r.name, os.path.abspath(r["index"])) for r in known], "registered string, place string")
    held = docs.withColumn("place", F.regexp_replace(F.url_decode(F.input_file_name()), "^file:/*", "/"))
    met = held.join(F.broadcast(names), "place")
    named = F.struct(F.col("registered").alias("name"), F.col("project.root").alias("root"), F.col("project.generated_at").alias("generated_at"))
    return met.withColumn("project", named).drop("registered", "place")


def comparable(items_: DataFrame) -> DataFrame:
    """Items whose adapter maps are sorted entries, as the catalog's operators read them."""
    fields = items_.schema["ctx_adapter"].dataType.fieldNames()
    cols = [F.array_sort(F.map_entries(f"ctx_adapter.{f}")).alias(f) if f != "return_key" else F.col("ctx_adapter.return_key").alias(f) for f in fields]
    return items_.withColumn("ctx_adapter", F.struct(*cols))


def registered_items(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    """The items of the registry's projects: the registry joined with its documents."""
    return comparable(items(registered(spark, path, project)))


def save(document: dict, path: str) -> None:
    """A whole catalog document as JSON, put in place at once: a reader sees the old one or the new one."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.tmp", "w") as f:
        json.dump(document, f, indent=1)
    os.replace(f"{path}.tmp", path)


def _update(path: str, change) -> None:
    try:
        with open(path) as f:
            held = json.load(f)
    except (OSError, ValueError):
        held = {}
    change(held)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path + ".tmp", "w") as f:
        json.dump(held, f, indent=1)
    os.replace(path + ".tmp", path)


def projects(raw: DataFrame) -> DataFrame:
    """One row per project name, the one with the greatest root among repeated rows; null names are left out."""
    return latest(columns(raw, "name", "root", "index_path", "last_indexed"), ["name"]).select("name", "root", "index_path", "last_indexed")
