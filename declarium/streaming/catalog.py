"""Keeping a catalog's addresses and ordinals up to date from a stream of declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from declarium.functions import columns as C
from declarium.operators import build

STATE = "project string, base string, file string, nth int, suffix int, name string, start_line int, address string, ordinal int, batch bigint"


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that were written to their end."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = make(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("batch=")]
    return sorted(int(n.getName().split("=")[1]) for n in names if fs.exists(make(n, "_SUCCESS")))


def _state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The latest row of each address, from the finished batches, those from ``before`` on left out."""
    held = [n for n in _batches(spark, path) if before is None or n < before]
    if not held:
        return spark.createDataFrame([], STATE)
    rows = spark.read.schema(STATE).parquet(*[f"{path}/batch={n}" for n in held])
    others = [c for c in rows.columns if c not in ("project", "address", "batch")]
    best = rows.groupBy("project", "address").agg(F.max(F.struct("batch", *others)).alias("r"))
    return best.select("project", "r.base", "r.file", "r.nth", "r.suffix", "r.name", "r.start_line", "address", "r.ordinal", "r.batch")


def upsert(spark: SparkSession, batch: DataFrame, path: str, number: int) -> None:
    """Merges a batch's declarations into the catalog at ``path``; what it writes is new and changed rows alone.

    A declaration is known again by its project, base address and file, and its place among those of
    the file. Known ones keep address and ordinal; a new one whose base address is taken, by this batch
    or an earlier one, gets the next suffix, and new ordinals are numbered on. A repeated batch writes
    the same rows again.
    """
    old = _state(spark, path, number)
    rows = build.declarations(batch, body=False).withColumn("base", C.address(F.col("file"), F.col("scope_chain"), F.col("name"), F.col("start_line")))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("project", "base", "file").orderBy("start_line", "name", "decl_id")))
    keys = ["project", "base", "file", "nth"]
    known = old.select(*keys, F.col("address").alias("kept"), F.col("suffix").alias("had"), F.col("ordinal").alias("number"))
    met = rows.select(*keys, "name", "start_line").join(known, keys, "left")
    taken = old.groupBy("project", "base").agg(F.max("suffix").alias("taken"))
    fresh = met.where("kept IS NULL").join(taken, ["project", "base"], "left")
    suffix = F.coalesce("taken", F.lit(0)) + F.row_number().over(Window.partitionBy("project", "base").orderBy("file", "start_line", "nth"))
    address = F.when(F.col("suffix") == 1, F.col("base")).otherwise(F.concat("base", F.lit("~"), "suffix"))
    fresh = fresh.withColumn("suffix", suffix.cast("int")).withColumn("address", address).select(*keys, "suffix", "name", "start_line", "address")
    # places follow the order of the batch's new rows; ordinals go on from the greatest ever used
    base = old.groupBy("project").agg((F.max("ordinal") + 1).alias("first"))
    ordinal = (F.coalesce("first", F.lit(0)) + F.col("place")).cast("int")
    fresh = fresh.join(build.places(fresh), ["project", "address"]).join(base, "project", "left").withColumn("ordinal", ordinal)
    again = met.where("kept IS NOT NULL").select(*keys, F.col("had").alias("suffix"), "name", "start_line", F.col("kept").alias("address"), F.col("number").alias("ordinal"))
    columns = [c.split()[0] for c in STATE.split(", ")]
    out = again.unionByName(fresh.select(*again.columns)).withColumn("batch", F.lit(number).cast("bigint")).select(*columns)
    out.write.mode("overwrite").parquet(f"{path}/batch={number}")


def current(spark: SparkSession, path: str) -> DataFrame:
    """(project, file, start_line, name, address, ordinal) of the finished batches."""
    return _state(spark, path).select("project", "file", "start_line", "name", "address", "ordinal")


def follow(spark: SparkSession, source: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Feeds a stream of declaration rows into the catalog at ``path``, one batch at a time."""
    return source.writeStream.foreachBatch(lambda batch, number: upsert(spark, batch, path, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
