"""Reading the shared tables, and the few plan helpers every operator needs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Tables written by ``materialize``, by application.
_WRITTEN: dict[str, list[str]] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; nothing is read before an action."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, in that order.

    Every operator calls this first, so that extra columns, whatever they are called, neither reach
    a shuffle nor clash with a column that the operator makes.
    """
    return df.select(*[df[n] for n in names])


def latest(df: DataFrame, keys: list[str], stamp: str | None = None) -> DataFrame:
    """One row per key: the one with the latest ``stamp``, the greatest content among ties.

    Rows may be delivered more than once. Rows with a null in a key are left out, as nothing can be
    reported about them. One aggregation; a hot key costs nothing, as equal keys combine before the
    shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c != stamp]
    order = ([F.col(stamp)] if stamp else []) + [F.col(c) for c in rest]
    kept = df.where(_all_there(keys))
    if not order:
        return kept.dropDuplicates(keys)
    if stamp and rest:
        best = F.max(F.struct(F.col(stamp), F.struct(*rest).alias("r"))).alias("best")
        return kept.groupBy(*keys).agg(best).select(*keys, "best.r.*", F.col(f"best.{stamp}"))
    best = F.max(F.struct(*order)).alias("best")
    return kept.groupBy(*keys).agg(best).select(*keys, "best.*")


def _all_there(keys: list[str]) -> Column:
    cond = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        cond = cond & F.col(k).isNotNull()
    return cond


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests, one machine) a local folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="declarium-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL[app] = "file://" + folder
    return _LOCAL[app]


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    The table stays until ``release``, as plans that are not run yet may read it.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that ``materialize`` wrote in this application, once the queries that read them have run; gives their number."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        target = make(p)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)
