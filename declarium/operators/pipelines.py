"""Pipelines of items: what flows between stages, defining, checking, and running them over DataFrames."""

from __future__ import annotations

import importlib.util
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from declarium.operators import nested, validate
from declarium.sources import columns, latest


def from_documents(index_docs: DataFrame) -> DataFrame:
    """(index_id, project, name, stages array<int>) of the pipelines in index documents; other stages are left out."""
    docs = latest(columns(index_docs, "index_id", "project", "loaded_at"), ["index_id"], "loaded_at").select("index_id", "project")
    found = nested.nodes(index_docs).where("type = 'pipeline'").select("index_id", "name", F.from_json("value", "array<string>").alias("s"))
    stages = F.filter(F.transform("s", lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return found.join(docs, "index_id").select("index_id", "project", "name", stages.alias("stages"))


def direct_edges(pipelines: DataFrame, catalog: DataFrame) -> DataFrame:
    """(project, name, after, from_key, to_key): results that the next stage's only needed parameter takes.

    A stage follows directly if its single needed parameter has the type that the one before returns;
    the result then moves from that stage's return key to the parameter's key, unless both are one.
    """
    held = validate.stages(pipelines, catalog)
    w = Window.partitionBy("project", "name").orderBy("pos")
    seen = held.select("*", F.lag("returns").over(w).alias("before"), F.lag("return_key").over(w).alias("from_key"), F.lag("ordinal").over(w).alias("after"))
    param = F.col("required_names")[0]
    to = F.regexp_replace(F.coalesce(F.col("param_map")[param], param), r"^ctx\.", "")
    direct = seen.where((F.size("required") == 1) & (F.col("required")[0] == F.col("before")) & F.col("from_key").isNotNull())
    return direct.select("project", "name", "after", "from_key", to.alias("to_key")).where("from_key <> to_key")


def define(pipelines: DataFrame, project: str, name: str, stages: list[int], catalog: DataFrame) -> DataFrame:
    """``pipelines`` with one more; raises if it is invalid, and then nothing has changed."""
    spark = catalog.sparkSession
    new = spark.createDataFrame([(project, name, stages)], "project string, name string, stages array<int>")
    wrong = validate.pipeline_stages(new, catalog).limit(20).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.subject}: {r.message}" for r in wrong))
    kept = columns(pipelines, "project", "name", "stages").where(~((F.col("project") == project) & (F.col("name") == name)))
    return kept.unionByName(new)


Stage = Callable[[DataFrame], DataFrame]
_CALLABLES: dict[str, Stage] = {}


def callable_item(address: str) -> Callable[[Stage], Stage]:
    """Registers the trusted function of an address: it adds its return key to a context DataFrame.

    Nothing is imported from the catalog's files; only registered functions run.
    """

    def add(f: Stage) -> Stage:
        _CALLABLES[address] = f
        return f

    return add


def run(ctx: DataFrame, stages: list[tuple[int, str]], edges: list[tuple[int, str, str]]) -> DataFrame:
    """Runs stages (ordinal, address) over a context whose keys are columns, in one plan.

    After a stage, its edges (after, from_key, to_key) copy columns before the next one runs.
    """
    for i, (_, address) in enumerate(stages):
        if address not in _CALLABLES:
            raise KeyError(f"no registered function for {address}")
        if i:
            for after, source, target in edges:
                if after == stages[i - 1][0] and source in ctx.columns:
                    ctx = ctx.withColumn(target, F.col(source))
        ctx = ctx.transform(_CALLABLES[address])
    return ctx


def call(item: dict, root: str, ctx: dict) -> dict:
    """Calls a module-level Python function of a catalog, on the driver, with what its parameters map to in ``ctx``.

    ``item`` is an item of a catalog document. The result stands under its return key; a missing needed
    value, another kind or another language is an error.
    """
    if item["language"] != "python" or item["kind"] != "function":
        raise ValueError(f"{item['address']}: only module-level Python functions can be called")
    given = {}
    for p in item["signature"]["params"]:
        if p["kind"] in ("variadic", "kwvariadic", "receiver"):
            continue
        key = (item["ctx_adapter"]["param_map"].get(p["name"]) or p["name"]).removeprefix("ctx.")
        if key in ctx:
            given[p["name"]] = ctx[key]
        elif p.get("default") is None:
            raise ValueError(f"{item['address']}: ctx lacks {key!r}")
    path = os.path.join(root, item["file"])
    spec = importlib.util.spec_from_file_location("_" + re.sub(r"\W", "_", item["file"]), path)
    if spec is None or spec.loader is None or not os.path.exists(path):
        raise ValueError(f"{item['address']}: no file {path}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    result = getattr(module, item["name"])(**given)
    key = item["ctx_adapter"].get("return_key")
    return {**ctx, key: result} if key else dict(ctx)


def run_items(items: list[dict], edges: list[dict], root: str, ctx: dict) -> dict:
    """Calls items one after another; after a stage its edges move results to the keys that the next one reads."""
    for n, item in enumerate(items):
        if n:
            for e in edges:
                if e["after"] == items[n - 1]["ordinal"] and e["from_key"] in ctx:
                    ctx = {**ctx, e["to_key"]: ctx[e["from_key"]]}
        ctx = call(item, root, ctx)
    return ctx
