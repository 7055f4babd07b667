"""What is missing in a catalog: dead items, keys nobody provides, unknown calls, near duplicates."""

from __future__ import annotations

import builtins

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from declarium.functions import columns as C
from declarium.operators import catalog as K

#: Names that need no definition: those that Python itself brings.
KNOWN_NAMES = sorted(n for n in dir(builtins))


def dead_items(catalog: DataFrame) -> DataFrame:
    """(project, ordinal, address, name): nobody calls it, no context key ties it, no entry point."""
    called = K.call_edges(catalog).where("NOT is_external").select("project", F.col("callee").alias("address")).distinct()
    edges = K.ctx_edges(catalog).select("project", "ordinal", "side", "key")
    given = edges.where("side = 'provides'").select("project", "key").distinct()
    needed = edges.where("side = 'requires'").select("project", "key").distinct()
    tied = edges.where("side = 'provides'").join(needed, ["project", "key"], "left_semi").unionByName(edges.where("side = 'requires'").join(given, ["project", "key"], "left_semi"))
    loose = catalog.where(~C.is_entry_point()).select("project", "ordinal", "address", "name")
    return loose.join(called, ["project", "address"], "left_anti").join(tied.select("project", "ordinal").distinct(), ["project", "ordinal"], "left_anti").select("project", "ordinal", "address", "name")


def unprovided_keys(catalog: DataFrame) -> DataFrame:
    """(project, key, ordinal, address, severity): keys that no item gives, at the first item that needs them."""
    edges = K.ctx_edges(catalog)
    given = edges.where("side = 'provides'").select("project", "key").distinct()
    needed = edges.where("side = 'requires'").join(given, ["project", "key"], "left_anti")
    first = needed.groupBy("project", "key").agg(F.min(F.struct("ordinal", "address")).alias("f"))
    severity = F.when(F.col("key").endswith("_result"), "high").otherwise("low")
    return first.select("project", "key", "f.ordinal", "f.address", severity.alias("severity"))


def unresolvable_calls(catalog: DataFrame) -> DataFrame:
    """(project, ordinal, address, call): bare names that are neither items, imports nor built in."""
    roots = catalog.select("project", F.explode(C.list_of(F.col("deps.imports"))).alias("i")).select("project", F.split_part(F.split_part("i", F.lit("."), F.lit(1)), F.lit("/"), F.lit(1)).alias("call"))
    packages = catalog.select("project", F.explode(C.list_of(F.col("deps.external_packages"))).alias("call"))
    known = roots.unionByName(packages).where("call IS NOT NULL").distinct()
    raw = K.call_edges(catalog).where("is_external").select("project", "ordinal", F.col("caller").alias("address"), F.expr("substr(callee, 10)").alias("call"))
    bare = raw.where(~F.contains("call", F.lit(".")) & ~F.col("call").isin(*KNOWN_NAMES))
    return bare.join(known, ["project", "call"], "left_anti").distinct().select("project", "ordinal", "address", "call")


def duplicate_buckets(catalog: DataFrame) -> DataFrame:
    """(project, sig_class, needs, items): signature classes with equal needs that two or more items share."""
    needs = F.array_join(K.keys("requires"), ",")
    return catalog.groupBy("project", "sig_class", needs.alias("needs")).agg(F.count("*").alias("items")).where("items >= 2")


def near_duplicates(catalog: DataFrame) -> DataFrame:
    """(project, sig_class, needs, ordinals array<int>, members array<string>): families that share a name word.

    Within a bucket each item, by ordinal, joins the first family one of whose members shares a word
    with it: an order-dependent rule, so a bucket is one group. Only ordinals, addresses and words of
    buckets of two or more reach it. Families of one are left out.
    """
    words = catalog.select("project", "ordinal", "address", "sig_class", F.array_join(K.keys("requires"), ",").alias("needs"), C.name_tokens(F.col("name")).alias("words"))
    held = words.where("sig_class IS NOT NULL").withColumn("n", F.count("*").over(Window.partitionBy("project", "sig_class", "needs"))).where("n >= 2").drop("n")

    def family(rows: pd.DataFrame) -> pd.DataFrame:
        by_word: dict[str, int] = {}  # first family of a word: an item joins the least over its words
        members: list[list[int]] = []
        rows = rows.sort_values(["ordinal", "address"], kind="stable").reset_index(drop=True)
        for i, found in enumerate(rows["words"]):
            home = min((by_word[w] for w in found if w in by_word), default=len(members))
            if home == len(members):
                members.append([])
            members[home].append(i)
            for w in found:
                by_word[w] = min(by_word.get(w, home), home)
        out = [(rows.project[0], rows.sig_class[0], rows.needs[0], sorted(int(rows.ordinal[i]) for i in m), sorted(rows.address[i] for i in m)) for m in members if len(m) > 1]
        return pd.DataFrame(out, columns=["project", "sig_class", "needs", "ordinals", "members"])

    return held.groupBy("project", "sig_class", "needs").applyInPandas(family, "project string, sig_class string, needs string, ordinals array<int>, members array<string>")


def gaps(catalog: DataFrame) -> DataFrame:
    """(project, kind, severity, address, ordinal, detail) of all kinds; filters on ``kind`` skip the others."""
    dead = dead_items(catalog).select("project", F.lit("dead_item").alias("kind"), F.lit("medium").alias("severity"), "address", "ordinal", F.concat("name", F.lit(": no in-index caller and no context edge")).alias("detail"))
    keys = unprovided_keys(catalog).select("project", F.lit("unprovided_ctx_key").alias("kind"), "severity", "address", "ordinal", F.col("key").alias("detail"))
    calls = unresolvable_calls(catalog).select("project", F.lit("unresolvable_call").alias("kind"), F.lit("medium").alias("severity"), "address", "ordinal", F.col("call").alias("detail"))
    near = near_duplicates(catalog).select("project", F.lit("near_duplicate").alias("kind"), F.lit("low").alias("severity"), F.lit("").alias("address"), F.col("ordinals")[0].alias("ordinal"), F.array_join("members", ", ").alias("detail"))
    return dead.unionByName(keys).unionByName(calls).unionByName(near)


KINDS = ("dead_item", "unprovided_ctx_key", "unresolvable_call", "near_duplicate")


def chosen(found: DataFrame, kind: str | None = None, least: str | None = None) -> DataFrame:
    """Gaps of one kind, or of a severity of at least ``least``; unknown names are errors."""
    if kind is not None and kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r} (known: {', '.join(KINDS)})")
    if least is not None and least not in C.SEVERITIES:
        raise ValueError(f"unknown severity {least!r} (known: {', '.join(C.SEVERITIES)})")
    out = found if kind is None else found.where(F.col("kind") == kind)
    return out if least is None else out.where(C.severity_rank(F.col("severity")) <= C.SEVERITIES[least])


def ranked(found: DataFrame) -> DataFrame:
    """Gaps by severity, kind and address; ties by project, ordinal and detail."""
    return found.orderBy(C.severity_rank(F.col("severity")), "kind", "address", "project", "ordinal", "detail")

