"""Choosing, searching and following items of any number of projects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declarium.functions import columns as C
from declarium.operators import catalog as K


def show(
    catalog: DataFrame,
    selector: str | None = None,
    group: str | None = None,
    sig_class: str | None = None,
    language: str | None = None,
    name: str | None = None,
    state: str | None = None,
    project: str | None = None,
) -> DataFrame:
    """Items by ordinals (``3-7,12``), exact address, or prefix, and by attributes.

    An address that some item of a project has selects only that item there; else the selector is a
    prefix of groups and addresses.
    """
    out = catalog
    for column, value in (("project", project), ("sig_class", sig_class), ("language", language), ("state_capture", state)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if group is not None:
        out = out.where((F.col("group_path") == group) | F.col("group_path").startswith(group + "."))
    if name is not None:
        out = out.where(C.glob(F.col("name"), name))
    if selector is None:
        return out
    chosen = C.parse_selector(selector)
    if isinstance(chosen, list):
        cond = F.lit(False)
        for a, b in chosen:
            cond = cond | F.col("ordinal").between(a, b)
        return out.where(cond)
    exact = out.where(F.col("address") == chosen)
    loose = out.where((F.col("group_path") == chosen) | F.col("group_path").startswith(chosen + ".") | F.col("address").startswith(chosen + "."))
    return exact.unionByName(loose.join(exact.select("project").distinct(), "project", "left_anti"))


def merged(raw: DataFrame, keep: Callable[[DataFrame], DataFrame], *wanted: str) -> DataFrame:
    """The items, one row each, that ``keep`` chooses: their latest delivery decides.

    Where a filter is not on the key, a delivery that passes it may be out of date. So the keys of all
    rows that pass are found first, which lets the filter reach the scan; only those items' deliveries
    are merged, and then filtered again.
    """
    keys = keep(raw).select("project", "ordinal").where("project IS NOT NULL AND ordinal IS NOT NULL").distinct()
    return keep(K.items(raw.join(keys, ["project", "ordinal"], "left_semi"), *wanted))


def search(catalog: DataFrame, query: str, limit: int = 25, sig_class: str | None = None, language: str | None = None) -> DataFrame:
    """(score, project, ordinal, address, name) of the best hits: by score, project and address.

    One scan with a top-k per task; nothing is shuffled but the best rows.
    """
    for column, value in (("sig_class", sig_class), ("language", language)):
        if value is not None:
            catalog = catalog.where(F.col(column) == value)
    scored = catalog.withColumn("score", C.search_score(query)).where("score > 0")
    return scored.select("score", "project", "ordinal", "address", "name").orderBy(F.desc("score"), "project", "address", "ordinal").limit(limit)


def forward(catalog: DataFrame) -> DataFrame:
    """(project, caller, pos, callee, is_external): what each item calls."""
    return K.call_edges(catalog).select("project", "caller", "pos", "callee", "is_external")


def reverse(catalog: DataFrame) -> DataFrame:
    """(project, address, caller, caller_ordinal): who calls each item of the catalog."""
    edges = K.call_edges(catalog).where("NOT is_external").select("project", F.col("callee").alias("address"), "caller", F.col("ordinal").alias("caller_ordinal")).distinct()
    return edges.join(catalog.select("project", "address").distinct(), ["project", "address"], "left_semi").select("project", "address", "caller", "caller_ordinal")


def callers(catalog: DataFrame) -> DataFrame:
    """(project, callee, callers): the number of different callers of each address inside the catalog."""
    return K.call_edges(catalog).where("NOT is_external").groupBy("project", "callee").agg(F.count_distinct("caller").alias("callers"))


def caller_sets(catalog: DataFrame) -> DataFrame:
    """(project, callee, callers array<string>): who calls each address, by name.

    A set is as long as its address has callers; where that may be millions, ``reverse`` has them as rows.
    """
    return K.call_edges(catalog).where("NOT is_external").groupBy("project", "callee").agg(F.array_sort(F.collect_set("caller")).alias("callers"))


def resolve(catalog: DataFrame, project: str, selector: str) -> DataFrame:
    """The one item of a project that an ordinal or an address names, or none."""
    named = F.col("ordinal") == int(selector) if selector.strip().isdigit() else F.col("address") == selector
    return catalog.where((F.col("project") == project) & named).limit(1)


def line() -> Column:
    """An item on one line: ordinal, address, class, language, kind, state, trait, documentation."""
    held = F.format_string("[%s/%s/%s→%s]", "language", "kind", "state_capture", C.trait(F.col("state_capture")))
    doc = F.when(F.length("doc") > 0, F.concat(F.lit("  — "), "doc")).otherwise("")
    return F.concat(F.lpad(F.col("ordinal").cast("string"), 5, " "), F.lit("  "), "address", F.lit("  "), "sig_class", F.lit("  "), held, doc)


def needs_lines() -> Column:
    """What an item calls and needs, a line for each that it has."""
    shown = [("calls", "deps.calls"), ("packages", "deps.external_packages"), ("env", "deps.env_vars"), ("ctx requires", "deps.ctx_keys_required")]
    lines = F.array(*[F.when(F.size(C.list_of(F.col(c))) > 0, F.concat(F.lit(f"       {label}: "), F.array_join(c, ", "))) for label, c in shown])
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
