"""The driver's star-schema tables seen as a catalog, so that graph operators meet dense graphs.

A part is an item; it calls the part of the order's next line if that has the greater key, so the calls
have no cycles. All order lines count, and all parts are one project, as a call joins any two of them. Keys
of the context come from the part's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from declarium.sources.tables import table

#: The projection, over the tables ``{p}lineitem`` and ``{p}part``.
ITEMS_SQL = """
lines AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM {p}lineitem),
steps AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lines a JOIN lines b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey < b.l_partkey),
parts AS (SELECT p_partkey AS k, 'proj' AS project, CAST(p_partkey AS INT) AS ordinal, replace(p_name, ' ', '_') AS name, concat(lower(replace(p_brand, '#', '')), '.m', p_size % 5) AS group_path, p_size FROM {p}part),
named AS (SELECT *, concat(group_path, '.', name, '_', k) AS address FROM parts)
"""


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Items with the columns that the catalog's operators read."""
    for name in ("part", "lineitem"):
        table(spark, folder, name).createOrReplaceTempView(f"declarium_{name}")
    return spark.sql(
        f"""WITH {ITEMS_SQL.format(p='declarium_')},
        called AS (SELECT src, array_sort(collect_set(n.address)) AS calls FROM steps JOIN named n ON n.k = dst GROUP BY src)
        SELECT project, ordinal, address, name, 'function' AS kind, 'python' AS language, concat(replace(group_path, '.', '/'), '.py') AS file, group_path,
          named_struct('requires', array(named_struct('key', concat('k', k % 97), 'value', 'i64')),
                       'provides', array(named_struct('key', concat('k', (k * 7 + 3) % 97), 'value', 'i64'))) AS ctx_adapter,
          named_struct('calls', coalesce(calls, CAST(array() AS array<string>)), 'imports', CAST(array() AS array<string>), 'external_packages', CAST(array() AS array<string>)) AS deps
        FROM named LEFT JOIN called ON src = k"""
    )


#: The common table expressions that the checking SQL builds on.
CHECK_SQL = """WITH {r} """ + ITEMS_SQL.format(p="").strip() + """,
called AS (SELECT src, list_sort(list(DISTINCT n.address)) AS calls FROM steps JOIN named n ON n.k = dst GROUP BY src),
one AS (SELECT project, ordinal, address, name, 'function' AS kind, 'python' AS language, concat(replace(group_path, '.', '/'), '.py') AS file, group_path,
  {{'requires': map {{concat('k', k % 97): 'i64'}}, 'provides': map {{concat('k', (k * 7 + 3) % 97): 'i64'}}}} AS ctx_adapter, {{'calls': coalesce(calls, []), 'imports': [], 'external_packages': []}} AS deps FROM named LEFT JOIN called ON src = k),
"""
