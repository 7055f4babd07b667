"""Queries of this package's operators, by name; the SQL that DuckDB can check them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from declarium.llm import documented, leaks, parsing, provenance, quality, similar, terms, tokens
from declarium.sources import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return documented.found(table(spark, folder, "source_files"))


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return documented.pairs(table(spark, folder, "source_files"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar.found(table(spark, folder, "raw_decls"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return similar.classes(table(spark, folder, "raw_decls"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return terms.found(table(spark, folder, "items"))


def p3_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return terms.frequencies(table(spark, folder, "items"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.found(table(spark, folder, "source_files"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.report(table(spark, folder, "source_files"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.found(table(spark, folder, "source_files"))


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.rates(table(spark, folder, "source_files"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.found(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.outlierness(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_pairs": p1_pairs, "p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p3_frequencies": p3_frequencies, "p4_found": p4_found, "p4_report": p4_report, "p6_found": p6_found, "p6_rates": p6_rates, "p7_ids": p7_ids, "p8_found": p8_found, "p8_passages": p8_passages, "p9_found": p9_found, "p9_statistics": p9_statistics}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": similar.FOUND_SQL, "p2_classes": similar.CLASSES_SQL, "p8_found": leaks.FOUND_SQL, "p3_found": terms.FOUND_SQL, "p3_frequencies": terms.FREQUENCIES_SQL}
