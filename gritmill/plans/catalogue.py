"""All registries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gritmill.plans import finding_queries, nested_queries, report_queries, rule_queries, table_queries


def core_registries():
    return [finding_queries.R, table_queries.R, report_queries.R, nested_queries.R, rule_queries.R]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding_queries.R.queries["finding_lifecycle"](spark, sf_dir)
