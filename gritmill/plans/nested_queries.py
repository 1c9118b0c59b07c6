"""Queries over nested records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritmill.operators.nested import REACH, SCORE, NestedTables, emit, nested_children
from gritmill.plans.registry import Registry
from gritmill.tables import table

R = Registry()


@R.query("p3_found")
def p3_found(spark, sf_dir):
    return nested_children(table(spark, sf_dir, "validation_raw"), table(spark, sf_dir, "context_raw"))


def _flat(spark, sf_dir, source: str, root, tag: str, fields: str, key: str, parent: str | None):
    """One flat table of the tagged rows of a payload, with its schema, its key and the link to its parent."""
    rows = NestedTables(NestedTables(emit(table(spark, sf_dir, source), (root,), "record_id")).distinct())
    flat = rows.table(tag, T.StructType([T.StructField(n, T.StringType()) for n in fields.split()]))
    links = [F.array_join("path", "/").alias(key), *([F.array_join("parent_path", "/").alias(parent)] if parent else [])]
    return flat.select("record_id", *links, *fields.split())


@R.query("p3_score_table")
def p3_score_table(spark, sf_dir):
    return _flat(spark, sf_dir, "validation_raw", SCORE, "score", "raw_score fix_status justification has_critical_failure", "score_path", None)


@R.query("p3_gate_table")
def p3_gate_table(spark, sf_dir):
    return _flat(spark, sf_dir, "validation_raw", SCORE, "gate", "gate_name status summary details confidence", "gate_path", "score_path")


@R.query("p3_evidence_table")
def p3_evidence_table(spark, sf_dir):
    return _flat(spark, sf_dir, "validation_raw", SCORE, "evidence", "file line snippet", "evidence_path", "gate_path")


@R.query("p3_reach_table")
def p3_reach_table(spark, sf_dir):
    return _flat(spark, sf_dir, "context_raw", REACH, "reach", "name kind authenticated via", "reach_path", None)
