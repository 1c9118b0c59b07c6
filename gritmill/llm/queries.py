"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritmill.llm.bpe import encode
from gritmill.llm.fusion import survivors, true_values
from gritmill.llm.handwritten import not_handwritten, with_origin
from gritmill.llm.packing import packed
from gritmill.llm.secrets import redacted_excerpts, secret_cases
from gritmill.llm.stuffing import page_shapes, stuffed_pages
from gritmill.plans.registry import Registry
from gritmill.tables import table

R = Registry()


@R.query("p5_ids")
def p5_ids(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), "text", ["doc_id"])


@R.query("p1_found")
def p1_found(spark, sf_dir):
    return secret_cases(table(spark, sf_dir, "validation_raw"), table(spark, sf_dir, "sinks"), table(spark, sf_dir, "cited_operations"))


@R.query("p1_redacted")
def p1_redacted(spark, sf_dir):
    """Every excerpt of evidence, sinks and cited operations, masked."""
    return redacted_excerpts(table(spark, sf_dir, "validation_raw"), table(spark, sf_dir, "sinks"), table(spark, sf_dir, "cited_operations"))


@R.query("p2_found")
def p2_found(spark, sf_dir):
    """The rows the model lets survive, less those that an exact check finds beaten in completeness, trust or time."""
    found = survivors(table(spark, sf_dir, "thirdparty_findings"), table(spark, sf_dir, "feed_trust"))
    return found.where("dominates").select("dup_group", "field_name", "row_id")


@R.query("p2_true_values")
def p2_true_values(spark, sf_dir):
    found = true_values(table(spark, sf_dir, "thirdparty_findings"), table(spark, sf_dir, "feed_trust"))
    return found.select("dup_group", "field_name", "value", F.round("truth", 6).alias("truth"))


@R.query("p4_found")
def p4_found(spark, sf_dir):
    return not_handwritten(table(spark, sf_dir, "scan_coverage"), ["scan_id", "path"])


@R.query("p4_origins")
def p4_origins(spark, sf_dir):
    """Files by origin for every tenant."""
    rows = with_origin(table(spark, sf_dir, "scan_coverage"), ["tenant_id", "scan_id", "path"]).distinct()
    return rows.groupBy("tenant_id", "origin").agg(F.count("*").alias("files"))


@R.query("p6_packed")
def p6_packed(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "context_windows"))


@R.query("p7_found")
def p7_found(spark, sf_dir):
    return stuffed_pages(table(spark, sf_dir, "documents"))


@R.query("p7_shapes")
def p7_shapes(spark, sf_dir):
    return page_shapes(table(spark, sf_dir, "documents"))
