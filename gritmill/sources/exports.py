"""Readers of scanner exports: JSON documents (one per row) to the columns of a finding.

All give: vendor, external_id, title, file, line_start, line_end, cwe, severity,
description, component. A damaged document gives no rows; absent fields are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OUT = ["vendor", "external_id", "title", "file", "line_start", "line_end", "cwe", "severity", "description", "component"]


def _v(c: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(c), path, kind)


def _doc(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.try_parse_json(text_col).alias("doc")).where(F.col("doc").isNotNull())


def _items(df: DataFrame, path: str) -> DataFrame:
    return df.select("doc", F.posexplode(_v("doc", path, "array<variant>")).alias("pos", "r"))


def _one_or_first(path: str) -> Column:
    return F.coalesce(F.try_variant_get("r", path + "[0]", "string"), F.try_variant_get("r", path, "string"))


def _missing(*names: str) -> list[Column]:
    return [F.lit(None).cast("string").alias(n) for n in names]


def read_semgrep(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``results[]``; ignored ones dropped; the first weakness of one or many; id check:path:position."""
    r = _items(_doc(df, text_col), "$.results").where(~F.coalesce(_v("r", "$.extra.is_ignored", "boolean"), F.lit(False)))
    return r.select(
        F.lit("semgrep").alias("vendor"),
        F.concat_ws(":", _v("r", "$.check_id"), _v("r", "$.path"), F.col("pos").cast("string")).alias("external_id"),
        _v("r", "$.check_id").alias("title"), _v("r", "$.path").alias("file"),
        F.coalesce(_v("r", "$.start.line", "bigint"), F.lit(1)).alias("line_start"), F.coalesce(_v("r", "$.end.line", "bigint"), F.lit(1)).alias("line_end"),
        F.nullif(F.regexp_extract(_one_or_first("$.extra.metadata.cwe"), r"(CWE-\d+)", 1), F.lit("")).alias("cwe"),
        _v("r", "$.extra.severity").alias("severity"), _v("r", "$.extra.message").alias("description"), *_missing("component"),
    ).select(*_OUT)


def read_snyk(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A report or an array of them: ``vulnerabilities[]``; file or package@version; first weakness."""
    doc = _doc(df, text_col)
    reports = doc.select(F.explode(F.coalesce(_v("doc", "$", "array<variant>"), F.array("doc"))).alias("doc"))
    r = reports.select("doc", F.posexplode(_v("doc", "$.vulnerabilities", "array<variant>")).alias("pos", "r"))
    package = F.concat_ws("@", _v("r", "$.packageName"), _v("r", "$.version"))
    return r.select(
        F.lit("snyk").alias("vendor"), _v("r", "$.id").alias("external_id"), _v("r", "$.title").alias("title"),
        F.coalesce(_v("doc", "$.displayTargetFile"), package).alias("file"), F.lit(1).cast("bigint").alias("line_start"), F.lit(1).cast("bigint").alias("line_end"),
        _v("r", "$.identifiers.CWE[0]").alias("cwe"), _v("r", "$.severity").alias("severity"), _v("r", "$.description").alias("description"), package.alias("component"),
    ).select(*_OUT)


def read_aikido(df: DataFrame, text_col: str = "text", skipped: tuple[str, ...] = ("license", "eol")) -> DataFrame:
    """An array; skipped types removed in any case; file, else package, else title."""
    r = _items(_doc(df, text_col), "$").where(~F.coalesce(F.lower(_v("r", "$.type")).isin(*skipped), F.lit(False)))
    return r.select(
        F.lit("aikido").alias("vendor"), _v("r", "$.id").alias("external_id"), _v("r", "$.rule").alias("title"),
        F.coalesce(_v("r", "$.affected_file"), _v("r", "$.affected_package"), _v("r", "$.rule")).alias("file"),
        F.coalesce(_v("r", "$.start_line", "bigint"), F.lit(1)).alias("line_start"), F.coalesce(_v("r", "$.end_line", "bigint"), F.lit(1)).alias("line_end"),
        _v("r", "$.cwe_classes[0]").alias("cwe"), _v("r", "$.severity").alias("severity"), *_missing("description"), _v("r", "$.affected_package").alias("component"),
    ).select(*_OUT)


def read_sonatype(df: DataFrame, text_col: str = "text") -> DataFrame:
    """components x issues; not-applicable ones dropped; severity by its number."""
    c = _items(_doc(df, text_col), "$.components").select(F.col("r").alias("c"))
    r = c.select("c", F.explode(_v("c", "$.securityData.securityIssues", "array<variant>")).alias("r"))
    r = r.where(F.coalesce(F.lower(_v("r", "$.status")) != "not applicable", F.lit(True)))
    n = _v("r", "$.severity", "double")
    name = F.concat_ws(":", _v("c", "$.componentIdentifier.coordinates.groupId"), _v("c", "$.componentIdentifier.coordinates.artifactId"), _v("c", "$.componentIdentifier.coordinates.version"))
    return r.select(
        F.lit("sonatype").alias("vendor"), F.concat_ws(":", name, _v("r", "$.reference")).alias("external_id"), _v("r", "$.reference").alias("title"),
        F.coalesce(_v("c", "$.pathnames[0]"), _v("c", "$.packageUrl"), name).alias("file"), F.lit(1).cast("bigint").alias("line_start"), F.lit(1).cast("bigint").alias("line_end"),
        *_missing("cwe"), F.when(n >= 9, "critical").when(n >= 7, "high").when(n >= 4, "medium").when(n > 0, "low").otherwise("info").alias("severity"),
        _v("r", "$.threatCategory").alias("description"), name.alias("component"),
    ).select(*_OUT)


def read_sarif(df: DataFrame, text_col: str = "text") -> DataFrame:
    """runs -> results with the weakness of their rule; id rule:file:line."""
    runs = _items(_doc(df, text_col), "$.runs").select(F.col("r").alias("run"))
    r = runs.select("run", F.posexplode(_v("run", "$.results", "array<variant>")).alias("pos", "r"))
    rules = F.coalesce(_v("run", "$.tool.driver.rules", "array<variant>"), F.array().cast("array<variant>"))
    rule = F.get(F.filter(rules, lambda x: F.try_variant_get(x, "$.id", "string") == _v("r", "$.ruleId")), F.lit(0))
    file, line = _v("r", "$.locations[0].physicalLocation.artifactLocation.uri"), _v("r", "$.locations[0].physicalLocation.region.startLine", "bigint")
    return r.select(
        F.lit("sarif").alias("vendor"), F.concat_ws(":", _v("r", "$.ruleId"), file, line.cast("string")).alias("external_id"), _v("r", "$.ruleId").alias("title"),
        file.alias("file"), line.alias("line_start"), F.coalesce(_v("r", "$.locations[0].physicalLocation.region.endLine", "bigint"), line).alias("line_end"),
        F.try_variant_get(rule, "$.properties.cwe[0]", "string").alias("cwe"),
        F.when(_v("r", "$.level") == "error", "high").when(_v("r", "$.level") == "warning", "medium").otherwise("low").alias("severity"),
        _v("r", "$.message.text").alias("description"), *_missing("component"),
    ).select(*_OUT)


def read_checkmarx_xml(spark, path: str) -> DataFrame:
    """Query/Result/Path of an XML report; false positives dropped; the result's severity before the query's."""
    q = spark.read.format("xml").option("rowTag", "Query").load(path)
    r = q.select("_name", "_cweId", F.col("_Severity").alias("qsev"), F.explode("Result").alias("r"))
    r = r.where(~F.coalesce(F.lower(F.col("r._FalsePositive").cast("string")) == "true", F.lit(False)))
    return r.select(
        F.lit("checkmarx").alias("vendor"), F.coalesce(F.col("r.Path._SimilarityId").cast("string"), F.col("r._NodeId").cast("string")).alias("external_id"),
        F.col("_name").alias("title"), F.col("r._FileName").alias("file"), F.col("r._Line").cast("bigint").alias("line_start"), F.col("r._Line").cast("bigint").alias("line_end"),
        F.concat(F.lit("CWE-"), F.col("_cweId").cast("string")).alias("cwe"), F.lower(F.coalesce(F.col("r._Severity"), F.col("qsev"))).alias("severity"),
        *_missing("description", "component"),
    ).select(*_OUT)


def read_cmdb_csv(spark, path: str) -> DataFrame:
    """Application rows by normalized id; blank ids skipped; of equal ids the last line wins."""
    from gritmill.functions.text import app_id

    raw = spark.read.csv(path, header=True, comment="#", multiLine=True, escape='"')
    raw = raw.select([F.col(f"`{c}`").alias(c.strip("﻿ ").lower()) for c in raw.columns])
    if "id" not in raw.columns:
        raise ValueError("the file has no id column")
    kept = raw.where(F.trim("id") != "").withColumn("_at", F.monotonically_increasing_id()).withColumn("id", app_id(F.col("id")))
    names = [c for c in raw.columns if c != "id"]
    return kept.groupBy("id").agg(F.max_by(F.struct(*names), "_at").alias("v")).select("id", "v.*")


def diff_lines(df: DataFrame, id_col: str, diff_col: str) -> DataFrame:
    """Added lines of unified diffs: id, file, new-side line number."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(diff_col, "\n")).alias("pos", "line"))
    from pyspark.sql import Window as W

    w = W.partitionBy("id").orderBy("pos")
    head = F.col("line").rlike(r"^(?:\+\+\+ |--- |diff --git )")
    marked = lines.withColumns(
        {"file": F.last(F.nullif(F.regexp_extract("line", r"^\+\+\+ (?:b/)?(\S+)", 1), F.lit("")), True).over(w),
         "hunk": F.last(F.when(F.col("line").startswith("@@"), F.col("pos")).when(head, F.lit(-1)), True).over(w),
         "start": F.last(F.regexp_extract("line", r"^@@ -\S+ \+(\d+)", 1).try_cast("bigint"), True).over(w)}
    )
    body = marked.where((F.col("hunk") >= 0) & (F.col("pos") > F.col("hunk")))
    new_side = (~F.col("line").startswith("-")).cast("bigint")
    number = F.col("start") + F.sum(new_side).over(W.partitionBy("id", "hunk").orderBy("pos")) - 1
    return body.withColumn("n", number).where(F.col("line").startswith("+")).select("id", "file", F.col("n").alias("line"))
