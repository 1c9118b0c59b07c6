"""Lists of repositories to scan and baselines of earlier findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The names a manifest's columns may have, in lower case.
COLUMNS = {
    "app_id": ("appid", "application_id", "app_id", "applicationid"),
    "repo_name": ("reponame", "repository_name", "repo_name", "repo"),
    "path": ("path", "url", "repo_url", "ref"),
    "baseline": ("baseline", "baseline_path", "baseline_file"),
}
FINDING = "id string, file string, line_start bigint, line_end bigint, vuln_class string, cwe string, severity string, title string"


def _checked(rows: DataFrame) -> DataFrame:
    """Entries with the first thing wrong about each in ``error``: a blank field or a path that an earlier line has."""
    blank = (F.col("app_id") == "") | (F.col("repo_name") == "") | (F.col("path") == "")
    first = rows.where(~blank).groupBy("path").agg(F.min("line").alias("_first"))
    error = F.when(F.col("bad"), "fields").when(blank, "blank").when(F.col("_first") < F.col("line"), "duplicate")
    return rows.join(first, "path", "left").select("line", "app_id", "repo_name", "path", "baseline", error.alias("error"))


def text_manifest(lines: DataFrame) -> DataFrame:
    """Entries of lines (line, value) ``app,repo,path[,baseline]``; blank lines and remarks are none."""
    t = F.trim("value")
    f = F.transform(F.split(t, ","), lambda x: F.trim(x))
    at = lambda i: F.coalesce(F.get(f, F.lit(i)), F.lit(""))
    kept = lines.where((t != "") & ~F.startswith(t, F.lit("#")))
    return _checked(kept.select("line", at(0).alias("app_id"), at(1).alias("repo_name"), at(2).alias("path"), at(3).alias("baseline"), (~F.size(f).isin(3, 4)).alias("bad")))


def table_manifest(rows: DataFrame) -> DataFrame:
    """Entries of a table with a column ``line`` and columns under any of the names known; rows blank in all three fields are none."""
    by_name = {c.strip().lower(): c for c in reversed(rows.columns)}
    found = {name: next((by_name[a] for a in names if a in by_name), None) for name, names in COLUMNS.items()}
    missing = [n for n in ("app_id", "repo_name", "path") if found[n] is None]
    if missing:
        raise ValueError(f"the manifest has no column for {', '.join(missing)}")
    cell = lambda n: (F.coalesce(F.trim(F.col(f"`{found[n]}`").cast("string")), F.lit("")) if found[n] else F.lit("")).alias(n)
    e = rows.select("line", *[cell(n) for n in COLUMNS], F.lit(False).alias("bad"))
    return _checked(e.where(F.concat("app_id", "repo_name", "path") != ""))


def entries(checked: DataFrame) -> DataFrame:
    """The entries of a sound manifest; an error in any line stops the query."""
    wrong = F.raise_error(F.concat(F.lit("manifest line "), F.col("line").cast("string"), F.lit(": "), F.col("error")))
    return checked.withColumn("app_id", F.when(F.col("error").isNull(), F.col("app_id")).otherwise(wrong.cast("string"))).drop("error")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest file: CSV with a header by its ending, else lines of text. It is one small file, whose lines are numbered in file order."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "^\ufeff", ""), "\r?\n")).alias("line", "value"))
    lines = whole.select((F.col("line") + 1).cast("bigint").alias("line"), "value")
    if not path.lower().endswith(".csv"):
        return entries(text_manifest(lines))
    head = lines.where("line = 1").first()
    names = [n.strip() for n in (head["value"] if head else "").split(",")]
    ddl = ", ".join(f"`{n or f'_c{i}'}` string" for i, n in enumerate(names))
    row = F.from_csv("value", F.lit(ddl), {"escape": '"'})
    return entries(table_manifest(lines.where("line > 1 AND trim(value) <> ''").select("line", row.alias("r")).select("line", "r.*")))


def revision(provenance: Column) -> Column:
    """The first revision that is not blank of an array of runs, each with its ``versionControlProvenance``."""
    ids = F.transform(provenance, lambda run: F.get(run["versionControlProvenance"], F.lit(0))["revisionId"])
    return F.get(F.filter(ids, lambda r: F.trim(r) != ""), F.lit(0))


def baseline_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The findings of baseline documents with their commit; a document with neither ``findings`` nor ``runs`` stops the query.

    Documents with runs are left to the SARIF reader, which names their results; here they give their revision only.
    """
    doc = F.from_json(text_col, f"commit_sha string, findings array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in FINDING.split(','))}>>, runs array<struct<versionControlProvenance: array<struct<revisionId: string>>>>")
    d = docs.select("*", doc.alias("_d"))
    known = F.col("_d.runs").isNotNull() | F.col("_d.findings").isNotNull()
    kind = F.when(F.col("_d.runs").isNotNull(), "sarif").when(known, "findings").otherwise(F.raise_error(F.lit("a baseline has neither runs nor findings")).cast("string"))
    commit = F.when(F.col("_d.runs").isNotNull(), revision(F.col("_d.runs"))).otherwise(F.nullif(F.trim("_d.commit_sha"), F.lit("")))
    return d.select(*docs.columns, kind.alias("kind"), commit.alias("commit"), F.col("_d.findings").alias("findings")).drop(text_col)
