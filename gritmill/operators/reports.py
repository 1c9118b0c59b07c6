"""Report sinks: SARIF, JSON, CSV and Markdown rows, and their writers. Every writer masks sensitive text first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritmill.functions import masking as M
from gritmill.functions import severity as S
from gritmill.functions import text as X


def mask_tree(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """All string leaves masked, in structs, arrays and map values too; ``keys`` are our own numbers and stay, or rows could not be told apart."""

    def leaf(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return M.masked(c)
        if not _has_text(kind):
            return c
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: leaf(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: leaf(v, kind.valueType))
        return F.when(c.isNotNull(), F.struct(*[leaf(c[f.name], f.dataType).alias(f.name) for f in kind]))

    return df.select(*[(F.col(f"`{f.name}`") if f.name in keys else leaf(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in df.schema])


def _has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_text(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_text(f.dataType) for f in kind)
    return isinstance(kind, T.StringType)


def sarif_results(f: DataFrame) -> DataFrame:
    """One SARIF result per finding as JSON: rule, level, message, location, fingerprints; the free text is masked."""
    f = f.withColumns({"title": M.masked(F.col("title")), "file": M.masked(F.col("file"))})
    region = F.struct(F.col("line_start").alias("startLine"), F.greatest("line_start", "line_end").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    prints = F.struct(
        X.fingerprint(F.col("vuln_class"), F.col("file"), X.collapsed(F.col("title"))).alias("findingId/v1"), X.fingerprint(F.col("file"), X.collapsed(F.col("title"))).alias("findingId/v2")
    )
    result = F.struct(
        F.col("vuln_class").alias("ruleId"), S.sarif_level(F.col("severity")).alias("level"), F.struct(F.col("title").alias("text")).alias("message"),
        F.array(place).alias("locations"), prints.alias("partialFingerprints"),
    )
    return f.select("id", F.to_json(result).alias("result"))


def with_absent(results: DataFrame, absent: DataFrame) -> DataFrame:
    """Results with the baseline's unmatched rows appended in state absent."""
    return results.withColumn("state", F.lit("present")).unionByName(absent.withColumn("state", F.lit("absent")))


def csv_lines(f: DataFrame, columns: list[str], keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows as CSV lines; only fields with a comma, quote or line end are quoted."""
    f = mask_tree(f.select(*columns), keys)
    return f.select(F.concat_ws(",", *[X.csv_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]).alias("value"))


def write_csv(f: DataFrame, columns: list[str], path: str) -> None:
    """A folder of CSV files with the header in each, also when there are no rows."""
    mask_tree(f.select(*columns)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(f: DataFrame, path: str) -> None:
    mask_tree(f).write.mode("overwrite").json(path)


def markdown_rows(f: DataFrame, columns: list[str], keys: tuple[str, ...] = ("id",)) -> DataFrame:
    f = mask_tree(f.select(*columns), keys)
    cells = [X.md_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return f.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
