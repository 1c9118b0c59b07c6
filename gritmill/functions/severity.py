"""CVSS 3.1 base and environmental scores, bands, levels and fix scores as expression trees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritmill.functions.text import lookup

# The weights of CVSS 3.1.
AV = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
AC = {"L": 0.77, "H": 0.44}
PR_UNCHANGED = {"N": 0.85, "L": 0.62, "H": 0.27}
PR_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.5}
UI = {"N": 0.85, "R": 0.62}
CIA = {"H": 0.56, "L": 0.22, "N": 0.0}
REQUIREMENT = {"H": 1.5, "L": 0.5, "M": 1.0}
VECTOR = r"AV:([NALP])/AC:([LH])/PR:([NLH])/UI:([NR])/S:([UC])/C:([HLN])/I:([HLN])/A:([HLN])"
TEMPORAL = 0.94 * 0.95
SEVERITIES = ("critical", "high", "medium", "low", "info")
# Weights of the gates, thresholds of the verdict.
GATE_WEIGHTS = {"root_cause": 0.43, "instance_coverage": 0.2467, "no_new_vulnerabilities": 0.1867, "security_best_practices": 0.1366}
FIXED_AT, PARTIAL_AT = 0.80, 0.50


def _pick(table: dict[str, float], letter: Column, default: float | None = None) -> Column:
    found = None
    for k, v in table.items():
        found = F.when(letter == k, v) if found is None else found.when(letter == k, v)
    return found if default is None else found.otherwise(default)


def roundup(x: Column) -> Column:
    n = (x * 100000.0).cast("bigint")
    return F.when(n % 10000 == 0, n.cast("double") / 100000.0).otherwise((F.floor(n / 10000).cast("double") + 1.0) / 10.0)


def _steps(df: DataFrame, vector: str) -> DataFrame:
    """The numbers of a vector as helper columns. Steps keep each expression small: the optimizer does not merge steps whose values are used twice."""
    m = df.withColumn("_m", F.regexp_extract(vector, VECTOR, 0))
    letter = lambda i: F.substring("_m", (4, 9, 14, 19, 23, 27, 31, 35)[i], 1)
    m = m.withColumn("_changed", letter(4) == "C")
    pr = F.when(F.col("_changed"), _pick(PR_CHANGED, letter(2))).otherwise(_pick(PR_UNCHANGED, letter(2)))
    return m.withColumns(
        {"_c": _pick(CIA, letter(5)), "_i": _pick(CIA, letter(6)), "_a": _pick(CIA, letter(7)), "_av": _pick(AV, letter(0)),
         "_ac": _pick(AC, letter(1)), "_pr": pr, "_ui": _pick(UI, letter(3))}
    )


_HELPERS = ["_m", "_changed", "_c", "_i", "_a", "_av", "_ac", "_pr", "_ui", "_iss", "_im", "_ex", "_bs", "_mb"]


def add_cvss(df: DataFrame, vector: str = "cvss_vector", out: str = "score") -> DataFrame:
    """Adds the base score of the first vector found in a column; null if there is none, 0 without impact."""
    s = _steps(df, vector).withColumn("_iss", F.lit(1.0) - (F.lit(1.0) - F.col("_c")) * (F.lit(1.0) - F.col("_i")) * (F.lit(1.0) - F.col("_a")))
    s = s.withColumns(
        {"_im": F.when(F.col("_changed"), F.lit(7.52) * (F.col("_iss") - 0.029) - F.lit(3.25) * F.pow(F.col("_iss") - 0.02, F.lit(15.0))).otherwise(F.lit(6.42) * F.col("_iss")),
         "_ex": F.lit(8.22) * F.col("_av") * F.col("_ac") * F.col("_pr") * F.col("_ui")}
    )
    s = s.withColumn("_bs", F.least(F.when(F.col("_changed"), F.lit(1.08) * (F.col("_im") + F.col("_ex"))).otherwise(F.col("_im") + F.col("_ex")), F.lit(10.0)))
    score = F.when(F.col("_m") != "", F.when(F.col("_im") <= 0, F.lit(0.0)).otherwise(roundup(F.col("_bs"))))
    return s.withColumn(out, score).drop(*_HELPERS)


def _weight(table: dict[str, float], letter: str | Column) -> Column:
    return _pick(table, letter, 1.0) if isinstance(letter, Column) else F.lit(table.get(letter, 1.0))


def add_environmental(df: DataFrame, mav: str | Column, cr: str | Column, ir: str | Column, ar: str | Column, vector: str = "cvss_vector", out: str = "env_score") -> DataFrame:
    """Adds the environmental score for a modified attack vector and three requirements, letters or columns of them, with the fixed temporal factor."""
    rc, ri, ra = (_weight(REQUIREMENT, x) for x in (cr, ir, ar))
    s = _steps(df, vector)
    miss = F.lit(1.0) - (F.lit(1.0) - rc * F.col("_c")) * (F.lit(1.0) - ri * F.col("_i")) * (F.lit(1.0) - ra * F.col("_a"))
    s = s.withColumn("_iss", F.least(miss, F.lit(0.915)))
    s = s.withColumns(
        {"_im": F.when(F.col("_changed"), F.lit(7.52) * (F.col("_iss") - 0.029) - F.lit(3.25) * F.pow(F.col("_iss") * 0.9731 - 0.02, F.lit(13.0))).otherwise(F.lit(6.42) * F.col("_iss")),
         "_ex": F.lit(8.22) * _weight(AV, mav) * F.col("_ac") * F.col("_pr") * F.col("_ui")}
    )
    s = s.withColumn("_bs", F.least(F.when(F.col("_changed"), F.lit(1.08) * (F.col("_im") + F.col("_ex"))).otherwise(F.col("_im") + F.col("_ex")), F.lit(10.0)))
    s = s.withColumn("_mb", roundup(F.col("_bs")))
    score = F.when(F.col("_m") != "", F.when(F.col("_im") <= 0, F.lit(0.0)).otherwise(roundup(F.col("_mb") * TEMPORAL)))
    return s.withColumn(out, score).drop(*_HELPERS)


def add_app_score(df: DataFrame, vector: str = "cvss_vector", out: str = "vsvs") -> DataFrame:
    """Adds the environmental score of an application with the flags ``external``, ``pci``, ``pan`` and ``pii``, null flags being false:
    an internal one is attacked from its network at most, card and personal data raise the requirements."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    high = lambda c: F.when(c, "H").otherwise("M")
    given = F.substring(F.regexp_extract(vector, VECTOR, 0), 4, 1)
    reach = F.when(~yes("external") & (given == "N"), "A").otherwise(given)
    return add_environmental(df, reach, high(yes("pci") | yes("pan") | yes("pii")), high(yes("pci") | yes("pan")), "M", vector, out)


def rating(score: Column) -> Column:
    return (
        F.when(score.isNull(), "Unknown").when(score == 0, "None").when(score < 4, "Low").when(score < 7, "Medium").when(score < 9, "High").otherwise("Critical")
    )


def severity_rank(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c).cast("int"), F.lit(6))


def final_severity(vsvs: Column, cvss: Column, label: Column) -> Column:
    """The band of the environmental score, else of the base score, else the label."""

    def band(score: Column) -> Column:
        return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").when(score == 0, "info")

    return F.coalesce(band(vsvs), band(cvss), label)


def sarif_level(c: Column) -> Column:
    return F.when(c.isin("critical", "high"), "error").when(c == "medium", "warning").otherwise("note")


def security_severity(severity: Column, score: Column) -> Column:
    fallback = lookup({"critical": 9.0, "high": 7.0, "medium": 4.0, "low": 0.1, "info": 0.0}, severity)
    return F.format_string("%.1f", F.when(score >= 0, score).otherwise(fallback))


def fix_score(gates: Column) -> Column:
    """Weighted mean of an ordered array of (name, status) over the gates that were not skipped, before rounding; null if all were."""
    weight = lambda g: lookup(GATE_WEIGHTS, g["name"])
    active = F.filter(gates, lambda g: g["status"] != "skip")
    earned = F.aggregate(active, F.lit(0.0), lambda acc, g: acc + weight(g) * F.when(g["status"] == "pass", 1.0).when(g["status"] == "partial", 0.5).otherwise(0.0))
    total = F.aggregate(active, F.lit(0.0), lambda acc, g: acc + weight(g))
    return F.when(F.size(active) > 0, F.least(earned / total, F.lit(1.0)))


@F.pandas_udf(T.DoubleType())
def round4_exact(values: pd.Series) -> pd.Series:
    """Four decimals by the exact binary value, half to even; the engine's own rounding goes by the shortest decimal form."""
    return values.map(lambda v: round(v, 4), na_action="ignore")
