"""Unified diffs: files named, references introduced, masks that keep the marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritmill.functions import masking as M


def diff_paths(diff: Column) -> Column:
    """Paths that a diff names, each once, in order; /dev/null and null diffs give none."""
    heads = F.filter(F.split(F.coalesce(diff, F.lit("")), "\n"), lambda s: s.rlike(r"^(?:\+\+\+ |--- |diff --git )"))
    named = F.transform(heads, lambda s: F.regexp_extract(s, r"^(?:\+\+\+ |--- |diff --git \S+ )(?:[ab]/)?(\S+)", 1))
    return F.array_distinct(F.filter(named, lambda p: (p != "") & (p != "/dev/null")))


def introduced(after: DataFrame, before: DataFrame, columns: list[str]) -> DataFrame:
    """Occurrences of rows in ``after`` beyond those in ``before``: a multiset difference."""
    return after.select(*columns).exceptAll(before.select(*columns))


_HEAD = r"^(?:\+\+\+ |--- |@@[^@]*@@)"


def masked_diff(diff: Column) -> Column:
    """A diff with the text of its lines masked; marks, headers and the number of lines stay. Lines of a private key are masked one by one."""

    def one(state: Column, line: Column) -> Column:
        begins, ends = line.rlike("-{5}BEGIN [A-Z ]*PRIVATE KEY-{5}"), line.rlike("-{5}END [A-Z ]*PRIVATE KEY-{5}")
        mark = F.when(line.rlike(_HEAD), F.regexp_extract(line, _HEAD, 0)).otherwise(F.regexp_extract(line, r"^[+\- ]?", 0))
        text = F.substring(line, F.length(mark) + 1, F.length(line))
        shown = F.when(state["key"] | begins | ends, F.lit("[REDACTED-PRIVATE-KEY]")).otherwise(M.masked(text))
        return F.struct(F.concat(state["lines"], F.array(F.concat(mark, shown))).alias("lines"), ((state["key"] | begins) & ~ends).alias("key"))

    plain = F.array_join(F.transform(F.split(diff, "\n"), lambda line: one(F.struct(F.array().cast("array<string>").alias("lines"), F.lit(False).alias("key")), line)["lines"][0]), "\n")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(False).alias("key"))
    keyed = F.aggregate(F.split(diff, "\n"), start, one, lambda s: F.array_join(s["lines"], "\n"))
    return F.when(diff.rlike("PRIVATE KEY-{5}"), keyed).otherwise(plain)  # carrying the state along costs time by the square of the lines
