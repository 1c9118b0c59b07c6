"""Joins that bring reported names back to the repository: scope, chunks, threats, hops, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve_scope(reported: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is a file, or one file less its top folder; ``resolved`` is that file, other rows leave.

    Files offer their path and their path without the first folder, so both ways are one
    equi-join; a short path that several folders have is ambiguous and leaves.
    """
    f = files.select(F.col("path").alias("resolved")).distinct()
    short = f.where(F.contains("resolved", F.lit("/"))).select(F.regexp_replace("resolved", "^[^/]+/", "").alias(path), "resolved")
    below = short.groupBy(path).agg(F.min("resolved").alias("one"), F.count("*").alias("n")).where("n = 1").select(path, "one")
    exact = f.select(F.col("resolved").alias(path), F.col("resolved").alias("exact"))
    j = reported.join(exact, path, "left").join(below, path, "left")
    return j.withColumn("resolved", F.coalesce("exact", "one")).where("resolved IS NOT NULL").drop("exact", "one")


def chunk_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (chunk, pos, path) of chunks less unknown paths and later repeats, numbered anew; a chunk left empty has no row."""
    first = chunks.join(files.select("path").distinct(), "path", "left_semi").groupBy("chunk", "path").agg(F.min("pos").alias("pos"))
    return first.withColumn("pos", F.row_number().over(W.partitionBy("chunk").orderBy("pos", "path")).cast("bigint"))


def threats_of(functions: DataFrame, threats: DataFrame) -> DataFrame:
    """Per function, the first threat whose surface has its name, else the first that shares a word with it; null if none.

    Threats are reduced to the first of every word before the join, so a common word costs one row.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    t = threats.where(F.coalesce(F.col("surface"), F.lit("")) != "")
    by_name = t.groupBy(F.lower("surface").alias("name")).agg(F.min_by("threat", "ord").alias("exact"))
    by_word = t.select("threat", "ord", F.explode(words(F.col("surface"))).alias("word")).groupBy("word").agg(F.min(F.struct("ord", "threat")).alias("first"))
    f = functions.select("function").distinct()
    shared = f.select("function", F.explode(words(F.col("function"))).alias("word")).join(by_word, "word").groupBy("function").agg(F.min("first").alias("first"))
    j = f.join(by_name, F.lower(f["function"]) == by_name["name"], "left").drop("name").join(shared, "function", "left")
    return j.select("function", F.coalesce("exact", "first.threat").alias("threat"))


def hop_files(candidates: DataFrame, anchors: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` candidates of every group: those that share most leading folders with an anchor of it, then by name.

    Anchors offer their leading paths and candidates look theirs up, longest match
    wins: an equi-join instead of all pairs. Ranks are limited before the shuffle.
    """
    parts = lambda c: F.split(c, "/")
    lead = lambda c: F.transform(F.sequence(F.lit(1), F.size(parts(c))), lambda i: F.array_join(F.slice(parts(c), F.lit(1), i), "/"))
    a = anchors.where(F.col("path") != "").select("grp", F.explode(lead(F.col("path"))).alias("lead")).distinct()
    c = candidates.select("grp", "path").distinct()
    depth = c.select("grp", "path", F.posexplode(lead(F.col("path"))).alias("at", "lead")).join(a, ["grp", "lead"]).groupBy("grp", "path").agg((F.max("at") + 1).alias("shared"))
    ranked = c.join(depth, ["grp", "path"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    k = F.row_number().over(W.partitionBy("grp").orderBy(F.desc("shared"), "path"))
    return ranked.withColumn("_k", k).where(F.col("_k") <= cap).drop("_k")


def merge_context(profiles: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Profiles with the facts found about them: an exposure only where there is none, flags that either has; a card number makes
    card scope, health data make personal data."""
    f = facts.select(key, F.col("exposure").alias("_e"), F.col("external").alias("_x"), F.col("data").alias("_d"))
    has = lambda *kinds: F.coalesce(F.arrays_overlap("_d", F.array(*[F.lit(k) for k in kinds])), F.lit(False))
    empty = F.coalesce(F.col("exposure"), F.lit("")) == ""
    flag = lambda name, found: (F.coalesce(F.col(name), F.lit(False)) | found).alias(name)
    return profiles.join(f, key, "left").select(
        key, F.when(empty, F.coalesce("_e", F.lit(""))).otherwise(F.col("exposure")).alias("exposure"),
        flag("external", empty & F.coalesce(F.col("_x"), F.lit(False))), flag("pci", has("pci", "pan")), flag("pan", has("pan")), flag("pii", has("pii", "phi")),
    )


def appended(into: DataFrame, found: DataFrame, key: str, name: str) -> DataFrame:
    """The rows of ``into`` and, of every name it lacks, the first found one."""
    new = found.join(into.select(key, name), [key, name], "left_anti")
    first = new.groupBy(key, name).agg(F.min_by(F.struct(*new.columns), "ord").alias("r")).select("r.*")
    return into.unionByName(first)


DECISIONS = ("false_positive", "accepted_risk", "wont_fix", "reopen")


def triage_error() -> Column:
    """The first rule a triage row breaks, null if it breaks none."""
    return (
        F.when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "decision")
        .when(F.length(F.trim(F.coalesce("reason", F.lit("")))) < 10, "reason")
        .when((F.col("decision") == "accepted_risk") & F.col("expires_at").isNull(), "expiry")
    )


def active_suppressions(triage: DataFrame, now: Column) -> DataFrame:
    """Findings whose latest standing decision suppresses them: not revoked, not expired, no reopening."""
    standing = triage.where(F.col("revoked_at").isNull())
    last = standing.groupBy("finding_id").agg(F.max_by(F.struct("decision", "expires_at"), F.struct("decided_at", "triage_id")).alias("d"))
    return last.where((F.col("d.decision") != "reopen") & (F.col("d.expires_at").isNull() | (F.col("d.expires_at") > now))).select("finding_id", "d.decision")
