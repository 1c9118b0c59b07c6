"""The finding lifecycle: gates, verdicts, votes, duplicates, order and report rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritmill.functions import severity as S
from gritmill.functions import text as X
from gritmill.operators.ordering import LARGEST_GROUP, place_in_group
from gritmill.tables import Stage, shares

# Weaknesses that need no data flow, and words that tell of a secret.
POINT_CWES = [798, 259, 321, 256, 352, 1004, 614, 307, 778, 311, 312, 532, 209]
GENERIC_CWES = [20, 74, 200, 284, 285, 664, 682, 691, 693, 697, 703, 707, 710]
SECRET_TEXT = (
    r"(?i)\b(?:hard[\s-]?coded|password|passwd|api[_-]?key|access[_-]?key|secret[_-]?key|auth[_-]?token|bearer\s+token|jwt|private[_-]?key|"
    r"client[_-]?secret|credential)\b"
)


def point_of_occurrence(cls: Column, cwe: Column, text: Column) -> Column:
    return (cls == "info-leak") | F.coalesce(X.cwe_number(cwe).isin(POINT_CWES), F.lit(False)) | F.coalesce(text.rlike(SECRET_TEXT), F.lit(False))


def _has_text(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def gate_reason(min_confidence: float = 0.6, require_evidence: bool = True) -> Column:
    """The first gate a finding fails, null if it is kept; the cheap tests come first."""
    point = point_of_occurrence(F.col("vuln_class"), F.col("cwe"), F.col("title"))
    flow = _has_text(F.col("source_ref")) & _has_text(F.col("sink_ref"))
    reason = F.when(X.is_test_path(F.col("file")) & ~point, "excluded: test path").when(F.col("confidence") < min_confidence, "unconfirmed: confidence")
    return reason.when(~point & ~flow, "unconfirmed: evidence") if require_evidence else reason


def repair_paths(reported: DataFrame, valid: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds ``repaired``: the path itself if valid, else the only valid path that ends with it (or that it ends with) at a slash.

    Suffixes are joined by equality: every valid path offers its suffixes, so no
    pair is compared that does not match.
    """
    suffixes = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.call_function("substring_index", c, F.lit("/"), -i))
    v = valid.select(F.col("path").alias("valid")).distinct()
    wanted = reported.select(F.col(path_col).alias("wanted")).distinct()
    longer = v.select("valid", F.explode(suffixes(F.col("valid"))).alias("wanted")).join(wanted, "wanted")
    shorter = wanted.select("wanted", F.explode(suffixes(F.col("wanted"))).alias("valid")).join(v, "valid").select("valid", "wanted")
    hits = longer.unionByName(shorter).groupBy("wanted").agg(
        F.max(F.when(F.col("valid") == F.col("wanted"), F.col("valid"))).alias("exact"), F.min("valid").alias("first"), F.max("valid").alias("last")
    )
    unique = F.coalesce("exact", F.when(F.col("first") == F.col("last"), F.col("first")))
    return reported.join(hits.select(F.col("wanted").alias(path_col), unique.alias("repaired")), path_col, "left")


def verdict_class(verdict: Column, confidence: Column, least: int = 7) -> Column:
    return (
        F.when((verdict == "TRUE_POSITIVE") & (confidence >= least), "confirmed")
        .when(verdict == "TRUE_POSITIVE", "unconfirmed")
        .when(confidence == 0, "verify_error")
        .otherwise("false_positive")
    )


def parse_verdicts(replies: DataFrame, text_col: str) -> DataFrame:
    """Verdict, confidence 0..10, reason and CVSS vector of the last verdict line of each reply; the defaults if there is none."""
    line = r"(?i)verdict:[ \t]*(TRUE_POSITIVE|FALSE_POSITIVE)[ \t]*\|[ \t]*confidence:[ \t]*(\d+)[ \t]*\|[ \t]*reason:([^\n]*)"
    last = F.element_at(F.regexp_extract_all(text_col, F.lit(line), F.lit(0)), -1)
    one = lambda i: F.regexp_extract(last, line, i)
    return replies.select(
        "*",
        F.coalesce(F.upper(one(1)), F.lit("FALSE_POSITIVE")).alias("verdict"),
        F.coalesce(F.least(one(2).try_cast("bigint"), F.lit(10).cast("bigint")), F.lit(0).cast("bigint")).alias("verdict_confidence"),
        F.when(last.isNull(), "verifier output unparseable").when(F.trim(one(3)) == "", "(no reason given)").otherwise(F.trim(one(3))).alias("reason"),
        F.element_at(F.regexp_extract_all(text_col, F.lit(r"CVSS:3\.[01]/[A-Z:/]+"), F.lit(0)), -1).alias("cvss_found"),
    )


def same_bug(a: str, b: str, tolerance: int) -> Column:
    """The residual of the self-join on file: agreeing weaknesses, near or overlapping lines."""
    ca, cb = X.cwe_number(F.col(f"{a}.cwe")), X.cwe_number(F.col(f"{b}.cwe"))
    agrees = F.coalesce(ca == cb, F.lit(False)) | ((F.col(f"{a}.vuln_class") == F.col(f"{b}.vuln_class")) & (ca.isNull() | cb.isNull()))
    close = F.abs(F.col(f"{a}.line_start") - F.col(f"{b}.line_start")) <= tolerance
    overlap = (F.col(f"{a}.line_start") <= F.col(f"{b}.line_end")) & (F.col(f"{b}.line_start") <= F.col(f"{a}.line_end"))
    return agrees & (close | overlap)


def same_place(f: DataFrame) -> DataFrame:
    """One row per file, class, weakness and span: its least id (``ord``) and its members; the copies are counted map-side."""
    g = f.groupBy("file", "vuln_class", X.cwe_number(F.col("cwe")).alias("n"), "line_start", "line_end")
    return g.agg(F.min("id").alias("ord"), F.count("*").alias("members")).withColumn("cwe", F.col("n").cast("string"))


def with_class(rows: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the class of their keys; null keys match null keys."""
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return rows.alias("r").join(classes.alias("c"), on).select("r.*", *[f"c.{x}" for x in classes.columns if x not in keys])


def near_candidates(f: DataFrame, tolerance: int) -> DataFrame:
    """Links (id, earlier id) of findings that may be one bug: bucketed range join on file and line bucket.

    A finding lies in its bucket and offers itself to the buckets its span and the
    tolerance reach, so a file with very many findings is split by line.
    """
    width = max(tolerance, 1) * 4
    narrow = f.select("file", "ord", "cwe", "vuln_class", "line_start", "line_end", "members")
    home = narrow.withColumn("bucket", F.floor(F.col("line_start") / width))
    lo, hi = F.floor((F.col("line_start") - tolerance) / width), F.floor((F.greatest("line_end", F.col("line_start")) + tolerance) / width)
    reach = narrow.withColumn("bucket", F.explode(F.sequence(lo, hi)))
    pairs = home.alias("a").join(reach.alias("b"), ["file", "bucket"]).where((F.col("a.ord") != F.col("b.ord")) & same_bug("a", "b", tolerance))
    side = lambda x, y: F.when(F.col("a.ord") > F.col("b.ord"), F.col(f"{x}.members")).otherwise(F.col(f"{y}.members"))
    return pairs.select(
        F.greatest("a.ord", "b.ord").alias("later"), F.least("a.ord", "b.ord").alias("earlier"), side("a", "b").alias("later_members"), side("b", "a").alias("earlier_members")
    ).distinct()


def greedy_roots(items: pd.DataFrame, tolerance: int) -> list[int]:
    """First-root clustering of one file's findings in their order: not a transitive closure."""
    rows = list(items[["n", "vuln_class", "line_start", "line_end"]].itertuples(index=False))
    roots: list[int] = []
    heads: list[int] = []
    for j, (n, cls, start, end) in enumerate(rows):
        root = j
        for i in heads:
            m, other, s, e = rows[i]
            agrees = n == m and n >= 0 or other == cls and (n < 0 or m < 0)
            if agrees and (abs(start - s) <= tolerance or s <= end and start <= e):
                root = i
                break
        if root == j:
            heads.append(j)
        roots.append(root)
    return roots


def cluster_votes(f: DataFrame, tolerance: int = 10, threshold: int = 1, order: str = "id") -> DataFrame:
    """Clusters per file with the number of distinct runs that voted and the most confident member, the earliest on ties.

    Exact copies are counted in an aggregate first. Then the rows of a file come to
    one task sorted, and a stream keeps only the heads of the file at hand, so no
    group is held in memory.
    """
    once = f.groupBy("file", "vuln_class", F.coalesce(X.cwe_number(F.col("cwe")), F.lit(-1)).alias("n"), "line_start", "line_end").agg(
        F.array_sort(F.collect_set("run")).alias("runs"), F.min(F.struct("run", F.col(order))).alias("first"),
        F.min_by(order, F.struct((-F.col("confidence")).alias("c"), F.col("run"), F.col(order))).alias("best"),
        F.max("confidence").alias("confidence"), F.count("*").alias("members"),
    )
    flat = once.select("file", "vuln_class", "n", "line_start", "line_end", "runs", "best", "confidence", "members", F.col("first.run").alias("r"), F.col(f"first.{order}").alias("o"))
    names = ["file", "best", "votes", "members", "confidence"]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, heads = None, []
        for pdf in batches:
            out = []
            for file, cls, n, start, end, runs, best, confidence, members in pdf.itertuples(index=False, name=None):
                if file != at:
                    out += [(at, h[4], len(h[5]), h[6], h[7]) for h in heads]
                    at, heads = file, []
                for h in heads:
                    agrees = n == h[0] and n >= 0 or cls == h[1] and (n < 0 or h[0] < 0)
                    if agrees and (abs(start - h[2]) <= tolerance or h[2] <= end and start <= h[3]):
                        h[5].update(runs)
                        h[6] += members
                        if confidence > h[7]:
                            h[4], h[7] = best, confidence
                        break
                else:
                    heads.append([n, cls, start, end, best, set(runs), members, confidence])
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([(at, h[4], len(h[5]), h[6], h[7]) for h in heads], columns=names)

    sorted_rows = flat.repartition("file").sortWithinPartitions("file", "r", "o").drop("r", "o")
    voted = sorted_rows.mapInPandas(stream, "file string, best string, votes bigint, members bigint, confidence double")
    return voted.where(F.col("votes") >= threshold)


def canonical_order() -> list[Column]:
    """The ten sort keys of the stable canonical order."""
    sink_file = X.normalize_ref(F.regexp_replace(X.normalize_ref(F.col("sink_ref")), r":[^:]*$", ""))
    anchored = X.normalize_ref(F.col("source_ref")).isNotNull() & (sink_file == X.normalize_ref(F.col("file")))
    n = X.cwe_number(F.col("cwe"))
    return [
        F.when(F.coalesce(anchored, F.lit(False)), 0).otherwise(1).asc(), F.col("file").asc(), F.col("line_start").asc(), S.severity_rank(F.col("severity")).asc(),
        F.col("vuln_class").asc(), F.when(n.isNull(), 2).when(n.isin(GENERIC_CWES), 1).otherwise(0).asc(), F.coalesce(n, F.lit(4294967295)).asc(),
        F.col("verdict_confidence").desc(), F.col("confidence").desc(), F.col("title").asc(), F.col("id").asc(),
    ]


def tiered_match(current: DataFrame, baseline: DataFrame, tiers: list[str]) -> DataFrame:
    """One-to-one matches by equal keys, tier after tier: the k-th current row of a key takes the k-th baseline row of it.

    Both sides meet in one shuffle a tier, by shares of the keys; a pair (key, k) of two rows
    is a match, one of a single row goes on to the next tier, with what keys it has left.
    """
    stage = Stage(current.sparkSession)
    null = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    left = current.select(F.lit(False).alias("s"), "cur", null(baseline, "base"), *tiers)
    rows = left.unionByName(baseline.select(F.lit(True).alias("s"), null(current, "cur"), "base", *tiers))
    many, hits = rows.count(), []
    for i, t in enumerate(tiers):
        # no key has more rows than its hash of 65,536; so that is told without a shuffle of the keys
        most = rows.where(F.col(t).isNotNull()).groupBy(F.pmod(F.xxhash64(t), F.lit(1 << 16)).alias("h")).count().agg(F.max("count")).first()[0] or 0
        later, now = tiers[i + 1 :], []
        for share in shares(F.col(t), rows=many):
            mine = rows.where(F.col(t).isNotNull() & share)
            if most <= LARGEST_GROUP:
                mine = mine.repartition(t).withColumn("h", F.xxhash64(t)).withColumn("k", F.row_number().over(W.partitionBy("h", t, "s").orderBy("cur", "base")))
            else:
                mine = place_in_group(mine, [t, "s"], F.struct("cur", "base"), "k").withColumn("h", F.xxhash64(t))
            met = mine.groupBy("h", t, "k").agg((F.count("*") == 2).alias("both"), *[F.max(c).alias(c) for c in ("s", "cur", "base", *later)])
            out = met.select("both", "s", "cur", "base", *[F.when(~F.col("both"), F.col(c)).alias(c) for c in later])
            now.append(stage.write(out.where(reduce(Column.__or__, [F.col(c).isNotNull() for c in later], F.col("both"))), "met"))
            hits.append(now[-1].where("both").select("cur", "base", F.lit(t).alias("tier")))
        waiting = rows.where(F.col(t).isNull()).select("s", "cur", "base", *later)
        rows = reduce(DataFrame.unionByName, [n.where("NOT both").select("s", "cur", "base", *later) for n in now], waiting)
    return reduce(DataFrame.unionByName, hits)


def digest(f: DataFrame) -> DataFrame:
    """Counts by vendor, product, severity and class as rows (facet, value, n), in one pass of grouping sets."""
    sets = f.groupingSets([["vendor"], ["product"], ["sev"], ["vuln_class"]], "vendor", "product", "sev", "vuln_class")
    rows = sets.agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 7, "vendor").when(F.col("g") == 11, "product").when(F.col("g") == 13, "severity").otherwise("class")
    return rows.select(facet.alias("facet"), F.coalesce("vendor", "product", "sev", "vuln_class").alias("value"), "n")


def hotspots(f: DataFrame, k: int = 10) -> DataFrame:
    counted = f.where((F.col("product") != "dependency") & (F.trim("file") != "")).groupBy(X.top_level_dir(F.col("file")).alias("path")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "path").limit(k)


def lifecycle(f: DataFrame, k: int = 20) -> DataFrame:
    """Kept findings with score, band and final severity in report order, the first k."""
    kept = S.add_cvss(f.where(gate_reason().isNull()))
    final = S.final_severity(F.lit(None).cast("double"), F.col("score"), F.col("severity"))
    rows = kept.select("id", "file", "line_start", "vuln_class", "score", S.rating(F.col("score")).alias("rating"), final.alias("final_severity"))
    return rows.orderBy(S.severity_rank(F.col("final_severity")), "file", "line_start", "id").limit(k)
