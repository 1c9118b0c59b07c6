"""One surviving value per field of each group of duplicate records.

Claims are the usable values that rows of a group state for a field. A latent
two-sided quality model judges them: a source's *sensitivity* is how often it
states a value that is true, its *specificity* how often it leaves a false one
out, both found by expectation-maximisation together with the truth of every
claimed value. Sources are the feeds and three witnesses of every group: its most
complete, its most trusted and its most recent claims speak for their values as
a feed does, with a sensitivity and specificity of their own. Several values of a
field may be true; all of them are kept (``true_values``).

The likelihood of a claimed value depends only on which sources speak for it and
which feeds speak in its group without it, so the model runs over the counts of
those patterns, not over the claims. Up to ``DRIVER_PATTERNS`` of them are judged
on the driver, more by aggregates over the table of patterns; both give the same.

The survivor of a field is the row of the likeliest value: of its rows the most
complete, trusted and recent. ``dominates`` tells whether an exact check finds it at
least as complete, as trusted and as recent as all other claims of the group.

Defined results
---------------
* a null group is no group; a field without a usable value has no survivor;
* rows that tie in everything: the least row id survives;
* repeated rows change nothing (maxima and sets); an unknown or null feed has
  trust -1 and is a source of its own; a null time is older than any;
* an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritmill.tables import written

FIELDS = ("vendor", "severity", "cwe", "description")
ROUNDS = 12
# Patterns that are judged on the driver; a pattern is two short lists of source names.
DRIVER_PATTERNS = 1 << 16
WITNESSES = ("most complete", "most trusted", "most recent")
# Before the data speak: sensitivity and specificity of a feed and of a witness, worth so many observations.
FEED_PRIOR = (0.7, 0.8)
WITNESS_PRIOR = (0.98, 0.98)
PRIOR_WEIGHT = 10
LEAST, MOST = 0.01, 0.99

# The providers, severities and their other names.
PROVIDERS = ("semgrep", "snyk", "aikido", "sonatype", "checkmarx")
SEVERITIES = {
    "critical": "critical", "crit": "critical", "blocker": "critical", "severe": "critical",
    "high": "high", "major": "high", "important": "high",
    "medium": "medium", "moderate": "medium", "med": "medium",
    "low": "low", "minor": "low",
    "info": "info", "informational": "info", "information": "info", "note": "info", "none-severity": "info",
}
# Descriptions that say nothing.
_EMPTY = (
    r"^(?:|-+|n/?a|null|none|nil|undefined|unknown|tbd|todo|not set|\?+|\.+|see (?:title|above|link|portal|ticket)|siehe titel|voir titre|ver título|"
    r"(?:no )?description(?: (?:is )?(?:not available|unavailable|missing|pending))?|no description(?: provided| available| given)?|not provided|"
    r"\{\{.*\}\}|\$\{.*\}|<[^>]*>|keine (?:beschreibung|angabe)|sin descripción|sans description|sem descrição|нет описания|暂无描述|説明なし)[.!]?$"
)
_BOILERPLATE = (
    r"imported automatically|automatischer import|ohne beschreibung|same for every (?:imported )?item|licensed users only|open the portal of the provider|"
    r"einzelheiten stehen im portal|importé automatiquement|importado automáticamente"
)
_CUT = r"(?:\.\.\.|…|[\[(<](?:truncated|more|cut|snip|continued|gekürzt|suite|\.\.\.)[\])>]|read more|continue reading)\s*$"


def provider_name(c: Column) -> Column:
    found = F.regexp_extract(F.lower(c), r"(?:^|[^a-z])(" + "|".join(PROVIDERS) + r")(?![a-z])", 1)
    return F.when(found != "", found)


def severity_name(c: Column) -> Column:
    word = F.regexp_replace(F.lower(F.trim(c)), r"^(?:severity|sev|level|prio(?:rity)?)\s*[:=\-]?\s*|[\s.!]+$", "")
    named = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])[word]
    score = F.when(word.rlike(r"^\d{1,2}(?:\.\d+)?$"), word.try_cast("double"))
    by_score = (
        F.when(score > 10, None).when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").when(score == 0, "info")
    )
    return F.coalesce(named, by_score)


def weakness_number(c: Column) -> Column:
    found = F.regexp_extract(F.lower(F.trim(c)), r"^(?:cwe)?[\s:_\-#]*0*([1-9]\d{0,4})(?!\d)", 1)
    return F.when(found != "", found)


def plain_text(c: Column) -> Column:
    """Words of a text in lower case, without markup, marks and the word Title."""
    bare = F.regexp_replace(F.lower(c), r"<[^>]+>|^\s*(?:title|titel|titre|título)\s*:", " ")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def telling_description(description: Column, title: Column) -> Column:
    """A description's plain text if it is whole and says more than the title."""
    d = F.trim(F.regexp_replace(F.coalesce(description, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    text = plain_text(d)
    plain_title = plain_text(F.coalesce(title, F.lit("")))
    undecorated = plain_text(F.regexp_replace(F.coalesce(title, F.lit("")), r"^\s*\[[^\]]*\]", " "))
    low = F.lower(d)
    bad = low.rlike(_EMPTY) | low.rlike(_CUT) | low.rlike(_BOILERPLATE) | (text == "") | (text == plain_title) | (text == undecorated)
    return F.when(~bad, text)


def claims(findings: DataFrame, trust: DataFrame) -> DataFrame:
    """Usable values: dup_group, field_name, row_id, value, completeness, trust, reported_at, feed."""
    feeds = trust.where(F.col("feed").isNotNull()).groupBy("feed").agg(F.max("trust").cast("bigint").alias("trust"))
    read = findings.where(F.col("dup_group").isNotNull()).select(
        "dup_group", "row_id", "feed", "reported_at",
        provider_name(F.col("vendor")).alias("vendor"),
        severity_name(F.col("severity")).alias("severity"),
        weakness_number(F.col("cwe")).alias("cwe"),
        telling_description(F.col("description"), F.col("title")).alias("description"),
    )
    stated = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS])
    long = read.join(feeds, "feed", "left").select(
        "dup_group", "row_id", "feed", "reported_at", "trust", F.explode(F.filter(stated, lambda s: s["value"].isNotNull())).alias("s")
    )
    described = F.col("s.field_name") == "description"
    return long.select(
        "dup_group", "s.field_name", "row_id",
        F.when(described, F.xxhash64("s.value").cast("string")).otherwise(F.col("s.value")).alias("value"),
        F.when(described, F.length("s.value")).otherwise(1).alias("completeness"),
        F.coalesce("trust", F.lit(-1).cast("bigint")).alias("trust"),
        "reported_at",
        F.coalesce("feed", F.lit("(no feed)")).alias("feed"),
    )


def claimed_values(c: DataFrame) -> DataFrame:
    """One row per group, field and value: its best row and its pattern, the sources for it and the feeds beside it.

    Claims are read and reduced to values once, which are written; the claims of a value and the values
    of a group are reduced map-side to sets of feeds and maxima, so hot groups stay small.
    """
    when = F.coalesce("reported_at", F.lit("0001-01-01").cast("timestamp").cast(c.schema["reported_at"].dataType))
    values = c.groupBy("dup_group", "field_name", "value").agg(
        F.collect_set("feed").alias("speak"),
        F.max(F.struct(F.col("completeness").alias("c"), F.col("trust").alias("t"), when.alias("w"), (-F.col("row_id")).alias("r"))).alias("best"),
        F.max("completeness").alias("c"), F.max("trust").alias("t"), F.max(when).alias("w"),
    )
    values = written(values, "values")
    groups = values.groupBy("dup_group", "field_name").agg(
        F.array_distinct(F.flatten(F.collect_set("speak"))).alias("feeds"), F.max("c").alias("gc"), F.max("t").alias("gt"), F.max("w").alias("gw")
    )
    facts = values.join(groups, ["dup_group", "field_name"])
    witness = [F.when(F.col(v) == F.col(g), F.lit(name)) for v, g, name in zip("ctw", ("gc", "gt", "gw"), WITNESSES, strict=True)]
    spoken = F.array_sort(F.concat("speak", F.array_compact(F.array(*witness))))
    silent = F.array_sort(F.array_except(F.concat("feeds", F.array(*[F.lit(w) for w in WITNESSES])), spoken))
    return facts.select(
        "dup_group", "field_name", "value", "best", spoken.alias("spoken"), silent.alias("silent"),
        ((F.col("best.c") == F.col("gc")) & (F.col("best.t") == F.col("gt")) & (F.col("best.w") == F.col("gw"))).alias("dominates"),
    )


def _prior(source: str) -> tuple[float, float]:
    return WITNESS_PRIOR if source in WITNESSES else FEED_PRIOR


def _inside(p: float, least: float = LEAST) -> float:
    return min(max(p, least), 1 - least)


class TruthModel:
    """Sensitivity and specificity of every source, field by field, from patterns (field_name, spoken, silent, n)."""

    def __init__(self, patterns: DataFrame, rounds: int = ROUNDS, driver_patterns: int = DRIVER_PATTERNS):
        self.quality: dict[tuple[str, str], tuple[float, float]] = {}
        self.prior: dict[str, float] = {}
        if patterns.limit(driver_patterns + 1).count() <= driver_patterns:
            self._judge_here(patterns.collect(), rounds)
        else:
            self._judge_there(patterns, rounds)

    def _start(self, held: dict[str, set[str]]) -> None:
        self.prior = dict.fromkeys(held, 0.5)
        self.quality = {(f, s): _prior(s) for f, sources in held.items() for s in sources}

    def _learn(self, field: str, true: float, n: float, sums: dict[str, tuple[float, float, float, float]]) -> None:
        """Qualities from, per source, the truth it spoke, the truth it could speak, and the same of its silence on what is false."""
        self.prior[field] = _inside((true + 1) / (n + 2), 1e-3)
        for source, (said, could, left, beside) in sums.items():
            sens, spec = _prior(source)
            self.quality[field, source] = (
                _inside((said + sens * PRIOR_WEIGHT) / (could + PRIOR_WEIGHT)),
                _inside((left + spec * PRIOR_WEIGHT) / (beside + PRIOR_WEIGHT)),
            )

    def _judge_here(self, rows: list, rounds: int) -> None:
        by_field: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: (r["field_name"], r["spoken"], r["silent"])):
            by_field.setdefault(r["field_name"], []).append(r)
        self._start({f: {s for r in rs for s in (*r["spoken"], *r["silent"])} for f, rs in by_field.items()})
        for field, rs in by_field.items():
            sources = sorted({s for r in rs for s in (*r["spoken"], *r["silent"])})
            at = {s: i for i, s in enumerate(sources)}
            spoke, silent = np.zeros((len(rs), len(sources))), np.zeros((len(rs), len(sources)))
            for k, r in enumerate(rs):
                spoke[k, [at[s] for s in r["spoken"]]] = 1
                silent[k, [at[s] for s in r["silent"]]] = 1
            n = np.array([r["n"] for r in rs], float)
            for _ in range(rounds):
                sens, spec = (np.array([self.quality[field, s][i] for s in sources]) for i in (0, 1))
                odds = math.log(self.prior[field] / (1 - self.prior[field])) + spoke @ np.log(sens / (1 - spec)) + silent @ np.log((1 - sens) / spec)
                t = n / (1 + np.exp(-odds))
                sums = zip(t @ spoke, t @ (spoke + silent), (n - t) @ silent, (n - t) @ (spoke + silent), strict=True)
                self._learn(field, t.sum(), n.sum(), dict(zip(sources, sums, strict=True)))

    def _judge_there(self, patterns: DataFrame, rounds: int) -> None:
        one = patterns.select("field_name", "n", "spoken", "silent", F.explode(F.concat("spoken", "silent")).alias("source"))
        held: dict[str, set[str]] = {}
        for r in one.select("field_name", "source").distinct().collect():  # one row per field and source
            held.setdefault(r["field_name"], set()).add(r["source"])
        self._start(held)
        said = F.array_contains("spoken", F.col("source"))
        for _ in range(rounds):
            judged = one.withColumn("t", self.truth() * F.col("n")).withColumn("u", F.col("n") - F.col("t"))
            sums = judged.groupBy("field_name", "source").agg(
                F.sum(F.when(said, F.col("t")).otherwise(0.0)).alias("said"), F.sum("t").alias("could"),
                F.sum(F.when(said, 0.0).otherwise(F.col("u"))).alias("left"), F.sum("u").alias("beside"),
            ).collect()
            whole = patterns.groupBy("field_name").agg(F.sum(self.truth() * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()
            for w in whole:
                self._learn(w["field_name"], w["t"], w["n"], {r["source"]: tuple(r[2:]) for r in sums if r["field_name"] == w["field_name"]})

    def truth(self) -> Column:
        """Probability that a value with the lists ``spoken`` and ``silent`` is true."""
        odds = F.lit(0.0)
        for field, prior in sorted(self.prior.items()):
            total = F.lit(math.log(prior / (1 - prior)))
            for (f, source), (sens, spec) in sorted(self.quality.items()):
                if f == field:
                    spoke, silent = F.array_contains("spoken", source), F.array_contains("silent", source)
                    total = total + F.when(spoke, math.log(sens / (1 - spec))).when(silent, math.log((1 - sens) / spec)).otherwise(0.0)
            odds = F.when(F.col("field_name") == field, total).otherwise(odds)
        return 1 / (1 + F.exp(-odds))


def judged_values(findings: DataFrame, trust: DataFrame) -> DataFrame:
    """Every claimed value of every group and field with the probability that it is true, its best row and whether that row dominates.

    The values are written to the shared folder once: the model counts their patterns, then every value is judged.
    """
    facts = written(claimed_values(claims(findings, trust)), "claimed")
    model = TruthModel(facts.groupBy("field_name", "spoken", "silent").agg(F.count("*").alias("n")))
    return facts.withColumn("truth", model.truth())


def true_values(findings: DataFrame, trust: DataFrame, least: float = 0.5) -> DataFrame:
    """Every value judged true; a field may keep several."""
    return judged_values(findings, trust).where(F.col("truth") >= least).select("dup_group", "field_name", "value", "truth")


def survivors(findings: DataFrame, trust: DataFrame) -> DataFrame:
    """dup_group, field_name, row_id, truth, dominates: the best row of the likeliest value of every field."""
    j = judged_values(findings, trust)
    best = j.groupBy("dup_group", "field_name").agg(F.max(F.struct(F.col("truth").alias("p"), "best", "dominates")).alias("b"))
    return best.select("dup_group", "field_name", (-F.col("b.best.r")).alias("row_id"), F.col("b.p").alias("truth"), "b.dominates")
