from datetime import datetime

from pyspark.sql import functions as F

from gritmill.llm import fusion
from gritmill.llm.fusion import TruthModel, judged_values, provider_name, severity_name, survivors, telling_description, true_values, weakness_number

SCHEMA = "row_id long, dup_group long, feed string, vendor string, severity string, cwe string, description string, title string, reported_at timestamp, trust string, bit int"
T = datetime(2025, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def trust(spark):
    return spark.createDataFrame([("live", 50), ("mail", 10), (None, 99)], "feed string, trust int")


def one(spark, f, *values):
    kinds = ", ".join(f"c{i} string" for i in range(len(values[0])))
    df = spark.createDataFrame(list(values), kinds)
    return [r[0] for r in df.select(f(*[F.col(c) for c in df.columns])).collect()]


def test_usable_values(spark):
    assert one(spark, provider_name, ("Snyk (SaaS)",), (" AIKIDO",), ("3rd party",), (None,), ("snyker",)) == ["snyk", "aikido", None, None, None]
    assert one(spark, severity_name, ("CRIT",), ("severity:low",), ("7.1",), ("11",), ("TBD",), (None,)) == ["critical", "low", "high", None, None, None]
    assert one(spark, weakness_number, ("CWE_0078",), ("79",), ("CWE-",), ("0",), ("NVD-CWE-noinfo",), ("CWE-643: weakness",)) == ["78", "79", None, None, None, "643"]
    pairs = [("The check is late.", "T"), ("Weak check.", "[High] weak check"), ("Title: Weak check", "Weak check"), ("The check is [more]", "T"), ("n/a", "T"), ("<p></p>", "T"), (None, "T")]
    assert one(spark, telling_description, *pairs) == ["the check is late", None, None, None, None, None, None]


def test_dominant_tied_absent_and_repeated(spark):
    rows = [
        (1, 1, "mail", "snyk", "high", "CWE-1", "Long text here.", "t", T), (2, 1, "live", "snyk", "n/a", None, "Cut [more]", "t", T.replace(day=2)),
        (3, 2, "live", "snyk", None, "79", "A b.", "t", T), (3, 2, "live", "snyk", None, "79", "A b.", "t", T), (4, 2, "live", "semgrep", None, "80", "A b.", "t", T),
        (5, 3, "mail", "snyk", "low", None, "Longer text.", "t", T.replace(day=3)), (6, 3, "live", "snyk", "low", None, "Text.", "t", T),
        (7, None, "live", "snyk", "low", "1", "X y.", "t", T), (8, 4, None, "none", None, None, None, None, None), (9, 5, "new", "snyk", None, None, None, None, None),
    ]
    got = {(r.dup_group, r.field_name): (r.row_id, r.dominates) for r in survivors(frame(spark, rows), trust(spark)).collect()}
    assert got[1, "vendor"] == (2, True) and got[1, "severity"] == (1, True) and got[1, "cwe"] == (1, True) and got[1, "description"] == (1, True)
    assert got[2, "vendor"] == (3, True) and got[2, "description"] == (3, True) and (2, "severity") not in got
    assert got[3, "vendor"] == (6, False) and got[5, "vendor"] == (9, True)
    assert not [k for k in got if k[0] in (None, 4)]


def test_model_prefers_what_good_feeds_agree_on(spark):
    rows = []
    for g in range(200):
        rows += [(g * 3, g, "live", "snyk", None, "79", None, None, T), (g * 3 + 1, g, "mail", "snyk", None, "79" if g % 2 else str(100 + g), None, None, T)]
    j = judged_values(frame(spark, rows), trust(spark)).where("field_name = 'cwe'")
    r = j.agg(F.avg(F.when(F.col("value") == "79", F.col("truth"))).alias("good"), F.avg(F.when(F.col("value") != "79", F.col("truth"))).alias("bad")).first()
    assert r.good > r.bad


def quarrels(groups: int) -> list[tuple]:
    """The most trusted feed stands alone with an old value, two others agree on a newer one."""
    rows = []
    for g in range(groups):
        rows += [
            (g * 3, g, "live", "snyk", None, str(100 + g), None, None, T), (g * 3 + 1, g, "file", "snyk", None, "79", None, None, T.replace(day=2)),
            (g * 3 + 2, g, "mail", "snyk", None, "79", None, None, T.replace(day=3)),
        ]
    return rows


def test_the_model_decides(spark, monkeypatch):
    df = frame(spark, quarrels(60))
    rows = lambda: {r.dup_group: r.row_id for r in survivors(df, trust(spark)).where("field_name = 'cwe'").collect()}
    assert rows() == {g: g * 3 + 2 for g in range(60)}
    assert "79" in {r.value for r in true_values(df, trust(spark)).where("field_name = 'cwe'").collect()}
    monkeypatch.setattr(TruthModel, "truth", lambda self: F.lit(0.5))
    assert rows() == {g: g * 3 for g in range(60)}


def test_dominant_rows_survive_what_feeds_agree_on(spark):
    """A value that four feeds share against the newest, most trusted row of a fifth one."""
    feeds = spark.createDataFrame([(f"f{i}", i) for i in range(5)], "feed string, trust int")
    rows = [(g * 5 + i, g, f"f{i}", "snyk", None, "79" if i < 4 else "80", None, None, T.replace(day=1 + i)) for g in range(3) for i in range(5)]
    got = {(r.dup_group, r.row_id, r.dominates) for r in survivors(frame(spark, rows), feeds).where("field_name = 'cwe'").collect()}
    assert got == {(g, g * 5 + 4, True) for g in range(3)}


def test_both_ways_to_judge_agree_and_any_number_of_feeds(spark):
    rows = [(i, i // 7, f"feed {i % 90}", "snyk", "low" if i % 3 else "high", str(1 + i % 4), None, None, T.replace(day=1 + i % 20)) for i in range(700)]
    values = fusion.claimed_values(fusion.claims(frame(spark, rows), trust(spark)))
    patterns = values.groupBy("field_name", "spoken", "silent").agg(F.count("*").alias("n")).cache()
    here, there = TruthModel(patterns, 2), TruthModel(patterns, 2, 0)
    assert here.quality.keys() == there.quality.keys() and len({s for _, s in here.quality}) == 93
    assert all(abs(a - b) < 1e-9 for k in here.quality for a, b in zip(here.quality[k], there.quality[k], strict=True))
    patterns.unpersist()


def test_empty(spark):
    assert survivors(frame(spark, []), trust(spark)).count() == 0
