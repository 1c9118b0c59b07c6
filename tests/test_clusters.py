"""Greedy choices in rounds against the pass itself, written plainly."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gritmill import tables
from gritmill.operators import clusters as C
from gritmill.operators import findings as O
from gritmill.operators import ordering as N

COLUMNS = "ord long, file string, vuln_class string, cwe string, line_start long, line_end long, source_ref string, sink_ref string"


def items(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randrange(1, 40)
        refs = [rng.choice([None, " ", "./a:1", "a:1", "b\\c:2"]) for _ in range(2)]
        rows.append((i, rng.choice("xy"), rng.choice(["inj", "leak", "logic-flaw"]), rng.choice([None, "CWE-1", "2", "bad"]), start, start + rng.randrange(4), *refs))
    return rows


def number(cwe):
    t = (cwe or "").lower().removeprefix("cwe-")
    return int(t) if t.isdigit() else None


def ref(r):
    return (r or "").strip().replace("\\", "/").removeprefix("./") or None


def plain_pass(rows, tol, strict, same_sink):
    parent = {}
    for j, b in enumerate(rows):
        for i, a in enumerate(rows[:j]):
            if i in parent:
                continue
            na, nb = number(a[3]), number(b[3])
            agree = na is not None and na == nb
            if a[2] in strict or b[2] in strict:
                ok = agree
            else:
                ok = agree or a[2] == b[2] and (na is None or nb is None)
            flow = None not in (ref(a[6]), ref(a[7])) and (ref(a[6]), ref(a[7])) == (ref(b[6]), ref(b[7]))
            sink = same_sink and agree and ref(a[7]) is not None and ref(a[7]) == ref(b[7])
            near = a[1] == b[1] and (abs(a[4] - b[4]) <= tol or a[4] <= b[5] and b[4] <= a[5])
            if ok and (flow or sink or near):
                parent[j] = i
                break
    return parent


@pytest.mark.parametrize(("seed", "same_sink"), [(1, False), (2, True)])
def test_duplicates(spark, seed, same_sink):
    rows = items(seed, 70)
    df = spark.createDataFrame(rows, COLUMNS)
    got = C.trivial_duplicates(df, 2, ["logic-flaw"], same_sink)
    want = plain_pass(rows, 2, {"logic-flaw"}, same_sink)
    assert {r.ord: r.parent for r in got.collect() if r.parent is not None} == want and got.count() == len(rows)
    chain = dict(want)
    for j, b in enumerate(rows):
        for i, a in enumerate(rows[:j]):
            if j in chain or i in chain or "logic-flaw" in (a[2], b[2]) or (a[1], a[4], a[5]) != (b[1], b[4], b[5]) or None in (number(a[3]), number(b[3])):
                continue
            chain[j] = i
    root = lambda i: root(chain[i]) if i in chain else i
    relations = {r.ord: (r.canonical, r.same_site) for r in C.duplicate_relations(df, 2, ["logic-flaw"], same_sink).collect()}
    site = lambda a, b: a[1] == b[1] and a[4] <= b[5] and b[4] <= a[5]
    assert relations == {j: (root(j), site(rows[j], rows[root(j)])) for j in chain}


def test_duplicates_in_shares_and_rounds_leave_only_their_result(spark, monkeypatch):
    tables.drop_written()
    monkeypatch.setattr(tables, "MANY_ROWS", 10)
    monkeypatch.setattr(C, "FEW_WATCHES", 0)
    rows = items(4, 60)
    rows += [(len(rows) + i, *rows[i * 7][1:]) for i in range(8)]  # copies, which their first stands for
    df = spark.createDataFrame(rows, COLUMNS)
    want = plain_pass(rows, 2, {"logic-flaw"}, True)
    got = C.trivial_duplicates(df, 2, ["logic-flaw"], True)
    assert {r.ord: r.parent for r in got.collect() if r.parent is not None} == want and got.count() == len(rows)
    tables.drop_written()
    relations = C.duplicate_relations(df, 2, ["logic-flaw"], True)
    held = {os.path.dirname(f.removeprefix("file:").lstrip("/")) for f in relations.inputFiles()}
    assert {p.removeprefix("file:").lstrip("/") for _, p in tables._WRITTEN} == held
    assert {r.ord for r in relations.collect()} >= set(want)


def test_no_items(spark):
    assert C.duplicate_relations(spark.createDataFrame([], COLUMNS), 2).count() == 0


def test_greedy_matches(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(30), rng.randrange(25)) for _ in range(120)}
    want, taken = {}, set()
    for c in sorted({c for c, _ in pairs}):
        free = sorted(b for x, b in pairs if x == c and b not in taken)
        if free:
            want[c] = free[0]
            taken.add(free[0])
    assert {r.cur: r.base for r in C.greedy_matches(spark.createDataFrame(sorted(pairs), "cur long, base long")).collect()} == want


def test_baseline_tiers_renames_and_near_spans(spark):
    cols = "{} long, file string, vuln_class string, line_start long, line_end long, v3 string, v2 string"
    cur = spark.createDataFrame([(0, "f", "c", 1, 2, "a", "A"), (1, "f", "c", 9, 9, None, "B"), (2, "g", "c", 5, 5, "m", "M"), (3, "f", "c", 30, 31, "q", "Q"), (4, "f", "d", 30, 31, "r", "R")], cols.format("cur"))
    base = spark.createDataFrame([(0, "f", "c", 1, 2, "a", "Z"), (1, "f", "c", 8, 8, "b", "B"), (2, "old", "c", 5, 5, "x", "X"), (3, "f", "c", 33, 33, "k", "K"), (4, "f", "c", 28, 28, "l", "L")], cols.format("base"))
    renamed = spark.createDataFrame([(2, "m", "M")], "base long, v3 string, v2 string")
    got = {(r.cur, r.base, r.tier) for r in C.baseline_states(cur, base, ["v3", "v2"], renamed, 3, O.tiered_match).collect()}
    assert got == {(0, 0, "v3"), (1, 1, "v2"), (2, 2, "renamed"), (3, 3, "fuzzy")}


def test_places_numbers_and_caps(spark):
    rows = [(i % 7 % 3, i, i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "g long, id long, size long")
    assert {r.id: r.idx for r in N.number_rows(df, [F.col("g"), F.desc("id")]).collect()} == {i: k for k, (_, i, _) in enumerate(sorted(rows, key=lambda r: (r[0], -r[1])), 1)}
    for largest in (10, 1000):
        places = {r.id: r.k for r in N.place_in_group(df, ["g"], F.col("id"), "k", largest).collect()}
        assert places == {i: 1 + sum(1 for h, j, _ in rows if h == g and j < i) for g, i, _ in rows}
    want = {}
    for g in range(3):
        used = 0
        for _, i, s in sorted(r for r in rows if r[0] == g):
            if used < 50:
                want[i] = min(s, 50 - used)
            used += s
    assert {r.id: r.kept for r in N.running_cap(df, "g", "id", "size", 50).collect()} == want
    assert N.number_rows(df.limit(0), [F.col("id")]).count() == 0
