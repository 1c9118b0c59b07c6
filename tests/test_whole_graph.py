"""The call graph of all lineitem rows, on small fixtures against brute force."""

import random
from collections import defaultdict

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(7)
    return [(rng.randrange(1, 60), rng.randrange(1, 9), rng.randrange(1, 8)) for _ in range(120)]


@pytest.fixture(scope="module")
def small(spark, lines, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("graph"))
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.fixture(scope="module")
def edges(lines):
    return {(f"src/m{p % 20}.py::f{p % 97}", f"src/m{(p + s) % 20}.py::f{(p * 3 + s) % 97}") for p, s, _ in lines}


def reach(edges, seeds):
    seen, todo = set(seeds), list(seeds)
    while todo:
        at = todo.pop()
        new = {b for a, b in edges if a == at} - seen
        seen |= new
        todo += new
    return seen


def test_whole_graph(spark, small, lines, edges):
    rows = {n: {tuple(r) for r in QUERIES[n](spark, small).collect()} for n in ("reachable_nodes", "components", "call_adjacency", "neighborhood", "file_graph")}
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    assert rows["reachable_nodes"] == {(n,) for n in reach(edges, {a for a, _ in edges if a.startswith(("src/m0.py", "src/m5.py"))})}
    both = edges | {(b, a) for a, b in edges}
    assert rows["components"] == {(n, min(reach(both, {n}))) for e in edges for n in e}
    assert rows["call_adjacency"] == {(a, b, len(bs)) for a, bs in out.items() for b in bs}
    assert rows["neighborhood"] == {(a, ",".join(sorted(bs)[:3])) for a, bs in out.items()}
    files = {tuple(sorted(x.split("::")[0] for x in e)) for e in edges}
    assert rows["file_graph"] == {(a, b) for a, b in files if a != b}


def test_every_call_is_resolved(spark, small, edges):
    assert {r.call_id for r in QUERIES["callee_resolution"](spark, small).collect()} == {f"{a}>{b}" for a, b in edges}
