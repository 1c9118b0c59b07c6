"""Paths of 3 hops, 5 for high risk, against a breadth-first search."""

import random
from collections import deque

from gritmill.operators import graph as G

import __spark_entry__ as entry


def brute(edges, sources, sinks):
    out = {}
    for a, b in sorted(edges):
        out.setdefault(a, []).append(b)
    paths = set()
    for s, deep in sources.items():
        seen, todo = {s}, deque([[s]])
        while todo:
            path = todo.popleft()
            if len(path) - 1 >= (5 if deep else 3):
                continue
            for b in out.get(path[-1], ()):
                if b not in seen:
                    seen.add(b)
                    todo.append([*path, b])
                    if b in sinks and (len(path) <= 3 or sinks[b]):
                        paths.add((*path, b))
    return paths


def test_hops_against_brute_force(spark):
    rng = random.Random(3)
    edges = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)} | {(f"c{i}", f"c{i + 1}") for i in range(8)}
    sources = {"n1": True, "n2": False, "n3": True, "n4": False, "c0": True, "c1": False}
    sinks = {f"n{i}": i % 2 == 0 for i in range(40)} | {"c3": False, "c4": False, "c5": True, "c6": True}
    frame = lambda d: spark.createDataFrame(list(d.items()), "node string, high_risk boolean")
    got = [tuple(r.path) for r in G.shortest_taint_paths(spark.createDataFrame(sorted(edges), "src string, dst string"), frame(sources), frame(sinks)).collect()]
    want = brute(edges, sources, sinks)
    assert len(got) == len(set(got)) and set(got) == want
    assert ("c0", "c1", "c2", "c3", "c4", "c5") in want and max(map(len, want)) == 6


def test_registered_over_all_edges(spark, tmp_path):
    rng = random.Random(11)
    lines = [(p, s, 2) for p in range(1, 400) for s in rng.sample(range(1, 60), 2)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    edges = {(f"src/m{p % 20}.py::f{p % 97}", f"src/m{(p + s) % 20}.py::f{(p * 3 + s) % 97}") for p, s, _ in lines}
    sources = {a: a[-1] in "13579" for a, _ in edges if a.startswith(("src/m0.py", "src/m5.py"))}
    want = brute(edges, sources, {b: b[-1] in "13579" for _, b in edges if "::f1" in b})
    assert any(len(p) > 3 for p in want)
    assert sorted(r.path for r in entry.queries()["taint_paths"](spark, str(tmp_path)).collect()) == sorted(">".join(p) for p in want)
