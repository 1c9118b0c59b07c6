"""Graph operators as joins of frontiers: reachability, components, paths, adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritmill.tables import cut


def reachable(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Nodes with their least number of hops from any seed (multi-source BFS).

    Each round joins only the new frontier and drops what was seen by anti-join;
    lineage is cut every round by a checkpoint in the shared folder. Cycles end by themselves.
    """
    e = edges.select("src", "dst").distinct()
    frontier = cut(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    seen = frontier
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        step = e.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connected components: node and the least node of its component, by min-label propagation with pointer jumping.

    A hub's neighbours are reduced by partial aggregation before the shuffle, so a hot node costs one row per task.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = cut(both)
    label = cut(nodes.select("node").distinct().withColumn("label", F.col("node")))
    while True:
        near = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("label").alias("near")).withColumnRenamed("src", "node")
        least = label.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = least.join(least.select(F.col("node").alias("new"), F.col("new").alias("jump")), "new", "left")
        nxt = cut(jump.select("node", "label", F.least("new", F.coalesce("jump", "new")).alias("new")))
        changed = nxt.where(F.col("label") != F.col("new")).limit(1).count()
        label = nxt.select("node", F.col("new").alias("label"))
        if not changed:
            return label


def adjacency(edges: DataFrame) -> DataFrame:
    """Every distinct edge with the number of callees of its source: rows, since the callees of a hub fit in no array."""
    e = edges.select("src", "dst").distinct()
    return e.join(e.groupBy("src").agg(F.count("*").alias("n")), "src")


def paths_to_sinks(edges: DataFrame, sources: DataFrame, sinks: DataFrame, max_hops: int = 3) -> DataFrame:
    """Simple paths of at most ``max_hops`` edges from a source to a sink, as node lists."""
    path = sources.select(F.array("node").alias("path"), F.col("node").alias("at")).distinct()
    found = None
    s = sinks.select(F.col("node").alias("at")).distinct()
    for _ in range(max_hops):
        grown = path.join(edges.select(F.col("src").alias("at"), "dst"), "at").where(~F.array_contains("path", F.col("dst")))
        path = cut(grown.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")))
        hit = path.join(s, "at", "left_semi").select("path")
        found = hit if found is None else found.unionByName(hit)
    return found.distinct()


def shortest_taint_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, base_hops: int = 3, deep_hops: int = 5) -> DataFrame:
    """The shortest path from each source to each sink, the least by node names of equals, as node lists.

    A breadth-first search per source that visits no node twice: ``base_hops`` edges from any source
    to any sink, ``deep_hops`` where both are ``high_risk``. A level costs at most sources x edges rows.
    """
    e = cut(edges.select("src", "dst").distinct())
    level = cut(sources.groupBy(F.col("node").alias("source")).agg(F.max("high_risk").alias("deep")).select("source", "deep", F.col("source").alias("at"), F.array("source").alias("path")))
    seen = level
    for hop in range(1, deep_hops + 1):
        live = level if hop <= base_hops else level.where("deep")
        ranked = live.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy("path")))
        first = ranked.select("source", "place", F.col("at").alias("src")).join(e, "src").groupBy("source", F.col("dst").alias("at")).agg(F.min("place").alias("place"))
        new = first.join(seen.select("source", "at"), ["source", "at"], "left_anti")
        level = cut(new.join(ranked.select("source", "deep", "place", "path"), ["source", "place"]).select("source", "deep", "at", F.concat("path", F.array("at")).alias("path")))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    s = sinks.groupBy(F.col("node").alias("at")).agg(F.max("high_risk").alias("sink_deep"))
    return seen.where(F.size("path") > 1).join(s, "at").where((F.size("path") - 1 <= base_hops) | F.col("sink_deep")).select("path")


def resolve_callees(calls: DataFrame, defs: DataFrame, max_targets: int = 3) -> DataFrame:
    """Call sites to definitions by name: the only one, those of the same file, else the best shared directory prefix with ties."""
    pair = calls.join(defs, "name")
    shared = F.size(F.filter(
        F.sequence(F.lit(1), F.least(F.size(F.split("caller_file", "/")), F.size(F.split("def_file", "/"))) - 1),
        lambda i: F.call_function("substring_index", F.col("caller_file"), F.lit("/"), i) == F.call_function("substring_index", F.col("def_file"), F.lit("/"), i),
    ))
    scored = pair.withColumn("same", (F.col("caller_file") == F.col("def_file")).cast("int")).withColumn(
        "score", F.when(F.col("def_file").contains("/") & F.col("caller_file").contains("/"), shared).otherwise(0)
    )
    w = W.partitionBy("call_id")
    ranked = scored.withColumn("n", F.count("*").over(w)).withColumn("rank", F.rank().over(w.orderBy(F.desc("same"), F.desc("score"))))
    best = ranked.where((F.col("n") == 1) | (F.col("rank") == 1)).withColumn("k", F.row_number().over(w.orderBy("def_file")))
    return best.where(F.col("k") <= max_targets).select("call_id", "name", "def_file", F.when(F.col("same") == 1, 1.0).when(F.col("score") >= 2, 0.8).when(F.col("score") == 1, 0.7).otherwise(0.5).alias("confidence"))
