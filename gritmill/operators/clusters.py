"""Greedy choices in a fixed order, made in rounds of joins: canonical members, duplicates, one-to-one matches.

A greedy pass takes its items one after the other, each looking at those before it.
Whether an item is canonical only depends on the earlier items it matches, so all
items whose earlier matches are decided can be decided at once; the rounds give the
result of the pass itself. No group is held in a task, and no pairs within a group of
equal keys are listed: what a group holds is reduced to its least member.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritmill.functions import text as X
from gritmill.tables import Stage, cut, shares


#: Keys that undecided items watch, up to which the rest of a greedy choice is made on the driver, and keys offered.
FEW_WATCHES, FEW_OFFERS = 50_000, 250_000


def greedy_parents(stage: Stage, offers: DataFrame, watches: DataFrame, few: int | None = None) -> DataFrame:
    """``ord``, ``parent``: the least earlier canonical match of every item that isn't canonical.

    ``offers`` (ord, key) tells where an item can be found, ``watches`` (ord, key) where
    it looks; an item matches the earlier ones that offer a key it watches. Items that are
    decided leave the rounds; the last few are decided one after the other.
    """
    few = FEW_WATCHES if few is None else few
    o, w, repeats = offers, watches, []
    while True:
        first = o.groupBy("key").agg(F.min("ord").alias("open"))
        blocked = stage.write(w.join(first, "key").where("open < ord").select("ord").distinct(), "blocked")
        if blocked.isEmpty():
            break
        best = o.join(blocked, "ord", "left_anti").groupBy("key").agg(F.min("ord").alias("best"))
        repeats.append(stage.write(w.join(blocked, "ord", "left_semi").join(best, "key").where("best < ord").select("ord").distinct(), "repeats"))
        left = blocked.join(repeats[-1], "ord", "left_anti")
        now = stage.write(o.join(left, "ord", "left_semi"), "offers"), stage.write(w.join(left, "ord", "left_semi"), "watches")
        stage.drop(blocked, *([o, w] if o is not offers else []))
        o, w = now
        if len(asked := w.limit(few + 1).collect()) <= few and len(held := o.limit(FEW_OFFERS + 1).collect()) <= FEW_OFFERS:
            repeats.append(o.sparkSession.createDataFrame([(x,) for x in _one_by_one(held, asked)], offers.select("ord").schema))
            break
    if not repeats:
        return watches.select("ord", F.col("ord").alias("parent")).limit(0)
    again = reduce(DataFrame.unionByName, repeats)
    best = offers.join(again, "ord", "left_anti").groupBy("key").agg(F.min("ord").alias("best"))
    return watches.join(again, "ord", "left_semi").join(best, "key").where("best < ord").groupBy("ord").agg(F.min("best").alias("parent"))


def _one_by_one(offers: list, watches: list) -> list:
    """The items that repeat an earlier canonical one, by the pass itself."""
    offered, watched, taken, again = defaultdict(list), defaultdict(list), set(), []
    for rows, by in ((offers, offered), (watches, watched)):
        for r in rows:
            by[r["ord"]].append(r["key"])
    for i in sorted({*offered, *watched}):
        if any(k in taken for k in watched[i]):
            again.append(i)
        else:
            taken.update(offered[i])
    return again


def _key(kind: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("\x00", F.lit(kind), *[p.cast("string") for p in parts]))


_PLACE = ["file", "line_start", "line_end", "vuln_class", "n", "source", "sink"]


def _first_pass(stage: Stage, items: DataFrame, tolerance: int, strict: list[str], merge_same_sink: bool) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Items with a neighbour in their file, in shares; items that share a sink; ``ord``, ``parent`` of the repeats among both.

    Items equal in all that is compared stand for one: the least of them (``rep``) takes
    part, the others repeat it, or what it repeats. Only items that share a file and weakness
    with a near one, or a sink, are carried on: no other pair can match.
    """
    rows, cls, n = items.select("ord").count(), F.col("vuln_class"), F.col("n")

    def read(some: DataFrame) -> DataFrame:
        return some.select(
            "ord", "file", "vuln_class", "line_start", "line_end", X.cwe_number(F.col("cwe")).alias("n"), F.col("vuln_class").isin(list(strict)).alias("strict"),
            X.normalize_ref(F.col("source_ref")).alias("source"), X.normalize_ref(F.col("sink_ref")).alias("sink"),
        ).where(n.isNotNull() | ~F.col("strict"))

    placed = F.col("file").isNotNull() & F.col("line_start").isNotNull()
    far = F.greatest("line_end", F.col("line_start") + tolerance)
    spread = lambda *keys: [F.xxhash64(*keys), *keys]  # noqa: E731 - a hash as the first key sorts faster than names that begin alike

    def chained(key: str) -> Column:
        w = W.partitionBy(*spread("file", key)).orderBy("line_start")
        before, after = F.max(far).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lead("line_start").over(w)
        return F.col(key).isNotNull() & (F.coalesce(before >= F.col("line_start"), F.lit(False)) | F.coalesce(after <= far, F.lit(False)))

    held, pairs, span = [], [], spread("file", "line_start", "line_end")
    for share in shares(F.col("file"), rows=rows):
        seen = read(items.where(share)).repartition("file").select(
            "ord", "file", "vuln_class", "n", "strict", "line_start", "line_end",
            F.when(placed, F.min("ord").over(W.partitionBy(*span, "vuln_class", "n", "source", "sink"))).otherwise(F.col("ord")).alias("rep"),
            (F.count("*").over(W.partitionBy(*span)) > 1).alias("same"), (chained("n") | chained("vuln_class")).alias("near"),
        )
        held.append(stage.write(seen.where("same OR near"), "held"))
        pairs.append(stage.write(_near(held[-1].where("near AND rep = ord"), tolerance), "pairs"))
    at = read(items).where(F.col("sink").isNotNull() & (F.col("source").isNotNull() | F.lit(merge_same_sink))).withColumn("h", F.xxhash64("sink"))
    several, sinks = stage.write(at.groupBy("h").count().where("count > 1").select("h"), "several"), []
    for share in shares(F.col("h"), rows=rows):
        one = at.where(share).join(several.where(share), "h", "left_semi").groupBy(*_PLACE, "strict", F.when(~placed, F.col("ord")).alias("own"))
        sinks.append(stage.write(one.agg(F.min("ord").alias("ord")).drop("own"), "sinks"))
    near, sunk = reduce(DataFrame.unionByName, pairs), reduce(DataFrame.unionByName, sinks)
    flow, numbered, loose = F.col("source").isNotNull(), n.isNotNull(), ~F.col("strict")
    to = [F.col("source"), F.col("sink")]
    numbers = F.when(numbered, _key("s", F.col("sink"), n)) if merge_same_sink else F.when(flow & numbered, _key("n", *to, n))
    offered = [numbers, F.when(flow & loose, _key("c", *to, cls)), F.when(flow & loose & ~numbered, _key("u", *to, cls))]
    watched = [numbers, F.when(flow & loose & ~numbered, _key("c", *to, cls)), F.when(flow & loose & numbered, _key("u", *to, cls))]
    keyed = lambda keys: sunk.select("ord", F.explode(F.array_compact(F.array(*keys))).alias("key"))
    offers = keyed(offered).unionByName(near.select(F.col("earlier").alias("ord"), F.col("earlier").cast("string").alias("key")).distinct())
    watches = keyed(watched).unionByName(near.select(F.col("later").alias("ord"), F.col("earlier").cast("string").alias("key")))
    offers, watches = stage.write(offers, "offers"), stage.write(watches, "watches")
    stage.drop(*pairs)
    parents = stage.write(greedy_parents(stage, offers, watches), "parents")
    stage.drop_all_but(*held, *sinks, parents)
    return held, sunk, parents


def trivial_duplicates(items: DataFrame, tolerance: int, strict: list[str] = (), merge_same_sink: bool = False) -> DataFrame:
    """Items (ord, file, vuln_class, cwe, line_start, line_end, source_ref, sink_ref) with the canonical item each repeats.

    Two items repeat each other if their weaknesses agree (equal numbers, or equal
    classes where a number is missing; equal numbers alone for strict classes) and they
    have the same flow, with ``merge_same_sink`` the same sink and number, or lie in one
    file at most ``tolerance`` lines apart or over each other.
    """
    held, _, parents = _first_pass(Stage(items.sparkSession), items, tolerance, strict, merge_same_sink)
    above = parents.select(F.col("ord").alias("rep"), F.col("parent").alias("above"))
    copies = reduce(DataFrame.unionByName, held).where("rep <> ord").join(above, "rep", "left").select("ord", F.coalesce("above", "rep").alias("parent"))
    return items.select("ord").join(parents.unionByName(copies), "ord", "left")


def _near(f: DataFrame, tolerance: int) -> DataFrame:
    """Pairs (earlier, later) of one file whose weaknesses agree and whose spans are near, joined by line bucket."""
    place = ["file", "vuln_class", "n", "line_start", "line_end", "strict"]
    width = max(tolerance, 1) * 4
    f = f.select("ord", *place)
    bucketed = f.withColumn("bucket", F.floor(F.col("line_start") / width))
    lo, hi = F.floor((F.col("line_start") - tolerance) / width), F.floor((F.greatest("line_end", F.col("line_start")) + tolerance) / width)
    reach = f.withColumn("bucket", F.explode(F.sequence(lo, hi)))
    x, y = bucketed.alias("x"), reach.select(*place, "ord", "bucket").alias("y")
    agree = F.coalesce(F.col("x.n") == F.col("y.n"), F.lit(False)) | (
        ~F.col("x.strict") & ~F.col("y.strict") & (F.col("x.vuln_class") == F.col("y.vuln_class")) & (F.col("x.n").isNull() | F.col("y.n").isNull())
    )
    close = F.abs(F.col("x.line_start") - F.col("y.line_start")) <= tolerance
    over = (F.col("x.line_start") <= F.col("y.line_end")) & (F.col("y.line_start") <= F.col("x.line_end"))
    pairs = x.join(y, ["file", "bucket"]).where((F.col("x.ord") != F.col("y.ord")) & agree & (close | over))
    return pairs.select(F.least("x.ord", "y.ord").alias("earlier"), F.greatest("x.ord", "y.ord").alias("later")).distinct()


def same_range_duplicates(items: DataFrame, parents: DataFrame) -> DataFrame:
    """Canonical items (without ``parents``) of one file and span whose numbers differ: ``ord`` and the first of them as ``parent``.

    After the first pass no two canonical items of a span have one number, so all of a
    span but its first repeat that one: a partial minimum, whatever the size of the span.
    """
    f = items.where("n IS NOT NULL AND line_start >= 1 AND NOT strict").join(parents, "ord", "left_anti")
    first = f.groupBy("file", "line_start", "line_end").agg(F.min("ord").alias("parent"))
    return f.join(first, ["file", "line_start", "line_end"]).where("ord <> parent").select("ord", "parent")


def duplicate_relations(items: DataFrame, tolerance: int, strict: list[str] = (), merge_same_sink: bool = False) -> DataFrame:
    """``ord``, ``canonical`` and whether both lie over each other in one file (``same_site``), for every duplicate of the two passes."""
    stage = Stage(items.sparkSession)
    held, sunk, first = _first_pass(stage, items, tolerance, strict, merge_same_sink)
    ones = reduce(DataFrame.unionByName, held).where("rep = ord")
    second = stage.write(same_range_duplicates(ones.where("same"), first), "second")
    up = second.select(F.col("ord").alias("parent"), F.col("parent").alias("above"))
    links = stage.write(first.unionByName(second).join(up, "parent", "left").select("ord", F.coalesce("above", "parent").alias("canonical")), "pointers")
    at = ["ord", "file", "line_start", "line_end"]
    asked = links.select("ord").unionByName(links.select(F.col("canonical").alias("ord"))).distinct()
    place = stage.write(ones.select(*at).unionByName(sunk.select(*at)).join(asked, "ord", "left_semi").dropDuplicates(["ord"]), "places")
    root = place.select(F.col("ord").alias("canonical"), F.col("file").alias("rf"), F.col("line_start").alias("rs"), F.col("line_end").alias("re"))
    same = (F.col("file") == F.col("rf")) & (F.col("line_start") <= F.col("re")) & (F.col("rs") <= F.col("line_end"))
    linked = stage.write(links.join(place, "ord").join(root, "canonical").select("ord", "canonical", F.coalesce(same, F.lit(False)).alias("same_site")), "links")
    out, above = [linked], linked.select(F.col("ord").alias("rep"), "canonical", "same_site")
    for h in held:
        copies = h.where("rep <> ord").select("ord", "rep", F.coalesce(F.col("line_start") <= F.col("line_end"), F.lit(False)).alias("own"))
        if not copies.isEmpty():
            out.append(stage.write(copies.join(above, "rep", "left").select("ord", F.coalesce("canonical", "rep").alias("canonical"), F.coalesce("same_site", "own").alias("same_site")), "copies"))
        stage.drop(h)
    stage.drop_all_but(*out)
    return reduce(DataFrame.unionByName, out)


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """One-to-one matches of pairs (cur, base): every ``cur``, in order, takes its first ``base`` that none before it took.

    As all of ``base`` prefer the earlier ``cur``, that is the stable matching: pairs that are
    each other's first choice are final, and leave with all pairs of either side; the least
    ``cur`` always has such a pair.
    """
    pairs = cut(pairs.select("cur", "base").distinct())
    done = None
    while not pairs.isEmpty():
        by_cur, by_base = pairs.groupBy("cur").agg(F.min("base").alias("base")), pairs.groupBy("base").agg(F.min("cur").alias("cur"))
        final = cut(by_cur.join(by_base, ["cur", "base"]))
        done = final if done is None else done.unionByName(final)
        pairs = cut(pairs.join(final.select("cur"), "cur", "left_anti").join(final.select("base"), "base", "left_anti"))
    return pairs if done is None else done


def near_pairs(current: DataFrame, baseline: DataFrame, tolerance: int) -> DataFrame:
    """Pairs (cur, base) of one file and class whose spans are near, joined by line bucket."""
    width = max(tolerance, 1) * 4
    x = current.withColumn("bucket", F.floor(F.col("line_start") / width)).alias("x")
    far = F.floor((F.greatest("line_end", F.col("line_start")) + tolerance) / width)
    y = baseline.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("line_start") - tolerance) / width), far))).alias("y")
    wide = current.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("line_start") - tolerance) / width), far))).alias("x")
    home = baseline.withColumn("bucket", F.floor(F.col("line_start") / width)).alias("y")
    close = F.abs(F.col("x.line_start") - F.col("y.line_start")) <= tolerance
    over = (F.col("x.line_start") <= F.col("y.line_end")) & (F.col("y.line_start") <= F.col("x.line_end"))
    hit = lambda a, b: a.join(b, ["file", "vuln_class", "bucket"]).where(close | over).select("cur", "base")
    return hit(x, y).unionByName(hit(wide, home)).distinct()


def baseline_states(current: DataFrame, baseline: DataFrame, exact: list[str], renamed: DataFrame, tolerance: int, matched) -> DataFrame:
    """``cur``, ``base``, ``tier``: matches by exact keys tier after tier, then by the renamed keys of ``renamed``, then by near spans.

    ``matched`` is the exact one-to-one match of two frames by tiers; rows matched once leave.
    """
    hits = cut(matched(current, baseline, exact))
    left = cut(current.join(hits.select("cur"), "cur", "left_anti"))
    right = cut(baseline.join(hits.select("base"), "base", "left_anti"))
    moved = cut(matched(left, right.select("base").join(renamed, "base"), exact).withColumn("tier", F.lit("renamed")))
    left, right = left.join(moved.select("cur"), "cur", "left_anti"), right.join(moved.select("base"), "base", "left_anti")
    fuzzy = greedy_matches(near_pairs(left, right, tolerance)).withColumn("tier", F.lit("fuzzy"))
    return hits.unionByName(moved).unionByName(fuzzy.select("cur", "base", "tier"))
