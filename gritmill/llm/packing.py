"""Filling windows of fixed capacity with texts, shortest pack first over the length histogram.

Texts are measured in tokens once. For each capacity their lengths become a
histogram of at most ``capacity`` rows, which is the only thing that reaches the
driver. There lengths are placed longest first: the patterns filled least are
extended, as many at a time as both counts allow, so the work and the patterns are bounded by the capacity, not by the texts. The
patterns go back to the texts by rank: the texts of a length are numbered, and
an interval of numbers belongs to each place of each pattern.

Ranks come from counts over (length, salt), so a length that a third of all texts
have is numbered in as many tasks as there are salts.

Defined results
---------------
* a text longer than the capacity is split into pieces of exactly the capacity
  and one rest; no other text is split;
* empty and null texts take no room: they have one piece of size 0 in window 0,
  which also holds ordinary texts;
* rows with equal or null ids and texts are placed each on their own;
* no windows or no texts: no rows.
"""

from __future__ import annotations

from bisect import insort
from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritmill.llm.bpe import token_counts
from gritmill.tables import written

# Least number of tasks that number the texts of one length; it grows with the session's partitions.
SALTS = 64
# The windows are a small dimension; more of them are refused, not cut off.
MAX_WINDOWS = 256


@dataclass
class Strategy:
    """Intervals of ranks: texts of ``size`` ranked first .. last lie in windows window_first .. in that order."""

    intervals: list[tuple[int, int, int, int]]
    windows: int


def pack_histogram(counts: dict[int, int], capacity: int) -> Strategy:
    """Shortest-pack-first packing of a histogram {length: number}, longest lengths first.

    A pattern is (windows, room left, places); it is split when a length fills only
    part of its windows. A length goes to the pattern filled least, the shortest
    pack, as long as that has room for it, else a new one is opened.
    """
    by_room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    rooms: list[int] = []  # sorted
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def put(room: int, number: int, places: list[tuple[int, int]]) -> None:
        if room == 0:
            done.append((number, places))
            return
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append((number, places))

    for size in sorted((s for s in counts if s > 0), reverse=True):
        left = counts[size]
        while left:
            if not rooms or rooms[-1] < size:
                break
            room = rooms[-1]
            number, places = by_room[room].pop()
            if not by_room[room]:
                rooms.pop()
            each = min(room // size, left)
            full = min(number, left // each)
            left -= full * each
            if number > full:
                put(room, number - full, places)
            put(room - each * size, full, [*places, (size, each)])
        each = capacity // size
        if left >= each:
            put(capacity - each * size, left // each, [(size, each)])
        if left % each:
            put(capacity - (left % each) * size, 1, [(size, left % each)])
    patterns = done + [p for room in list(by_room) for p in by_room[room]]
    used: dict[int, int] = defaultdict(int)
    intervals, window = [], 0
    for number, places in sorted(patterns, key=lambda p: (-p[0], p[1])):
        for size, each in places:
            intervals.append((size, used[size], each, window, number))
            used[size] += number * each
        window += number
    return Strategy(intervals, window)


def pieces(sizes: DataFrame, windows: DataFrame) -> DataFrame:
    """Every text, or piece of a text longer than the capacity, for every window: piece number, first token, size."""
    fixed = windows.where("capacity_tokens > 0").select("window_id", "capacity_tokens").distinct().limit(MAX_WINDOWS + 1).collect()
    if len(fixed) > MAX_WINDOWS:
        raise ValueError(f"more than {MAX_WINDOWS} windows")
    kinds = [F.struct(F.lit(r[0]).cast("int").alias("window_id"), F.lit(r[1]).cast("int").alias("capacity")) for r in fixed]
    pair = sizes.select("*", F.explode(F.array(*kinds) if kinds else F.array().cast("array<struct<window_id:int,capacity:int>>")).alias("w")).select("*", "w.*")
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / F.col("capacity")).cast("int") - 1, F.lit(0))),
        lambda i: F.struct(
            i.alias("piece"), (i * F.col("capacity")).alias("first_token"), F.least(F.col("size") - i * F.col("capacity"), F.col("capacity")).alias("tokens")
        ),
    )
    return pair.select("window_id", "capacity", "doc_id", "salt", F.explode(cut).alias("p")).select("window_id", "capacity", "doc_id", "salt", "p.*")


def packed(documents: DataFrame, windows: DataFrame, path: str | None = None) -> DataFrame:
    """window_id, doc_id, piece, first_token, tokens, window_no of every text and window."""
    spark = documents.sparkSession
    salts = max(SALTS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64("doc_id", F.col("text")), F.lit(salts)).cast("int")
    sizes = written(token_counts(documents.select("doc_id", "text", salt.alias("salt")), "text", ["doc_id", "salt"], path), "sizes")
    rows = pieces(sizes, windows)
    # (window, length, salt): at most windows x capacity x salts rows, whatever the number of texts
    counted = rows.groupBy("window_id", "capacity", "tokens", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("window_id", "tokens").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = written(counted.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")
    histogram: dict[tuple[int, int], dict[int, int]] = defaultdict(dict)
    for r in offsets.groupBy("window_id", "capacity", "tokens").agg(F.sum("n").alias("n")).collect():
        histogram[r["window_id"], r["capacity"]][r["tokens"]] = r["n"]
    plan = [
        (window_id, size, first, first + each * number, each, window)
        for (window_id, capacity), counts in sorted(histogram.items())
        for size, first, each, window, number in pack_histogram(counts, capacity).intervals
    ]
    frame = pd.DataFrame(plan, columns=["window_id", "tokens", "first", "stop", "each", "window_first"])
    intervals = spark.createDataFrame(frame, "window_id int, tokens int, first bigint, stop bigint, each bigint, window_first bigint")
    by_length = intervals.groupBy("window_id", "tokens").agg(F.array_sort(F.collect_list(F.struct("first", "stop", "each", "window_first"))).alias("places"))
    # Every salt of a length gets the intervals its ranks lie in, so that rows find theirs in a short array and meet it by (length, salt).
    last = F.col("offset") + F.col("n")
    mine = F.filter("places", lambda p: (p["first"] < last) & (p["stop"] > F.col("offset")))
    salted = offsets.join(by_length, ["window_id", "tokens"], "left").select("window_id", "tokens", "salt", "offset", mine.alias("places"))
    rank = F.row_number().over(W.partitionBy("window_id", "tokens", "salt").orderBy("doc_id", "piece")) - 1
    ranked = rows.withColumn("local", rank).join(salted, ["window_id", "tokens", "salt"])
    at = F.col("local") + F.col("offset")
    place = F.get(F.filter("places", lambda p: (p["first"] <= at) & (at < p["stop"])), F.lit(0))
    number = F.when(F.col("tokens") == 0, F.lit(0)).otherwise(place["window_first"] + F.floor((at - place["first"]) / place["each"]))
    return ranked.select("window_id", "doc_id", "piece", "first_token", "tokens", number.cast("bigint").alias("window_no"))
