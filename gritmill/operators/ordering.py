"""Numbers and first rows of large ordered sets, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritmill.tables import cut


def number_rows(df: DataFrame, keys: list[Column], name: str = "idx") -> DataFrame:
    """Adds the place of every row, from 1, in the order of the keys.

    Rows are split by ranges of the keys, so a file or a group that a third of them
    share is split too; they are cut there, since sampled ranges may differ when
    computed anew. Then a row's place is its place in its partition plus the sizes
    of the partitions before, one number each.
    """
    ranged = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("_m", F.monotonically_increasing_id())
    part, local = F.call_function("shiftright", F.col("_m"), F.lit(33)).cast("int"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in ranged.groupBy(part.alias("p")).count().collect()}  # one row a partition
    before, offsets = 0, []
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(p, 0)
    starts = F.array(*[F.lit(x).cast("bigint") for x in offsets]) if offsets else F.array().cast("array<bigint>")
    return ranged.withColumn(name, F.get(starts, part) + local + 1).drop("_m")


LARGEST_GROUP = 1_000_000


def place_in_group(df: DataFrame, keys: list[str], order: Column, name: str, largest: int = LARGEST_GROUP) -> DataFrame:
    """Adds the place of every row in its group, from 1: by a window if no group is large, else from the places in the whole order."""
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    if most is None or most <= largest:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(order)).cast("bigint"))
    numbered = number_rows(df, [*[F.col(k) for k in keys], order], name)
    starts = numbered.groupBy(*keys).agg((F.min(name) - 1).alias("_before"))
    return numbered.join(starts, keys).withColumn(name, F.col(name) - F.col("_before")).drop("_before")


def first_values(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The least ``k`` distinct values of every group as a sorted array ``values``; ranks are limited before the shuffle."""
    ranked = df.select(group, value).distinct().withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy(value)))
    return ranked.where(F.col("_k") <= k).groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("values"))


def running_cap(df: DataFrame, group: str, order: str, size: str, cap: int) -> DataFrame:
    """Rows of every group, in order, as long as the sizes before them stay under the cap, with ``kept``, what of each still fits.

    At most ``cap`` rows of positive size can stay, so a rank limit goes before the
    running sum; rows of size 0 stay up to the row that fills the cap.
    """
    w = W.partitionBy(group).orderBy(order)
    sized = df.where(F.col(size) > 0).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).drop("_k")
    run = sized.withColumn("_t", F.sum(size).over(w)).where(F.col("_t") - F.col(size) < cap)
    kept = run.withColumn("kept", F.least(F.col(size), F.greatest(F.lit(0).cast("bigint"), cap - (F.col("_t") - F.col(size)))))
    full = run.groupBy(group).agg(F.max(F.when(F.col("_t") >= cap, F.col(order))).alias("_last"))
    none = df.where(F.col(size) == 0).join(full, group, "left").where(F.col("_last").isNull() | (F.col(order) < F.col("_last")))
    return kept.drop("_t").unionByName(none.drop("_last").withColumn("kept", F.lit(0).cast("bigint")))
