"""Selections with floors and caps over ranked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def path_budget(paths: DataFrame, cap: int, per_pair: int = 5) -> DataFrame:
    """Paths (path_id, source, family, score) kept within a cap.

    The best path of every family is a floor and always kept; of a repeated
    (source, family) the best ``per_pair`` may stay; the rest fills the cap by score.
    The floor is a partial maximum, the ranks of a pair are limited before the shuffle,
    and the cap is a limit, so no group is collected or sorted whole.
    """
    order = [F.desc("score"), "path_id"]
    floor = paths.groupBy("family").agg(F.min_by(F.struct(*paths.columns), F.struct((-F.col("score")).alias("s"), F.col("path_id").alias("i"))).alias("r")).select("r.*")
    pair = paths.withColumn("_p", F.row_number().over(W.partitionBy("source", "family").orderBy(*order))).where(F.col("_p") <= per_pair).drop("_p")
    rest = pair.join(floor.select("path_id"), "path_id", "left_anti").orderBy(*order).limit(cap)
    return floor.withColumn("_f", F.lit(0)).unionByName(rest.withColumn("_f", F.lit(1))).orderBy("_f", *order).limit(cap).drop("_f")


def cap_with_promotion(rows: DataFrame, key: str, covers: str, rank: list, cap: int) -> DataFrame:
    """The first ``cap`` rows by rank, with the best row of every value of ``covers`` promoted before the others."""
    first = F.row_number().over(W.partitionBy(covers).orderBy(*rank, key))  # a rank limit, which goes before the shuffle
    best = rows.where(F.col(covers).isNotNull()).withColumn("_b", first).where("_b = 1").drop("_b")
    rest = rows.join(best.select(key), key, "left_anti").orderBy(*rank, key).limit(cap)
    return best.withColumn("_b", F.lit(0)).unionByName(rest.withColumn("_b", F.lit(1))).orderBy("_b", *rank, key).limit(cap).drop("_b")


def round_robin(rows: DataFrame, group: str, order: list, per_group: int, total: int) -> DataFrame:
    """At most ``per_group`` rows of every group, taken in turns, ``total`` in all."""
    k = rows.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("bigint"))
    return k.where(F.col("turn") <= per_group).orderBy("turn", group, *order).limit(total)
