"""Order-dependent operators as ranking windows with a total order: dedup, top-n, marking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triagelake.store import stage


def keep_one(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order; null keys are one key."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def keep_least(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """As keep_one for one ascending order column, by a partial aggregation that combines before the
    shuffle: a key that holds a third of all rows sends one row a task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def mark_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with is_duplicate: whether another row has the same keys, nulls being equal.

    Counts are aggregated before they are joined back; those of hot keys are
    broadcast, so neither the count nor the join gathers a hot key in one task.
    """
    from triagelake.operators.joins import attach

    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = df.count()
    return attach(df, n, keys, "_n", total).withColumn("is_duplicate", F.col("_n") > 1).drop("_n")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def last_of_sources(frames: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Union in which a later source replaces an earlier one's rows of the same key."""
    tagged = [f.withColumn("source_rank", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return keep_one(out, keys, [F.desc("source_rank"), F.desc(order)])


def place_in_group(df: DataFrame, group: list[str], order: list[Column], place: str = "place", size: str | None = None) -> DataFrame:
    """Rows with their place (1, 2, ...) in their group's order and, on request, the group's size.

    No group is gathered in one task: rows are range-partitioned by group and order, places are counted
    inside each range, and each range's offset is the number of rows of the group in the ranges before.
    Null group values are one group. The order must be total.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(parts, *group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("_local", F.row_number().over(W.partitionBy("_range", *group).orderBy(*order)))
    counts = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    offsets = counts.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(whole).alias("_whole"))
    on = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = inside.join(offsets, on).withColumn(place, F.col("_local") + F.col("_off"))
    if size:
        out = out.withColumn(size, F.col("_whole"))
    return out.drop("_range", "_local", "_r", "_off", "_whole", *(f"_g{i}" for i in range(len(group))))


def running_sum(df: DataFrame, value: str, order: list[Column], name: str) -> DataFrame:
    """Rows with the sum of `value` over all rows before them, by ranges: no task gets all rows. The order must be total."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = F.sum(value).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_s"))  # one row a range
    before = sums.select("_range", F.coalesce(F.sum("_s").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return ranged.withColumn("_in", inside).join(F.broadcast(before), "_range").withColumn(name, F.coalesce("_in", F.lit(0)) + F.col("_off")).drop("_range", "_in", "_off")
