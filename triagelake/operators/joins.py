"""Joins: provenance, exclusion, differences, dictionary words, near-duplicate similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import text as T
from triagelake.operators import shingles as H
from triagelake.store import stage

SMALL_BYTES = 32 << 20  # a side is broadcast up to this size by the optimizer's estimate, joined by a shuffle beyond


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if the optimizer's size estimate, made from the sizes of the files, is at most
    SMALL_BYTES; otherwise as it is. No job is run and nothing is computed twice."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= SMALL_BYTES else df


def attach(rows: DataFrame, keyed: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined with keyed (one row a key; null keys are equal), where `size` of keyed says how many rows
    have the key.

    Keys that hold over a thousandth of all rows are at most a thousand: they are broadcast, so no
    task gets all rows of a hot key. All others are joined by a shuffle.
    """
    cut = max(1000, total // 1000)
    extra = [c for c in keyed.columns if c not in keys]
    named = keyed.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    drop = [f"_k{i}" for i in range(len(keys))]
    hot = named.filter(F.col(size) > cut).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), on, "left").drop(*drop)
    done = marked.filter(F.col("_hot")).drop("_hot")
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot", *extra)
    return done.unionByName(rest.join(named.filter(F.col(size) <= cut), on).drop(*drop))


def full_outer(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Both sides on key, values as <name>_a and <name>_b, and where each row came from."""
    x = a.select(key, *(F.col(v).alias(f"{v}_a") for v in values), F.lit(True).alias("_a"))
    y = b.select(key, *(F.col(v).alias(f"{v}_b") for v in values), F.lit(True).alias("_b"))
    side = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both")
    return x.join(y, key, "full_outer").withColumn("provenance", side).drop("_a", "_b")


def exclude_ids(df: DataFrame, sources: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key is in none of the sources."""
    ids = reduce(DataFrame.union, (s.select(key) for s in sources)).filter(F.col(key).isNotNull()).distinct()
    return df.join(ids, key, "left_anti")


def changed_columns(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both sides with the names of the columns that differ; blank and null are equal."""
    norm = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    x = a.select(key, *(norm(F.col(c)).alias(f"{c}_a") for c in columns))
    y = b.select(key, *(norm(F.col(c)).alias(f"{c}_b") for c in columns))
    diff = F.concat_ws(",", F.array_compact(F.array(*(F.when(F.col(f"{c}_a") != F.col(f"{c}_b"), F.lit(c)) for c in columns))))
    return x.join(y, key).withColumn("changed", diff)


def not_equal_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def dictionary_match(docs: DataFrame, key: str, text: Column, names: DataFrame, name: str) -> DataFrame:
    """(key, name): the longest dictionary name that occurs in the text as whole words, ties by name.

    Texts become runs of as many words as some name has, joined on equality: no text meets the whole
    dictionary, and neither the dictionary nor the length of its names has a cap. Names are compared as
    given, lower-cased by the caller.
    """
    names = names.select(name).filter(F.col(name).isNotNull()).distinct()
    lengths = sorted(r["k"] for r in names.select(F.size(F.split(name, " ")).alias("k")).distinct().collect()) or [1]
    words = docs.select(key, F.filter(F.split(text, "[^\\p{L}\\p{N}]+"), lambda x: x != "").alias("_w"))

    def runs_of(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - (k - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice("_w", i, F.lit(k)), " "))

    grams = F.flatten(F.array(*(runs_of(k) for k in lengths)))
    runs = words.filter(F.size("_w") > 0).select(key, F.explode(F.array_distinct(grams)).alias(name))
    found = runs.join(small(names), name)
    return found.groupBy(key).agg(F.min_by(name, F.struct(-F.length(name), F.col(name))).alias(name))


def near_duplicate_join(left: DataFrame, right: DataFrame, key: str, text: Column, t: float = 0.85, k: int = 5) -> DataFrame:
    """(left, right, similarity): the best right row of every left row by k-shingle Jaccard of at least t.

    Whole sets are compared (H.near_pairs); no shingles are written, only the texts.
    Equal texts are one representative per side, so copies of a text do not multiply the work.
    """
    sides = [df.select(F.col(key).alias("row"), F.lit(i).alias("side"), text.alias("t")).filter("t <> ''") for i, df in enumerate((left, right))]
    rows = stage(sides[0].unionByName(sides[1]).withColumn("id", F.xxhash64("t")), "normalized")
    each = rows.groupBy("id", "t").agg(F.max(F.col("side") == 0).alias("l"), F.max(F.col("side") == 1).alias("r"))
    texts = stage(H.sized_texts(each, "id", "t", k), "texts")
    l_all = rows.filter("side = 0").select(F.col("row").alias("l"), F.col("id").alias("a"))
    ids_l = l_all.select(F.col("a").alias("id")).distinct()
    ids_r = rows.filter("side = 1").groupBy("id").agg(F.min("row").alias("r"))
    sim = H.near_pairs(texts, k, t)
    same = ids_l.join(ids_r.select("id"), "id").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    links = sim.unionByName(same).join(ids_r.withColumnRenamed("id", "b"), "b")
    best = links.groupBy("a").agg(F.max_by(F.struct("r", "similarity"), F.struct(F.col("similarity"), -F.col("r"))).alias("m"))
    return l_all.join(best, "a").select("l", "m.r", F.round("m.similarity", 6).alias("similarity"))
