"""Profiles of a table: one pass of conditional aggregation, then one row per column or value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequency(df: DataFrame, key: str, keep_null: bool = False, top: int | None = None) -> DataFrame:
    """(key, n), largest first with the key as tiebreak; null keys only on request."""
    if not keep_null:
        df = df.filter(F.col(key).isNotNull())
    out = df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)
    return out.limit(top) if top else out


def per_column(df: DataFrame, measures: dict[str, dict[str, Column]]) -> DataFrame:
    """(column, *names): aggregates of many columns in one scan, one row per column."""
    one = df.agg(*(e.alias(f"{c}__{k}") for c, ms in measures.items() for k, e in ms.items()))
    cells = [F.struct(F.lit(c).alias("column"), *(F.col(f"{c}__{k}").alias(k) for k in ms)) for c, ms in measures.items()]
    return one.select(F.inline(F.array(*cells)))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    return per_column(df, {c: {"nulls": F.count_if(F.col(c).isNull()), "percent": F.round(F.avg(F.col(c).isNull().cast("double")) * 100, 2)} for c in columns})


def text_conflicts(df: DataFrame, key: Column, columns: list[str]) -> DataFrame:
    """Groups of equal keys in which some column has several values; nulls are none. Values are kept as
    sets, combined before the shuffle: distinct counts would copy every row once a column."""
    out = df.withColumn("_key", key).filter(F.col("_key") != "").groupBy("_key").agg(F.count("*").alias("n"), *(F.size(F.collect_set(c)).cast("long").alias(c) for c in columns))
    return out.filter((F.col("n") > 1) & (F.greatest(*columns) > 1)).withColumnRenamed("_key", "key")


def quantiles(df: DataFrame, columns: list[str]) -> DataFrame:
    return per_column(df, {c: {"mean": F.round(F.avg(c), 6), "median": F.round(F.median(F.col(c).cast("double")), 6), "p95": F.round(F.percentile(F.col(c).cast("double"), 0.95), 6)} for c in columns})
