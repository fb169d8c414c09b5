"""Readers of the driver's tables and SQL fragments that say the same as functions.text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions.lexicon import LABELS, THRESHOLDS

EMERGENCY = "emergency_geolocated_96k"
GOLD = "need_classification_gold_combined"
SILVER = "need_classification_silver_63k_profilea_exgold"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer partitions than there are: small files come as one
    task. Where the scan already has enough partitions nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def low(x: str) -> str:
    return f"lower(replace(coalesce({x}, ''), 'İ', 'i̇'))"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


def clean(x: str) -> str:
    return squash(f"coalesce({x}, '')")


def fold(x: str) -> str:
    return f"translate({low(x)}, 'ığüşöç', 'igusoc')"


def overlap(x: str) -> str:
    y = low(x)
    for p in ("https?://\\S+|www\\.\\S+", "@[\\p{L}\\p{N}_]+", "[^\\p{L}\\p{N}_\\s]"):
        y = f"regexp_replace({y}, '{p}', ' ', 'g')"
    return squash(y)


def probability(k: int, label: Column) -> Column:
    """A stand-in score of label k: fixed noise of the row, raised where the label is set."""
    return F.pmod(F.col("src_ord") * 37 + k * 101, F.lit(500)) / 1000.0 + F.when(label == 1, 0.45).otherwise(0.0)


def scored(df: DataFrame) -> DataFrame:
    """Gold rows with prob_<label> and pred_<label>; labels as 0/1."""
    y = {c: F.when(F.col(c) == 1, 1).otherwise(0) for c in LABELS}
    df = df.withColumns(y)
    df = df.withColumns({f"prob_{c}": probability(k, F.col(c)).cast("float") for k, c in enumerate(LABELS)})
    return df.withColumns({f"pred_{c}": (F.col(f"prob_{c}") >= F.lit(THRESHOLDS[c]).cast("float")).cast("int") for c in LABELS})


def long_labels(df: DataFrame, *keep: str) -> DataFrame:
    """One row per row and label: (src_ord, *keep, label, y, prob, pred, thr). The form all metrics use."""
    cells = F.array(
        *(F.struct(F.lit(c).alias("label"), F.col(c).alias("y"), F.col(f"prob_{c}").alias("prob"), F.col(f"pred_{c}").alias("pred"), F.lit(THRESHOLDS[c]).cast("float").alias("thr")) for c in LABELS)
    )
    return df.select("src_ord", *keep, F.inline(cells))


def long_sql(*keep: str) -> str:
    """The SQL of long_labels(scored(gold)) as a common table expression body."""
    parts = []
    for k, c in enumerate(LABELS):
        extra = "".join(f", {x}" for x in keep)
        parts.append(
            f"SELECT src_ord{extra}, '{c}' AS label, CASE WHEN {c} = 1 THEN 1 ELSE 0 END AS y, "
            f"CAST(((src_ord * 37 + {k * 101}) % 500) / 1000.0::DOUBLE + CASE WHEN {c} = 1 THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END AS FLOAT) AS prob, CAST({THRESHOLDS[c]} AS FLOAT) AS thr FROM {GOLD}"
        )
    return "SELECT *, CASE WHEN prob >= thr THEN 1 ELSE 0 END AS pred FROM (" + " UNION ALL ".join(parts) + ")"


def quota_sql(source: str, group: str, n: int, least: int) -> str:
    """(g, size, quota) of largest-remainder quotas, as operators.sampling.allocated gives them."""
    return f"""
SELECT g, size, CASE WHEN short > 0 THEN q + CASE WHEN q < size AND open_place <= short THEN 1 ELSE 0 END
                     ELSE q - greatest(0, least(greatest(q - least_, 0), -short - coalesce(before, 0))) END AS quota
FROM (SELECT *, row_number() OVER (PARTITION BY q >= size ORDER BY rest DESC, g NULLS FIRST) AS open_place,
             sum(greatest(q - least_, 0)) OVER (ORDER BY q DESC, g NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
             m - sum(q) OVER () AS short
      FROM (SELECT *, CASE WHEN least_ > 0 AND least_ * groups <= m THEN greatest(least(f, size), least(least_, size)) ELSE least(f, size) END AS q
            FROM (SELECT *, size * m::DOUBLE / total AS e, floor(size * m::DOUBLE / total + 1e-9) AS f, size * m::DOUBLE / total - floor(size * m::DOUBLE / total + 1e-9) AS rest,
                         CASE WHEN groups <= {n} THEN {least} ELSE 0 END AS least_
                  FROM (SELECT *, count(*) OVER () AS groups, sum(size) OVER () AS total, least({n}, sum(size) OVER ()) AS m
                        FROM (SELECT {group} AS g, count(*) AS size FROM {source} GROUP BY 1)))))"""


def sample_sql(source: str, group: str, n: int, seed: int, keep: str) -> str:
    """The columns `keep` of a sample of n rows in proportion to the groups, as operators.sampling.proportional_sample draws it."""
    rows = f"SELECT *, {group} AS g, row_number() OVER (PARTITION BY {group} ORDER BY md5('{seed}|' || id), id) AS rn FROM {source}"
    return f"SELECT {keep} FROM ({rows}) r JOIN (SELECT g AS _g, quota FROM ({quota_sql(source, group, n, 1)})) t ON r.g IS NOT DISTINCT FROM t._g WHERE rn <= quota"
