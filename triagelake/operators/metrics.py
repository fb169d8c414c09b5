"""Multi-label metrics over the long form (row, label, y, prob, pred, thr)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triagelake.functions.numeric import ratio, smoothed_f1

OUTCOMES = {"tp": "y = 1 AND pred = 1", "fp": "y = 0 AND pred = 1", "fn": "y = 1 AND pred = 0", "tn": "y = 0 AND pred = 0"}


def confusion(long: DataFrame, *group: str) -> DataFrame:
    counts = long.groupBy(*group, "label").agg(*(F.count_if(F.expr(e)).alias(k) for k, e in OUTCOMES.items()))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f1, 6), "support": F.col("tp") + F.col("fn")})


def micro_macro(conf: DataFrame, *group: str) -> DataFrame:
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    cols = {"precision_micro": ratio(tp, tp + fp), "recall_micro": ratio(tp, tp + fn), "f1_micro": ratio(2 * tp, 2 * tp + fp + fn), "f1_macro": F.avg(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))}
    aggs = [F.round(c, 6).alias(k) for k, c in cols.items()]
    return conf.groupBy(*group).agg(*aggs) if group else conf.agg(*aggs)


def threshold_sweep(long: DataFrame, low: int = 5, high: int = 95) -> DataFrame:
    """(label, thr, tp, fp, fn) for thr = low/100 .. high/100, from one histogram a label.

    Scores are counted by the largest grid step they reach; suffix sums over the at most 101 steps of a
    label give the counts at every threshold. No row meets the grid.
    """
    step = F.floor(F.col("prob").cast("double") * 100 + 1e-6).cast("int")
    hist = long.groupBy("label", F.greatest(F.lit(0), F.least(F.lit(100), step)).alias("s")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    grid = hist.select("label").distinct().select("label", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("s"))
    full = grid.join(hist, ["label", "s"], "left").fillna(0, ["pos", "neg"])
    up = W.partitionBy("label").orderBy(F.desc("s"))
    out = full.select("label", "s", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), F.sum("pos").over(W.partitionBy("label")).alias("all_pos"))
    return out.filter(F.col("s").between(low, high)).select("label", (F.col("s") / 100.0).alias("thr"), "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"))


def best_thresholds(sweep: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Per label the threshold of the highest smoothed F1, the smallest among equals."""
    s = sweep.withColumn("score", F.round(smoothed_f1(F.col("tp"), F.col("fp"), F.col("fn"), alpha), 9))
    best = s.groupBy("label").agg(F.max_by(F.struct("thr", "score"), F.struct("score", -F.col("thr"))).alias("b"))
    return best.select("label", "b.thr", F.round("b.score", 6).alias("score"))


def exact_quantiles(df: DataFrame, group: str, value: str, qs: dict[str, float], low: float = 0.0, high: float = 1.0, bins: int = 1000) -> DataFrame:
    """(group, *qs): exact quantiles with linear interpolation of a value between low and high, for groups of
    any size; null values are left out, values outside are in the first or last bin.

    One pass counts the values of each group in bins; a second one looks only at the bins that hold the
    wanted places, and counts equal values before they are shuffled, so no task gets a group's values.
    """
    rows = df.filter(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_v"))
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("_v") - low) / (high - low) * bins))).cast("int")
    rows = rows.withColumn("_b", bin_)
    hist = rows.groupBy(group, "_b").agg(F.count("*").alias("n"))
    up = W.partitionBy(group).orderBy("_b")
    hist = hist.select(group, "_b", F.sum("n").over(up).alias("_end"), (F.sum("n").over(up) - F.col("n")).alias("_start"), F.sum("n").over(W.partitionBy(group)).alias("_n"))
    wanted = F.array(*(F.struct(F.lit(k).alias("q"), (F.lit(q) * (F.col("_n") - 1)).alias("at")) for k, q in qs.items()))
    ends = F.explode(F.array(F.struct(F.floor("at").alias("i"), (1 - (F.col("at") - F.floor("at"))).alias("w")), F.struct((F.floor("at") + 1).alias("i"), (F.col("at") - F.floor("at")).alias("w"))))
    picks = hist.select(group, "_b", "_start", "_end", F.inline(wanted)).select(group, "_b", "_start", "_end", "q", ends.alias("e"))
    picks = picks.filter("e.w > 0 AND e.i >= _start AND e.i < _end").select(group, "_b", "_start", "q", "e.i", "e.w")  # one or two bins a quantile
    inside = rows.join(F.broadcast(picks.select(group, "_b").distinct()), [group, "_b"], "left_semi").groupBy(group, "_b", "_v").agg(F.count("*").alias("n"))
    order = W.partitionBy(group, "_b").orderBy("_v")
    inside = inside.select(group, "_b", "_v", F.sum("n").over(order).alias("_to"), (F.sum("n").over(order) - F.col("n")).alias("_from"))
    hit = picks.join(inside, [group, "_b"]).filter("i - _start >= _from AND i - _start < _to")
    return hit.groupBy(group).agg(*(F.sum(F.when(F.col("q") == k, F.col("_v") * F.col("w"))).alias(k) for k in qs))


def kappa(pairs: DataFrame, levels: int, quadratic: bool = False, *group: str) -> DataFrame:
    """Cohen's kappa of columns a and b (complete pairs only) with n and raw agreement; null where undefined."""
    if not group:  # one group of all
        return kappa(pairs.withColumn("_all", F.lit(0)), levels, quadratic, "_all").drop("_all")
    cells = pairs.filter("a IS NOT NULL AND b IS NOT NULL").groupBy(*group, "a", "b").agg(F.count("*").alias("n"))
    w = (F.col("a") - F.col("b")) ** 2 if quadratic else (F.col("a") != F.col("b")).cast("double")
    obs = cells.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(w * F.col("n")).alias("o"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    ma = cells.groupBy(*group, "a").agg(F.sum("n").alias("na"))
    mb = cells.groupBy(*group, "b").agg(F.sum("n").alias("nb"))
    exp = ma.join(mb, list(group)).groupBy(*group).agg(F.sum(w * F.col("na") * F.col("nb")).alias("e"))  # levels x levels
    k = F.when(F.col("e") > 0, 1 - F.col("o") * F.col("n") / F.col("e"))
    return obs.join(exp, list(group)).select(*group, "n", F.round(F.col("same") / F.col("n"), 6).alias("agreement"), F.round(k, 6).alias("kappa"))
