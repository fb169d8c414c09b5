"""Scoring of texts: a linear model over words as one projection, its audit, and training of such models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import lexicon as X
from triagelake.functions import numeric as N
from triagelake.functions import text as T
from triagelake.operators import metrics as M

BIAS = -2.0
# label -> (word, weight): a fixed model made from the lexicon; the first word of a label weighs most
MODEL = {c: [(w, round(3.0 - 0.5 * i, 1)) for i, w in enumerate(X.WEAK["A"].get(c, X.INFO_WORDS)[:5])] for c in X.LABELS}


def scores(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(*keep, prob_<label>, pred_<label>): sigmoid of the weights of the words in the lower-cased text, cut at
    the label's threshold as 32-bit numbers. A null text has no words. Expressions only, no Python."""
    t = df.withColumn("_t", T.low(text))
    z = lambda c: reduce(lambda a, b: a + b, (F.when(F.contains("_t", F.lit(w)), F.lit(k)).otherwise(F.lit(0.0)) for w, k in MODEL[c]), F.lit(BIAS))
    p = t.select(*keep, *(F.round(N.sigmoid(z(c)), 6).alias(f"prob_{c}") for c in X.LABELS))
    return p.select("*", *((F.col(f"prob_{c}").cast("float") >= F.lit(X.THRESHOLDS[c]).cast("float")).cast("int").alias(f"pred_{c}") for c in X.LABELS))


def with_counts(scored: DataFrame) -> DataFrame:
    p = [F.col(f"pred_{c}") for c in X.LABELS]
    return scored.withColumns({"label_count": reduce(lambda a, b: a + b, p), "any_need": F.greatest(*p)})


def artifact_audit(predictions: DataFrame, thresholds: DataFrame, source: DataFrame) -> DataFrame:
    """One row: rows against those of the source, missing columns, thresholds that differ from the canonical
    ones (or are missing), predictions that disagree with their score, scores out of range."""
    wanted = [f"{k}_{c}" for c in X.LABELS for k in ("prob", "pred")] + ["label_count", "any_need"]
    missing = [c for c in wanted if c not in predictions.columns]
    here = [c for c in X.LABELS if f"prob_{c}" not in missing and f"pred_{c}" not in missing]
    total = lambda f: reduce(lambda a, b: a + b, (F.count_if(f(c)) for c in here), F.lit(0))
    over = lambda c: (F.col(f"prob_{c}").cast("float") >= F.lit(X.THRESHOLDS[c]).cast("float")) != (F.col(f"pred_{c}") == 1)
    wild = lambda c: F.col(f"prob_{c}").isNull() | ~F.col(f"prob_{c}").between(0, 1)
    sums = predictions.agg(F.count("*").alias("rows"), total(over).cast("int").alias("disagreements"), total(wild).cast("int").alias("out_of_range"))
    canon = predictions.sparkSession.createDataFrame(list(X.THRESHOLDS.items()), "label string, canonical double")
    cut = canon.join(thresholds, "label", "left").agg(F.count_if(F.col("threshold").isNull() | (F.abs(F.col("threshold") - F.col("canonical")) > 1e-6)).cast("int").alias("threshold_differences"))
    return sums.join(F.broadcast(cut)).join(F.broadcast(source.agg(F.count("*").alias("expected_rows")))).withColumn("missing_columns", F.lit(len(missing)))  # one row each


def trained_scores(df: DataFrame, text: str, labels: list[str], features: int = 1 << 12) -> DataFrame:
    """(label, split_name, tp, fp, fn, tn, precision, recall, f1, support) of a logistic regression a label over
    hashed words, rare classes weighted by the inverse of their share. Trained on split `train` only; labels
    other than 1 count as 0, null texts as empty; a label without both classes predicts 0."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    base = df.select("split_name", T.low(F.col(text)).alias("_t"), *(F.when(F.col(c) == 1, 1.0).otherwise(0.0).alias(c) for c in labels))
    words = RegexTokenizer(inputCol="_t", outputCol="_w", pattern="[^\\p{L}\\p{N}]+", toLowercase=False).transform(base)
    rows = HashingTF(inputCol="_w", outputCol="_x", numFeatures=features, binary=True).transform(words).drop("_w", "_t")
    train = rows.filter("split_name = 'train'").persist()
    counts = train.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in labels)).first()
    parts = []
    for c in labels:
        if not 0 < counts[c] < counts["n"]:
            parts.append(rows.select("split_name", F.lit(c).alias("label"), F.col(c).cast("int").alias("y"), F.lit(0).alias("pred")))
            continue
        weight = F.when(F.col(c) == 1, (counts["n"] - counts[c]) / counts[c]).otherwise(1.0)
        model = LogisticRegression(featuresCol="_x", labelCol=c, weightCol="_k", predictionCol="_p", maxIter=20, regParam=0.01).fit(train.withColumn("_k", F.sqrt(weight)))
        parts.append(model.transform(rows).select("split_name", F.lit(c).alias("label"), F.col(c).cast("int").alias("y"), F.col("_p").cast("int").alias("pred")))
    train.unpersist()
    return M.confusion(reduce(DataFrame.unionByName, parts), "split_name")
