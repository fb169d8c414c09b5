"""Rule engines: weak labels, scored candidate rules, adjudication, postprocessing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import lexicon as X
from triagelake.functions.text import any_of


def weak_labels(text: Column, profile: str = "A") -> dict[str, Column]:
    """Nine labels by pattern, severity and credibility. The last label needs none of the others, no
    urgency and no plea; severity is the largest of its rules."""
    bank = X.WEAK[profile]
    y = {c: any_of(text, w).cast("int") for c, w in bank.items()}
    none = reduce(lambda a, b: a & b, (v == 0 for v in y.values()))
    urgent, plea = any_of(text, X.URGENT_WORDS), any_of(text, X.HELP_WORDS)
    y["bilgi_paylasimi"] = (none & any_of(text, X.INFO_WORDS) & ~urgent & ~plea).cast("int")
    severity = F.greatest(F.lit(0), F.when(urgent, 3).otherwise(0), F.when(y["arama_kurtarma"] == 1, 3).otherwise(0), F.when(y["saglik"] == 1, 2).otherwise(0), F.when(plea, 1).otherwise(0))
    return {**y, "severity": severity, "credibility": F.when(any_of(text, X.DOUBT_WORDS), "supheli").otherwise("dogrulanmis")}


def scored_rules(text: Column, label: str) -> Column:
    """struct(score, hits): named weighted rules, floored at 0 and 0 unless a positive rule hits."""
    rules = X.RARE_RULES[label]
    hits = F.array_compact(F.array(*(F.when(text.rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(w).alias("weight"))) for n, w, p in rules)))
    total = F.aggregate(hits, F.lit(0), lambda a, x: a + x.weight)
    positive = F.exists(hits, lambda x: x.weight > 0)
    return F.struct(F.when(positive, F.greatest(F.lit(0), total)).otherwise(0).alias("score"), F.array_join(F.transform(hits, lambda x: x.rule), ";").alias("rules"))


def adjudicate(df: DataFrame, labels: list[str]) -> DataFrame:
    """<label>_final where both agree, null where not, and whether any present pair differs."""
    finals = {f"{c}_final": F.when(F.col(f"{c}_a") == F.col(f"{c}_b"), F.col(f"{c}_a")) for c in labels}
    differs = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"{c}_a") != F.col(f"{c}_b"), F.lit(False)) for c in labels))
    return df.withColumns({**finals, "needs_adjudication": differs})


def settle(df: DataFrame, labels: list[str], ordinal: str | None = None) -> DataFrame:
    """Automatic finals: a label if either side sets it, the larger ordinal, the only side where one is missing."""
    cols = {f"{c}_final": F.greatest(F.col(f"{c}_a"), F.col(f"{c}_b")) for c in labels}
    if ordinal:
        cols[f"{ordinal}_final"] = F.greatest(F.col(f"{ordinal}_a"), F.col(f"{ordinal}_b"))
    return df.withColumns(cols)


def cautious_credibility(a: Column, b: Column) -> Column:
    """Agreement, the only side given, else the middle class."""
    x, y = F.nullif(F.trim(F.coalesce(a, F.lit(""))), F.lit("")), F.nullif(F.trim(F.coalesce(b, F.lit(""))), F.lit(""))
    return F.when(x == y, x).when(x.isNull(), y).when(y.isNull(), x).otherwise("supheli")


def raise_information(pred: Column, prob: Column, signal: Column, least: float = X.INFO_MIN_PROB) -> Column:
    """A negative is raised where the score is not small and the text signals information."""
    return F.when((pred == 0) & (prob >= F.lit(least).cast("float")) & signal, 1).otherwise(pred)


def override_reason(text: Column, score: Column, label: str) -> Column:
    """Why a candidate is what it is: '' for no candidate, a veto's name, 'confirmed', or '<label>_weak'."""
    rules = X.OVERRIDES[label]
    out = F.when(score <= 0, "")
    for name, pattern in rules["veto"]:
        out = out.when(text.rlike(pattern), name)
    strong = reduce(lambda a, b: a | b, (text.rlike(p) for p in rules["strong"]))
    return out.when(strong, "confirmed").otherwise(f"{label}_weak")


def export_guard(df: DataFrame, required: list[str]) -> DataFrame:
    """df, or an error that counts the rows in which a required value is null or blank: nothing incomplete is exported."""
    blank = reduce(lambda a, b: a | b, (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "" for c in required))
    if n := df.filter(blank).count():
        raise ValueError(f"export blocked: {n} rows lack final values")
    return df
