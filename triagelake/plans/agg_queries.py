"""Queries of aggregations, ranking windows, set operations and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triagelake.functions import lexicon as X
from triagelake.functions import numeric as N
from triagelake.functions import text as T
from triagelake.operators import metrics as M
from triagelake.operators import order as O
from triagelake.operators import profile as P
from triagelake.plans.registry import query
from triagelake.plans.tables import EMERGENCY, GOLD, SILVER, clean, long_labels, long_sql, low, overlap, scored, table

L = X.LABELS
LONG = f"WITH long AS ({long_sql('split_name', 'province', 'label_source')})"


def gold_long(spark, d, *keep):
    return long_labels(scored(table(spark, d, GOLD)), *keep)


@query("g1_global_stats", f"SELECT count(*) AS n, min(length(tweet)) AS shortest, max(length(tweet)) AS longest, round(avg(length(tweet)), 6) AS mean, CAST(median(length(tweet)) AS DOUBLE) AS middle FROM {EMERGENCY}")
def g1(spark, d):
    n = F.length("tweet")
    return table(spark, d, EMERGENCY).agg(F.count("*").alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.median(n).alias("middle"))


@query("g2_top_values", f"SELECT username, count(*) AS n FROM {EMERGENCY} WHERE username IS NOT NULL GROUP BY username ORDER BY n DESC, username LIMIT 20")
def g2(spark, d):
    return P.frequency(table(spark, d, EMERGENCY), "username", top=20)


@query("g3_values_with_null", f"SELECT veracity_label, count(*) AS n FROM {GOLD} GROUP BY veracity_label")
def g3(spark, d):
    return P.frequency(table(spark, d, GOLD), "veracity_label", keep_null=True)


_NC = ("tweet", "tweet_clean", "neighborhood", "district", "province", "notes", "guvenlik", "aciliyet_0_3")


@query("g4_null_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 2) AS percent FROM {GOLD}" for c in _NC))
def g4(spark, d):
    return P.null_profile(table(spark, d, GOLD), list(_NC))


@query("g5_conditional_rates", f"SELECT count(*) FILTER (has_emergency_keywords) AS emergency, round(avg(CASE WHEN has_location_keywords THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 6) AS location_percent FROM {EMERGENCY}")
def g5(spark, d):
    rate = F.avg(F.when(F.col("has_location_keywords"), 1.0).otherwise(0.0)) * 100
    return table(spark, d, EMERGENCY).agg(F.count_if("has_emergency_keywords").alias("emergency"), F.round(rate, 6).alias("location_percent"))


@query("g6_distinct_per_group", f"SELECT neighborhood, count(DISTINCT district) AS districts FROM {EMERGENCY} WHERE neighborhood IS NOT NULL GROUP BY neighborhood HAVING count(DISTINCT district) > 1")
def g6(spark, d):
    return table(spark, d, EMERGENCY).filter("neighborhood IS NOT NULL").groupBy("neighborhood").agg(F.count_distinct("district").alias("districts")).filter("districts > 1")


@query("g7_pair_sizes", f"SELECT province, district, count(*) AS n FROM {EMERGENCY} WHERE province IS NOT NULL AND district IS NOT NULL GROUP BY province, district ORDER BY n DESC, province, district LIMIT 30")
def g7(spark, d):
    df = table(spark, d, EMERGENCY).dropna(subset=["province", "district"])
    return df.groupBy("province", "district").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "province", "district").limit(30)


@query("g8_daily", f"SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM {EMERGENCY} WHERE created_at IS NOT NULL GROUP BY 1")
def g8(spark, d):
    return table(spark, d, EMERGENCY).filter("created_at IS NOT NULL").groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))


@query("g9_token_frequency", f"SELECT token, count(*) AS n FROM (SELECT unnest(string_split({clean('tweet_normalized')}, ' ')) AS token FROM {EMERGENCY}) WHERE token <> '' GROUP BY token")
def g9(spark, d):
    words = table(spark, d, EMERGENCY).select(F.explode(F.split(T.clean(F.col("tweet_normalized")), " ")).alias("token"))
    return words.filter("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


@query("g10_method_per_place", f"SELECT province, count(*) FILTER (extraction_method = 'keyword') AS keyword, count(*) FILTER (extraction_method = 'gazetteer') AS gazetteer FROM {EMERGENCY} GROUP BY province")
def g10(spark, d):
    return table(spark, d, EMERGENCY).groupBy("province").agg(*(F.count_if(F.col("extraction_method") == m).alias(m) for m in ("keyword", "gazetteer")))


@query("g11_keyword_documents", " UNION ALL ".join(f"SELECT '{w}' AS keyword, count(*) FILTER (contains({low('tweet')}, '{w}')) AS n FROM {EMERGENCY}" for w in (*X.EMERGENCY, *X.AREA)))
def g11(spark, d):
    words = (*X.EMERGENCY, *X.AREA)
    one = table(spark, d, EMERGENCY).select(T.low(F.col("tweet")).alias("t")).agg(*(F.count_if(F.contains("t", F.lit(w))).alias(f"k{i}") for i, w in enumerate(words)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(w).alias("keyword"), F.col(f"k{i}").alias("n")) for i, w in enumerate(words)))))


@query("g12_label_sums", f"SELECT label, sum(y) AS positives, sum(y) < 10 AS rare FROM ({long_sql()}) GROUP BY label")
def g12(spark, d):
    return gold_long(spark, d).groupBy("label").agg(F.sum("y").alias("positives"), (F.sum("y") < 10).alias("rare"))


@query("g13_prevalence", f"SELECT label, sum(y) AS positives, round(avg(y) * 100, 3) AS percent FROM ({long_sql()}) GROUP BY label")
def g13(spark, d):
    return gold_long(spark, d).groupBy("label").agg(F.sum("y").alias("positives"), F.round(F.avg("y") * 100, 3).alias("percent"))


@query("g14_domain_violations", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} NOT IN (0, 1)) AS violations, count(DISTINCT CASE WHEN {c} NOT IN (0, 1) THEN {c} END) AS kinds FROM {GOLD}" for c in L))
def g14(spark, d):
    bad = {c: ~F.col(c).isin(0, 1) for c in L}
    return P.per_column(table(spark, d, GOLD), {c: {"violations": F.count_if(b), "kinds": F.count_distinct(F.when(b, F.col(c)))} for c, b in bad.items()})


@query("g15_blanks", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (trim(coalesce({c}, '')) = '') AS blanks, count(*) FILTER (lower(trim(coalesce({c}, ''))) IN ('unknown', 'nan', 'n/a', 'none', 'null', '-')) AS placeholders FROM {GOLD}" for c in ("neighborhood", "district", "province", "notes", "veracity_label")))
def g15(spark, d):
    cols = ("neighborhood", "district", "province", "notes", "veracity_label")
    return P.per_column(table(spark, d, GOLD), {c: {"blanks": F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) == ""), "placeholders": F.count_if(T.is_placeholder(F.col(c)))} for c in cols})


@query("g16_label_conflicts", f"SELECT {overlap('tweet')} AS key, count(*) AS n, count(DISTINCT saglik) AS saglik, count(DISTINCT barinma) AS barinma FROM {GOLD} WHERE {overlap('tweet')} <> '' GROUP BY 1 HAVING count(*) > 1 AND greatest(count(DISTINCT saglik), count(DISTINCT barinma)) > 1")
def g16(spark, d):
    return P.text_conflicts(table(spark, d, GOLD), T.overlap_text(F.col("tweet")), ["saglik", "barinma"])


_CONFLICT = [*L, "aciliyet_0_3", "veracity_label"]


@query("g16_all_label_conflicts", f"SELECT {overlap('tweet')} AS key, count(*) AS n, {', '.join(f"count(DISTINCT trim(coalesce({c}::VARCHAR, ''))) AS {c}" for c in _CONFLICT)} FROM {GOLD} WHERE {overlap('tweet')} <> '' GROUP BY 1 HAVING count(*) > 1 AND greatest({', '.join(f"count(DISTINCT trim(coalesce({c}::VARCHAR, '')))" for c in _CONFLICT)}) > 1")
def g16_all(spark, d):
    """Over every label column; a blank is a value of its own, so a blank beside a value is a conflict."""
    df = table(spark, d, GOLD)
    return P.text_conflicts(df.withColumns({c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in _CONFLICT}), T.overlap_text(F.col("tweet")), _CONFLICT)


_CONF = "sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END) AS tn"


def _r(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"


_F1 = _r("2 * tp", "(2 * tp + fp + fn)")


@query("g18_confusion", f"{LONG}, c AS (SELECT label, {_CONF} FROM long GROUP BY label) SELECT *, round({_r('tp', '(tp + fp)')}, 6) AS precision, round({_r('tp', '(tp + fn)')}, 6) AS recall, round({_F1}, 6) AS f1, tp + fn AS support FROM c")
def g18(spark, d):
    return M.confusion(gold_long(spark, d))


@query("g19_micro_macro", f"{LONG}, c AS (SELECT split_name, label, {_CONF} FROM long GROUP BY split_name, label) SELECT split_name, round({_r('sum(tp)', '(sum(tp) + sum(fp))')}, 6) AS precision_micro, round({_r('sum(tp)', '(sum(tp) + sum(fn))')}, 6) AS recall_micro, round({_r('2 * sum(tp)', '(2 * sum(tp) + sum(fp) + sum(fn))')}, 6) AS f1_micro, round(avg({_F1}), 6) AS f1_macro FROM c GROUP BY split_name")
def g19(spark, d):
    return M.micro_macro(M.confusion(gold_long(spark, d, "split_name"), "split_name"), "split_name")


_KAPPA = """p AS ({pairs}), v AS (SELECT {g} a, b, count(*) AS n FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY {g} a, b),
 o AS (SELECT {g} sum(n) AS n, sum({w} * n) AS o, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM v GROUP BY {gl}),
 ma AS (SELECT {g} a, sum(n) AS na FROM v GROUP BY {g} a), mb AS (SELECT {g} b, sum(n) AS nb FROM v GROUP BY {g} b),
 e AS (SELECT {g} sum({w} * na * nb) AS e FROM ma JOIN mb USING ({gl}) GROUP BY {gl})
 SELECT {g} n, round(same::DOUBLE / n, 6) AS agreement, round(CASE WHEN e > 0 THEN 1 - o::DOUBLE * n / e END, 6) AS kappa FROM o JOIN e USING ({gl})"""


@query("g20_kappa", LONG + ", " + _KAPPA.format(pairs="SELECT label, y AS a, pred AS b FROM long", g="label,", gl="label", w="(CASE WHEN a <> b THEN 1 ELSE 0 END)"))
def g20(spark, d):
    return M.kappa(gold_long(spark, d).select("label", F.col("y").alias("a"), F.col("pred").alias("b")), 2, False, "label")


@query("g20_quadratic_kappa", "WITH " + _KAPPA.format(pairs=f"SELECT split_name, CASE WHEN aciliyet_0_3 BETWEEN 0 AND 3 THEN aciliyet_0_3 END AS a, least(3, urgency_score // 4) AS b FROM {GOLD}", g="split_name,", gl="split_name", w="((a - b) * (a - b))"))
def g20q(spark, d):
    a = F.when(F.col("aciliyet_0_3").between(0, 3), F.col("aciliyet_0_3"))
    b = F.least(F.lit(3), F.floor(F.col("urgency_score") / 4).cast("int"))
    return M.kappa(table(spark, d, GOLD).select("split_name", a.alias("a"), b.alias("b")), 4, True, "split_name")


@query("g21_annotator_rates", f"{LONG} SELECT label, round(avg(y), 6) AS rate_a, round(avg(pred), 6) AS rate_b, count(*) AS n FROM long GROUP BY label")
def g21(spark, d):
    return gold_long(spark, d).groupBy("label").agg(F.round(F.avg("y"), 6).alias("rate_a"), F.round(F.avg("pred"), 6).alias("rate_b"), F.count("*").alias("n"))


_ERR = "SELECT src_ord, {k}, max(CASE WHEN y <> pred THEN 1 ELSE 0 END) AS err FROM long GROUP BY src_ord, {k}"


@query("g22_slice_errors", f"{LONG}, e AS ({_ERR.format(k='province')}) SELECT province, count(*) AS n, sum(err) AS errors, round(avg(err), 6) AS rate FROM e GROUP BY province HAVING count(*) >= 5")
def g22(spark, d):
    row = gold_long(spark, d, "province").groupBy("src_ord", "province").agg(F.max((F.col("y") != F.col("pred")).cast("int")).alias("err"))
    out = row.groupBy("province").agg(F.count("*").alias("n"), F.sum("err").alias("errors"), F.round(F.avg("err"), 6).alias("rate"))
    return out.filter("n >= 5").orderBy(F.desc("rate"), F.desc("n"), "province")


@query("g23_all_slices", f"{LONG}, e AS (SELECT src_ord, split_name, province, label_source, max(CASE WHEN y <> pred THEN 1 ELSE 0 END) AS err FROM long GROUP BY ALL) SELECT CASE WHEN grouping(split_name) = 0 THEN 'split' WHEN grouping(province) = 0 THEN 'province' ELSE 'source' END AS slice, CASE WHEN grouping(split_name) = 0 THEN split_name WHEN grouping(province) = 0 THEN province ELSE label_source END AS value, count(*) AS n, sum(err) AS errors FROM e GROUP BY GROUPING SETS ((split_name), (province), (label_source))")
def g23(spark, d):
    """All slices in one aggregation by grouping sets."""
    row = gold_long(spark, d, "split_name", "province", "label_source").groupBy("src_ord", "split_name", "province", "label_source").agg(F.max((F.col("y") != F.col("pred")).cast("int")).alias("err"))
    keys = [F.col(c) for c in ("split_name", "province", "label_source")]
    out = row.groupingSets([[k] for k in keys], *keys).agg(F.count("*").alias("n"), F.sum("err").alias("errors"), F.grouping("split_name").alias("gs"), F.grouping("province").alias("gp"))
    which = F.when(F.col("gs") == 0, "split").when(F.col("gp") == 0, "province").otherwise("source")
    value = F.when(F.col("gs") == 0, F.col("split_name")).when(F.col("gp") == 0, F.col("province")).otherwise(F.col("label_source"))
    return out.select(which.alias("slice"), value.alias("value"), "n", "errors")


_SIX = {
    "aciliyet_0_3": "coalesce(aciliyet_0_3::VARCHAR, '(missing)')", "urgency_score": "coalesce(urgency_score::VARCHAR, '(missing)')",
    "text_length": "CASE WHEN length(coalesce(tweet_clean, '')) < 120 THEN 'short(<120)' WHEN length(coalesce(tweet_clean, '')) < 220 THEN 'medium(120-219)' ELSE 'long(>=220)' END",
    "gold_label_count": "CASE WHEN k >= 3 THEN '3+' ELSE k::VARCHAR END", "province": "coalesce(province, '(missing)')", "province_district": "coalesce(province, '') || ' / ' || coalesce(district, '')",
}


@query("g23_six_slices", f"{LONG}, e AS (SELECT src_ord, max(CASE WHEN y <> pred THEN 1 ELSE 0 END) AS err, sum(y) AS k FROM long GROUP BY src_ord), w AS (SELECT * FROM e JOIN {GOLD} USING (src_ord)) SELECT slice, value, count(*) AS n, sum(err) AS errors, round(avg(err), 6) AS rate FROM ({' UNION ALL '.join(f"SELECT '{k}' AS slice, {v} AS value, err FROM w" for k, v in _SIX.items())}) GROUP BY slice, value")
def g23_six(spark, d):
    """The reference's six slices, every group of each; a row gives six cells, combined before the shuffle."""
    missing = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(missing)"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    n, k = F.length(blank("tweet_clean")), reduce(lambda a, b: a + b, (F.col(c) for c in L))
    value = {
        "aciliyet_0_3": missing("aciliyet_0_3"), "urgency_score": missing("urgency_score"), "text_length": F.when(n < 120, "short(<120)").when(n < 220, "medium(120-219)").otherwise("long(>=220)"),
        "gold_label_count": F.when(k >= 3, "3+").otherwise(k.cast("string")), "province": missing("province"), "province_district": F.concat(blank("province"), F.lit(" / "), blank("district")),
    }
    err = F.greatest(*((F.col(c) != F.col(f"pred_{c}")).cast("int") for c in L))
    cells = F.array(*(F.struct(F.lit(s).alias("slice"), v.alias("value")) for s, v in value.items()))
    rows = scored(table(spark, d, GOLD)).select(err.alias("err"), F.inline(cells))
    return rows.groupBy("slice", "value").agg(F.count("*").alias("n"), F.sum("err").alias("errors"), F.round(F.avg("err"), 6).alias("rate"))


@query("g24_slice_positive_rates", f"SELECT province, count(*) AS n, {', '.join(f'round(avg(CASE WHEN {c} = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS {c}' for c in L)} FROM {GOLD} GROUP BY province ORDER BY n DESC, province NULLS LAST LIMIT 15")
def g24(spark, d):
    out = table(spark, d, GOLD).groupBy("province").agg(F.count("*").alias("n"), *(F.round(F.avg(F.when(F.col(c) == 1, 1.0).otherwise(0.0)), 6).alias(c) for c in L))
    return out.orderBy(F.desc("n"), F.asc_nulls_last("province")).limit(15)


@query("g25_quantiles", f"{LONG} SELECT label, round(avg(prob::DOUBLE), 5) AS mean, round(median(prob::DOUBLE), 6) AS median, round(quantile_cont(prob::DOUBLE, 0.95), 6) AS p95, round(avg(pred), 6) AS prevalence FROM long GROUP BY label")
def g25(spark, d):
    long = gold_long(spark, d)
    means = long.groupBy("label").agg(F.round(F.avg(F.col("prob").cast("double")), 5).alias("mean"), F.round(F.avg("pred"), 6).alias("prevalence"))
    q = M.exact_quantiles(long, "label", "prob", {"median": 0.5, "p95": 0.95})
    return means.join(q, "label").select("label", "mean", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "prevalence")


@query("g26_integrity", f"{LONG} SELECT (SELECT count(*) - count(DISTINCT id) FROM {GOLD}) AS repeated_ids, count(*) FILTER (prob IS NULL) AS missing, count(*) FILTER (prob < 0 OR prob > 1) AS out_of_range, count(*) FILTER ((prob >= thr) <> (pred = 1)) AS disagree, sum(pred) AS positives FROM long")
def g26(spark, d):
    """One aggregation over the wide rows."""
    wide = scored(table(spark, d, GOLD))
    total = lambda f: reduce(lambda a, b: a + b, (F.count_if(f(F.col(f"prob_{c}"), F.col(f"pred_{c}"), F.lit(X.THRESHOLDS[c]).cast("float"))) for c in L))
    return wide.agg(
        (F.count("*") - F.count_distinct("id")).alias("repeated_ids"), total(lambda p, y, t: p.isNull()).alias("missing"), total(lambda p, y, t: (p < 0) | (p > 1)).alias("out_of_range"),
        total(lambda p, y, t: (p >= t) != (y == 1)).alias("disagree"), total(lambda p, y, t: y == 1).alias("positives"),
    )


@query("g27_findings", f"{LONG}, r AS (SELECT label, avg(pred) AS rate FROM long GROUP BY label) SELECT label, CASE WHEN rate > 0.30 THEN 'over' WHEN rate < 0.001 THEN 'under' ELSE 'ok' END AS finding FROM r")
def g27(spark, d):
    r = gold_long(spark, d).groupBy("label").agg(F.avg("pred").alias("rate"))
    return r.select("label", F.when(F.col("rate") > 0.30, "over").when(F.col("rate") < 0.001, "under").otherwise("ok").alias("finding"))


@query("g28_cofire", f"{LONG} SELECT a.label AS missed, b.label AS fired, count(*) AS n FROM long a JOIN long b ON a.src_ord = b.src_ord AND a.label <> b.label WHERE a.y = 1 AND a.pred = 0 AND b.pred = 1 GROUP BY 1, 2")
def g28(spark, d):
    """Labels are few: pairs are made inside each row from its label arrays, no join."""
    wide = scored(table(spark, d, GOLD))
    missed = F.array_compact(F.array(*(F.when((F.col(c) == 1) & (F.col(f"pred_{c}") == 0), F.lit(c)) for c in L)))
    fired = F.array_compact(F.array(*(F.when(F.col(f"pred_{c}") == 1, F.lit(c)) for c in L)))
    rows = wide.select(F.explode(missed).alias("missed"), fired.alias("f")).select("missed", F.explode("f").alias("fired"))
    return rows.filter("missed <> fired").groupBy("missed", "fired").agg(F.count("*").alias("n"))


@query("g28_fp_cofire", f"{LONG} SELECT a.label AS fired, b.label AS gold, count(*) AS n FROM long a JOIN long b ON a.src_ord = b.src_ord AND a.label <> b.label WHERE a.y = 0 AND a.pred = 1 AND b.y = 1 GROUP BY 1, 2")
def g28_fp(spark, d):
    """The other half of g28: of the rows where a label fired wrongly, how often each other label is gold."""
    wide = scored(table(spark, d, GOLD))
    wrong = F.array_compact(F.array(*(F.when((F.col(c) == 0) & (F.col(f"pred_{c}") == 1), F.lit(c)) for c in L)))
    gold = F.array_compact(F.array(*(F.when(F.col(c) == 1, F.lit(c)) for c in L)))
    rows = wide.select(F.explode(wrong).alias("fired"), gold.alias("g")).select("fired", F.explode("g").alias("gold"))
    return rows.groupBy("fired", "gold").agg(F.count("*").alias("n"))


@query("g29_cooccurrence", f"{LONG} SELECT a.label AS first, b.label AS second, count(*) AS n FROM long a JOIN long b ON a.src_ord = b.src_ord AND a.label < b.label WHERE a.y = 1 AND b.y = 1 GROUP BY 1, 2")
def g29(spark, d):
    have = F.array_sort(F.array_compact(F.array(*(F.when(F.col(c) == 1, F.lit(c)) for c in L))))
    rows = table(spark, d, GOLD).select(F.explode(have).alias("first"), have.alias("h")).select("first", F.explode("h").alias("second"))
    return rows.filter("first < second").groupBy("first", "second").agg(F.count("*").alias("n"))


@query("g30_pair_recovery", f"{LONG} SELECT a.label AS first, b.label AS second, count(*) FILTER (a.pred = 1 AND b.pred = 1) AS both_found, count(*) FILTER (a.pred = 1 AND b.pred = 0) AS only_first, count(*) FILTER (a.pred = 0 AND b.pred = 1) AS only_second, count(*) FILTER (a.pred = 0 AND b.pred = 0) AS neither FROM long a JOIN long b ON a.src_ord = b.src_ord AND a.label < b.label WHERE a.y = 1 AND b.y = 1 GROUP BY 1, 2")
def g30(spark, d):
    have = F.array_compact(F.array(*(F.when(F.col(c) == 1, F.struct(F.lit(c).alias("l"), F.col(f"pred_{c}").alias("p"))) for c in L)))
    rows = scored(table(spark, d, GOLD)).select(F.explode(have).alias("a"), have.alias("h")).select("a", F.explode("h").alias("b")).filter("a.l < b.l")
    cases = {"both_found": (1, 1), "only_first": (1, 0), "only_second": (0, 1), "neither": (0, 0)}
    return rows.groupBy(F.col("a.l").alias("first"), F.col("b.l").alias("second")).agg(*(F.count_if((F.col("a.p") == x) & (F.col("b.p") == y)).alias(k) for k, (x, y) in cases.items()))


@query("g31_keyword_outcomes", " UNION ALL ".join(f"SELECT '{c}' AS label, kw, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 1) AS fp FROM (SELECT l.y, l.pred, regexp_matches({low('tweet')}, '{'|'.join(w)}') AS kw FROM ({long_sql()}) l JOIN {GOLD} g USING (src_ord) WHERE l.label = '{c}') GROUP BY kw" for c, w in X.FOCUS.items()))
def g31(spark, d):
    df = scored(table(spark, d, GOLD)).withColumn("t", T.low(F.col("tweet")))
    cells = F.array(*(F.struct(F.lit(c).alias("label"), T.any_of(F.col("t"), w).alias("kw"), F.col(c).alias("y"), F.col(f"pred_{c}").alias("pred")) for c, w in X.FOCUS.items()))
    long = df.select(F.inline(cells))
    return long.groupBy("label", "kw").agg(*(F.count_if(F.expr(M.OUTCOMES[k])).alias(k) for k in ("tp", "fn", "fp")))


@query("g32_near_threshold", f"{LONG} SELECT label, count(*) FILTER (abs(prob::DOUBLE - thr::DOUBLE) <= 0.02) AS within_02, count(*) FILTER (abs(prob::DOUBLE - thr::DOUBLE) <= 0.05) AS within_05, count(*) FILTER (abs(prob::DOUBLE - thr::DOUBLE) <= 0.10 AND y <> pred) AS errors_10 FROM long GROUP BY label")
def g32(spark, d):
    m = F.abs(F.col("prob").cast("double") - F.col("thr").cast("double"))
    return gold_long(spark, d).groupBy("label").agg(F.count_if(m <= 0.02).alias("within_02"), F.count_if(m <= 0.05).alias("within_05"), F.count_if((m <= 0.10) & (F.col("y") != F.col("pred"))).alias("errors_10"))


@query("g33_transitions", f"{LONG} SELECT label, y || '->' || pred AS change, count(*) AS n FROM long WHERE y <> pred GROUP BY 1, 2")
def g33(spark, d):
    return gold_long(spark, d).filter("y <> pred").groupBy("label", F.concat_ws("->", "y", "pred").alias("change")).agg(F.count("*").alias("n"))


@query("g34_rule_usage", " UNION ALL ".join(f"SELECT '{c}' AS label, '{n}' AS rule, count(*) AS n FROM {SILVER} WHERE regexp_matches({low('tweet')}, '{p}') HAVING count(*) > 0" for c, rules in X.RARE_RULES.items() for n, _, p in rules))
def g34(spark, d):
    t = table(spark, d, SILVER).select(T.low(F.col("tweet")).alias("t"))
    hits = F.array_compact(F.array(*(F.when(F.col("t").rlike(p), F.struct(F.lit(c).alias("label"), F.lit(n).alias("rule"))) for c, rules in X.RARE_RULES.items() for n, _, p in rules)))
    n = t.select(F.inline(hits)).groupBy("label", "rule").agg(F.count("*").alias("n"))
    return O.top_per_group(n, ["label"], [F.desc("n"), F.col("rule")], 8).drop("rank")


@query("g35_lengths_per_split", f"SELECT split_name, min(length(tweet)) AS shortest, max(length(tweet)) AS longest, round(avg(length(tweet)), 6) AS mean FROM {GOLD} GROUP BY split_name")
def g35(spark, d):
    n = F.length("tweet")
    return table(spark, d, GOLD).groupBy("split_name").agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"))


@query("g36_coverage_lift", f"SELECT before_n, after_n, round(CASE WHEN before_n = 0 THEN 0.0::DOUBLE ELSE (after_n - before_n)::DOUBLE / before_n * 100 END, 6) AS lift FROM (SELECT count(*) FILTER (extraction_method = 'keyword') AS before_n, count(*) FILTER (has_neighborhood) AS after_n FROM {EMERGENCY})")
def g36(spark, d):
    c = table(spark, d, EMERGENCY).agg(F.count_if(F.col("extraction_method") == "keyword").alias("before_n"), F.count_if("has_neighborhood").alias("after_n"))
    return c.withColumn("lift", F.round(N.ratio(F.col("after_n") - F.col("before_n"), F.col("before_n")) * 100, 6))


@query("g37_list_coverage", f"WITH top AS (SELECT neighborhood, count(*) AS n FROM {EMERGENCY} WHERE neighborhood IS NOT NULL GROUP BY 1 ORDER BY n DESC, neighborhood LIMIT 100) SELECT count(*) AS names, count(g.neighborhood_clean) AS covered FROM top LEFT JOIN (SELECT DISTINCT neighborhood_clean FROM gazetteer) g ON top.neighborhood = g.neighborhood_clean")
def g37(spark, d):
    top = P.frequency(table(spark, d, EMERGENCY), "neighborhood", top=100)
    known = table(spark, d, "gazetteer").select(F.col("neighborhood_clean").alias("neighborhood")).distinct().withColumn("known", F.lit(1))
    return top.join(known, "neighborhood", "left").agg(F.count("*").alias("names"), F.count("known").alias("covered"))


@query("g38_experiment_pivot", f"{LONG}, c AS (SELECT label_source AS tag, label, {_CONF} FROM long GROUP BY 1, 2), f AS (SELECT tag, label, round({_F1}, 6) AS f1 FROM c) SELECT label, max(f1) FILTER (tag = 'gold_base') AS gold_base, max(f1) FILTER (tag = 'gold_extension') AS gold_extension, max(f1) FILTER (tag = 'rare_label_pack') AS rare_label_pack, (SELECT tag FROM f g WHERE g.label = f.label ORDER BY f1 DESC, tag LIMIT 1) AS winner FROM f GROUP BY label")
def g38(spark, d):
    tags = ["gold_base", "gold_extension", "rare_label_pack"]
    f = M.confusion(gold_long(spark, d, "label_source"), "label_source").select(F.col("label_source").alias("tag"), "label", "f1")
    wide = f.groupBy("label").pivot("tag", tags).agg(F.max("f1"))
    best = O.keep_one(f, ["label"], [F.desc("f1"), F.col("tag")]).select("label", F.col("tag").alias("winner"))
    return wide.join(best, "label")


@query("g39_risk_flags", f"SELECT label, CASE WHEN n = 0 THEN 'absent' WHEN n < 10 THEN 'critical' WHEN n < 25 THEN 'low' WHEN share >= 0.9 THEN 'dominant' ELSE 'ok' END AS flag FROM (SELECT label, sum(y) AS n, avg(y) AS share FROM ({long_sql()}) GROUP BY label)")
def g39(spark, d):
    s = gold_long(spark, d).groupBy("label").agg(F.sum("y").alias("n"), F.avg("y").alias("share"))
    return s.select("label", F.when(F.col("n") == 0, "absent").when(F.col("n") < 10, "critical").when(F.col("n") < 25, "low").when(F.col("share") >= 0.9, "dominant").otherwise("ok").alias("flag"))


@query("g40_patterns", f"{LONG}, miss AS (SELECT label, count(*) AS m FROM long WHERE y = 1 AND pred = 0 GROUP BY label), co AS (SELECT a.label AS missed, b.label AS fired, count(*) AS n FROM long a JOIN long b ON a.src_ord = b.src_ord AND a.label <> b.label WHERE a.y = 1 AND a.pred = 0 AND b.pred = 1 GROUP BY 1, 2) SELECT missed, fired, n, round(n::DOUBLE / m, 6) AS share FROM co JOIN miss ON missed = label WHERE n >= 3 AND n::DOUBLE / m >= 0.4")
def g40(spark, d):
    missed = gold_long(spark, d).filter("y = 1 AND pred = 0").groupBy(F.col("label").alias("missed")).agg(F.count("*").alias("m"))
    co = g28(spark, d).join(missed, "missed")
    return co.filter("n >= 3 AND n / m >= 0.4").select("missed", "fired", "n", F.round(F.col("n") / F.col("m"), 6).alias("share"))


_SWEEP = f"{LONG}, grid AS (SELECT i AS s FROM range(5, 96) t(i)), sw AS (SELECT label, s / 100.0::DOUBLE AS thr, sum(CASE WHEN y = 1 AND floor(prob::DOUBLE * 100 + 1e-6) >= s THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND floor(prob::DOUBLE * 100 + 1e-6) >= s THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y = 1 AND floor(prob::DOUBLE * 100 + 1e-6) < s THEN 1 ELSE 0 END) AS fn {{extra}} FROM long, grid GROUP BY label, s {{group}})"
_SM = "round((2 * tp + 1.0::DOUBLE) / (2 * tp + fp + fn + 1.0::DOUBLE), 9)"


@query("w14_best_threshold", _SWEEP.format(extra="", group="") + f" SELECT label, thr, round(score, 6) AS score FROM (SELECT *, {_SM} AS score FROM sw) QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, thr) = 1")
def w14(spark, d):
    return M.best_thresholds(M.threshold_sweep(gold_long(spark, d)))


@query("w15_sensitivity", _SWEEP.format(extra="", group="") + f" SELECT label, thr, f1, recall FROM (SELECT label, thr, round({_F1}, 6) AS f1, round({_r('tp', '(tp + fn)')}, 6) AS recall, abs(thr - 0.5) AS dist FROM sw) QUALIFY row_number() OVER (PARTITION BY label ORDER BY f1 DESC, recall DESC, round(dist, 6), thr) = 1")
def w15(spark, d):
    s = M.threshold_sweep(gold_long(spark, d))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    s = s.select("label", "thr", F.round(N.ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"), F.round(N.ratio(tp, tp + fn), 6).alias("recall"))
    return O.keep_one(s, ["label"], [F.desc("f1"), F.desc("recall"), F.round(F.abs(F.col("thr") - 0.5), 6), F.col("thr")])


@query("m5_smoothed_f1", f"{LONG}, c AS (SELECT label, {_CONF} FROM long GROUP BY label) SELECT label, round((2 * tp + 1.0::DOUBLE) / (2 * tp + fp + fn + 1.0::DOUBLE), 6) AS score FROM c")
def m5(spark, d):
    return M.confusion(gold_long(spark, d)).select("label", F.round(N.smoothed_f1(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("score"))


@query("m7_least_margin", f"{LONG} SELECT src_ord, round(min(abs(prob::DOUBLE - thr::DOUBLE)), 6) AS margin FROM long GROUP BY src_ord")
def m7(spark, d):
    m = F.abs(F.col("prob").cast("double") - F.col("thr").cast("double"))
    return gold_long(spark, d).groupBy("src_ord").agg(F.round(F.min(m), 6).alias("margin"))


@query("a3_top_labels", f"{LONG} SELECT src_ord, label FROM long QUALIFY row_number() OVER (PARTITION BY src_ord ORDER BY prob DESC, label) <= 4")
def a3(spark, d):
    cells = F.array(*(F.struct((-F.col(f"prob_{c}")).alias("p"), F.lit(c).alias("label")) for c in L))
    return scored(table(spark, d, GOLD)).select("src_ord", F.inline(F.slice(F.array_sort(cells), 1, 4))).select("src_ord", "label")


@query("g41_fold_median", f"SELECT label, CAST(median(rate) AS DOUBLE) AS middle FROM (SELECT label, src_ord % 5 AS fold, round(avg(prob::DOUBLE), 4) AS rate FROM ({long_sql()}) GROUP BY 1, 2) GROUP BY label")
def g41(spark, d):
    folds = gold_long(spark, d).groupBy("label", (F.col("src_ord") % 5).alias("fold")).agg(F.round(F.avg(F.col("prob").cast("double")), 4).alias("rate"))
    return folds.groupBy("label").agg(F.round(F.median("rate"), 6).alias("middle"))


# order --------------------------------------------------------------------------------------------


@query("w1_mixed_sort", f"SELECT src_ord, row_number() OVER (ORDER BY urgency_score DESC, total_engagement DESC NULLS LAST, src_ord) AS place FROM {EMERGENCY} ORDER BY place LIMIT 200")
def w1(spark, d):
    """The first 200 of a mixed-direction sort with their places: a top-k report."""
    top = table(spark, d, EMERGENCY).select("src_ord", "urgency_score", "total_engagement").orderBy(F.desc("urgency_score"), F.desc_nulls_last("total_engagement"), "src_ord").limit(200)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("urgency_score"), F.desc_nulls_last("total_engagement"), "src_ord"))).select("src_ord", "place")


@query("w1_whole_sort", f"SELECT src_ord, row_number() OVER (ORDER BY urgency_score DESC, total_engagement DESC NULLS LAST, src_ord) AS place FROM {EMERGENCY}")
def w1_whole(spark, d):
    """Every row with its place in the mixed-direction sort, by ranges: no task sorts the whole table."""
    order = [F.desc("urgency_score"), F.desc_nulls_last("total_engagement"), F.asc("src_ord")]
    return O.place_in_group(table(spark, d, EMERGENCY).select("src_ord", "urgency_score", "total_engagement"), [], order).select("src_ord", "place")


@query("w2_eight_keys", f"SELECT src_ord, row_number() OVER (PARTITION BY split_name ORDER BY label_source, urgency_score DESC, province NULLS LAST, district NULLS LAST, neighborhood NULLS LAST, veracity_label NULLS LAST, id, src_ord) AS place FROM {GOLD}")
def w2(spark, d):
    nl = F.asc_nulls_last
    order = [F.asc("label_source"), F.desc("urgency_score"), nl("province"), nl("district"), nl("neighborhood"), nl("veracity_label"), F.asc("id"), F.asc("src_ord")]
    narrow = table(spark, d, GOLD).select("src_ord", "id", "split_name", "label_source", "urgency_score", "province", "district", "neighborhood", "veracity_label")
    return O.place_in_group(narrow, ["split_name"], order).select("src_ord", "place")


@query("w3_keep_first", f"SELECT id, src_ord, urgency_score FROM {EMERGENCY} QUALIFY row_number() OVER (PARTITION BY id ORDER BY src_ord) = 1")
def w3(spark, d):
    return O.keep_least(table(spark, d, EMERGENCY).select("id", "src_ord", "urgency_score"), ["id"], "src_ord")


@query("w4_keep_best", f"SELECT id, src_ord FROM {EMERGENCY} QUALIFY row_number() OVER (PARTITION BY id ORDER BY urgency_score DESC NULLS LAST, total_engagement DESC NULLS LAST, src_ord) = 1")
def w4(spark, d):
    df = table(spark, d, EMERGENCY).select("id", "src_ord", "urgency_score", "total_engagement")
    return O.keep_one(df, ["id"], [F.desc_nulls_last("urgency_score"), F.desc_nulls_last("total_engagement"), F.col("src_ord")]).select("id", "src_ord")


@query("w5_keep_by_text", f"SELECT min(src_ord) AS src_ord FROM {EMERGENCY} GROUP BY {overlap('tweet')}")
def w5(spark, d):
    df = table(spark, d, EMERGENCY).select(T.overlap_text(F.col("tweet")).alias("k"), "src_ord")
    return O.keep_least(df, ["k"], "src_ord").select("src_ord")


@query("w6_later_source_wins", f"SELECT id, src_ord, src FROM (SELECT id, src_ord, 0 AS src FROM {GOLD} WHERE label_source = 'gold_base' UNION ALL SELECT id, src_ord, 1 AS src FROM {GOLD} WHERE label_source <> 'gold_base') QUALIFY row_number() OVER (PARTITION BY id ORDER BY src DESC, src_ord DESC) = 1")
def w6(spark, d):
    g = table(spark, d, GOLD).select("id", "src_ord", "label_source")
    parts = [g.filter("label_source = 'gold_base'"), g.filter("label_source <> 'gold_base'")]
    return O.last_of_sources(parts, ["id"], "src_ord").select("id", "src_ord", F.col("source_rank").alias("src"))


_PRIO = {"osm": 1, "overpass": 2, "manual": 3}


@query("w7_source_priority", "SELECT gaz_id FROM gazetteer QUALIFY row_number() OVER (PARTITION BY neighborhood_normalized, province ORDER BY CASE source WHEN 'osm' THEN 1 WHEN 'overpass' THEN 2 WHEN 'manual' THEN 3 ELSE 9 END, gaz_id) = 1")
def w7(spark, d):
    prio = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in _PRIO.items() for x in kv)), F.col("source")), F.lit(9))
    return O.keep_one(table(spark, d, "gazetteer"), ["neighborhood_normalized", "province"], [prio, F.col("gaz_id")]).select("gaz_id")


@query("w8_mark_duplicates", f"SELECT src_ord, count(*) OVER (PARTITION BY user_id, tweet) > 1 AS is_duplicate FROM {EMERGENCY}")
def w8(spark, d):
    return O.mark_duplicates(table(spark, d, EMERGENCY).select("src_ord", "user_id", "tweet"), ["user_id", "tweet"]).select("src_ord", "is_duplicate")


@query("w9_most_engaged", f"SELECT user_id, src_ord FROM {EMERGENCY} QUALIFY row_number() OVER (PARTITION BY user_id, tweet ORDER BY total_engagement DESC NULLS LAST, src_ord) = 1")
def w9(spark, d):
    return O.keep_one(table(spark, d, EMERGENCY), ["user_id", "tweet"], [F.desc_nulls_last("total_engagement"), F.col("src_ord")]).select("user_id", "src_ord")


@query("w10_top_per_label", f"{LONG}, t AS (SELECT src_ord, label FROM long WHERE label IN ('guvenlik', 'psikolojik', 'bilgi_paylasimi') QUALIFY row_number() OVER (PARTITION BY label ORDER BY prob DESC, src_ord) <= 50) SELECT src_ord, string_agg(label, ',' ORDER BY label) AS labels FROM t GROUP BY src_ord")
def w10(spark, d):
    long = gold_long(spark, d).filter(F.col("label").isin(*X.RARE))
    top = O.top_per_group(long, ["label"], [F.desc("prob"), F.col("src_ord")], 50)
    return top.groupBy("src_ord").agg(F.array_join(F.sort_array(F.collect_list("label")), ",").alias("labels"))


@query("w11_error_examples", f"{LONG} SELECT label, kind, src_ord FROM (SELECT label, 'fp' AS kind, src_ord, row_number() OVER (PARTITION BY label ORDER BY prob DESC, src_ord) AS r FROM long WHERE y = 0 AND pred = 1 UNION ALL SELECT label, 'fn', src_ord, row_number() OVER (PARTITION BY label ORDER BY prob, src_ord) FROM long WHERE y = 1 AND pred = 0) WHERE r <= 5")
def w11(spark, d):
    long = gold_long(spark, d).filter("y <> pred").withColumn("kind", F.when(F.col("pred") == 1, "fp").otherwise("fn"))
    return O.top_per_group(long, ["label", "kind"], [F.when(F.col("pred") == 1, -F.col("prob")).otherwise(F.col("prob")), F.col("src_ord")], 5).select("label", "kind", "src_ord")


@query("w12_closest", f"{LONG}, r AS (SELECT src_ord, min(round(abs(prob::DOUBLE - thr::DOUBLE), 5)) AS margin FROM long GROUP BY src_ord) SELECT src_ord, margin FROM r ORDER BY margin, src_ord LIMIT 20")
def w12(spark, d):
    m = F.round(F.abs(F.col("prob").cast("double") - F.col("thr").cast("double")), 5)
    return gold_long(spark, d).groupBy("src_ord").agg(F.min(m).alias("margin")).orderBy("margin", "src_ord").limit(20)


@query("w13_rank_experiments", f"{LONG}, c AS (SELECT label_source AS tag, label, {_CONF} FROM long GROUP BY 1, 2), s AS (SELECT tag, round(avg({_F1}), 6) AS macro, round({_r('2 * sum(tp)', '(2 * sum(tp) + sum(fp) + sum(fn))')}, 6) AS micro FROM c GROUP BY tag) SELECT tag, macro, micro, row_number() OVER (ORDER BY macro DESC, micro DESC, tag) AS place FROM s")
def w13(spark, d):
    c = M.confusion(gold_long(spark, d, "label_source"), "label_source")
    s = M.micro_macro(c, "label_source").select(F.col("label_source").alias("tag"), F.col("f1_macro").alias("macro"), F.col("f1_micro").alias("micro"))
    return s.withColumn("place", F.row_number().over(W.orderBy(F.desc("macro"), F.desc("micro"), "tag")))


_MIN_F1 = ("altyapi", "guvenlik", "psikolojik")  # the rare labels of the reference's ranking


@query("w13_rank_with_rare", f"{LONG}, c AS (SELECT label_source AS tag, label, {_CONF} FROM long GROUP BY 1, 2), s AS (SELECT tag, round(avg({_F1}), 6) AS macro, round(min({_F1}) FILTER (label IN {_MIN_F1}), 6) AS rare_min, round({_r('2 * sum(tp)', '(2 * sum(tp) + sum(fp) + sum(fn))')}, 6) AS micro FROM c GROUP BY tag) SELECT *, row_number() OVER (ORDER BY macro DESC, rare_min DESC, micro DESC, tag) AS place FROM s")
def w13_rare(spark, d):
    return rank_with_rare(M.confusion(gold_long(spark, d, "label_source"), "label_source"), "label_source")


def rank_with_rare(conf, tag):
    """Tags by macro F1, then the least F1 of a rare label, then micro F1."""
    rare = conf.filter(F.col("label").isin(*_MIN_F1)).groupBy(tag).agg(F.min("f1").alias("rare_min"))
    s = M.micro_macro(conf, tag).join(rare, tag).select(F.col(tag).alias("tag"), F.col("f1_macro").alias("macro"), "rare_min", F.col("f1_micro").alias("micro"))
    return s.withColumn("place", F.row_number().over(W.orderBy(F.desc("macro"), F.desc("rare_min"), F.desc("micro"), "tag")))


@query("w16_two_per_place", f"SELECT neighborhood, src_ord FROM {GOLD} WHERE neighborhood IS NOT NULL QUALIFY row_number() OVER (PARTITION BY neighborhood ORDER BY src_ord) <= 2")
def w16(spark, d):
    return O.top_per_group(table(spark, d, GOLD).filter("neighborhood IS NOT NULL"), ["neighborhood"], [F.col("src_ord")], 2).select("neighborhood", "src_ord")


# sets ---------------------------------------------------------------------------------------------


@query("u1_union", f"SELECT id FROM {GOLD} UNION ALL SELECT id FROM {SILVER}")
def u1(spark, d):
    return table(spark, d, GOLD).select("id").unionByName(table(spark, d, SILVER).select("id"))


@query("u2_tagged_union", f"SELECT id, 'gold' AS source FROM {GOLD} UNION ALL SELECT id, 'silver' FROM {SILVER}")
def u2(spark, d):
    return reduce(lambda a, b: a.unionByName(b), (table(spark, d, t).select("id", F.lit(n).alias("source")) for t, n in ((GOLD, "gold"), (SILVER, "silver"))))


@query("u3_intersect", f"SELECT id FROM {GOLD} WHERE split_name = 'train' INTERSECT SELECT id FROM {GOLD} WHERE split_name <> 'train'")
def u3(spark, d):
    g = table(spark, d, GOLD)
    return g.filter("split_name = 'train'").select("id").intersect(g.filter("split_name <> 'train'").select("id"))


@query("u4_except_both", f"SELECT 'base' AS side, id FROM (SELECT id FROM {GOLD} WHERE label_source = 'gold_base' EXCEPT SELECT id FROM {GOLD} WHERE label_source <> 'gold_base') UNION ALL SELECT 'other', id FROM (SELECT id FROM {GOLD} WHERE label_source <> 'gold_base' EXCEPT SELECT id FROM {GOLD} WHERE label_source = 'gold_base')")
def u4(spark, d):
    g = table(spark, d, GOLD)
    a, b = g.filter("label_source = 'gold_base'").select("id"), g.filter("label_source <> 'gold_base'").select("id")
    return a.subtract(b).select(F.lit("base").alias("side"), "id").unionByName(b.subtract(a).select(F.lit("other").alias("side"), "id"))


@query("u5_distinct_union", f"SELECT id FROM {GOLD} UNION SELECT id FROM {SILVER}")
def u5(spark, d):
    return table(spark, d, GOLD).select("id").union(table(spark, d, SILVER).select("id")).distinct()


@query("u6_shared_across_sources", f"SELECT id, count(*) AS n FROM (SELECT DISTINCT id, label_source FROM {GOLD}) GROUP BY id HAVING count(*) > 1")
def u6(spark, d):
    return table(spark, d, GOLD).select("id", "label_source").distinct().groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
