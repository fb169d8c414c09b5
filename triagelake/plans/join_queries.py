"""Queries of joins, sampling, rule engines and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import lexicon as X
from triagelake.functions import numeric as N
from triagelake.functions import text as T
from triagelake.operators import joins as J
from triagelake.operators import metrics as M
from triagelake.operators import rules as R
from triagelake.operators import sampling as S
from triagelake.plans.agg_queries import _CONF, _F1, LONG, gold_long
from triagelake.plans.registry import query
from triagelake.plans.tables import EMERGENCY, GOLD, SILVER, low, overlap, quota_sql, sample_sql, scored, spread, table
from triagelake.plans.text_queries import _alt, _logit_sql, _signal_sql, info_signal, logit

L = X.LABELS
_FIRST = f"SELECT * FROM {GOLD} QUALIFY row_number() OVER (PARTITION BY id ORDER BY src_ord) = 1"
_A = f"(SELECT id, saglik, barinma, aciliyet_0_3, veracity_label FROM ({_FIRST}) WHERE urgency_score <= 7)"
_B = f"(SELECT id, CASE WHEN urgency_score % 3 = 0 THEN 1 - saglik ELSE saglik END AS saglik, barinma, least(3, urgency_score // 3) AS aciliyet_0_3, CASE WHEN urgency_score % 4 = 0 THEN '' ELSE veracity_label END AS veracity_label FROM ({_FIRST}) WHERE urgency_score >= 2)"


def annotators(spark, d):
    """Two overlapping annotator tables: the first row of each id, and a second opinion derived from it."""
    from triagelake.operators.order import keep_one

    g = keep_one(table(spark, d, GOLD), ["id"], [F.col("src_ord")])
    u = F.col("urgency_score")
    a = g.filter(u <= 7).select("id", "saglik", "barinma", "aciliyet_0_3", "veracity_label")
    b = g.filter(u >= 2).select(
        "id", F.when(u % 3 == 0, 1 - F.col("saglik")).otherwise(F.col("saglik")).alias("saglik"), "barinma",
        F.least(F.lit(3), F.floor(u / 3).cast("int")).alias("aciliyet_0_3"), F.when(u % 4 == 0, "").otherwise(F.col("veracity_label")).alias("veracity_label"),
    )
    return a, b


@query("j1_full_outer", f"SELECT coalesce(a.id, b.id) AS id, a.saglik AS saglik_a, b.saglik AS saglik_b, CASE WHEN b.id IS NULL THEN 'left_only' WHEN a.id IS NULL THEN 'right_only' ELSE 'both' END AS provenance FROM {_A} a FULL OUTER JOIN {_B} b ON a.id = b.id")
def j1(spark, d):
    a, b = annotators(spark, d)
    return J.full_outer(a, b, "id", ["saglik"])


@query("j2_left_join", f"SELECT g.src_ord, p.first_ord FROM {GOLD} g LEFT JOIN (SELECT id, min(src_ord) AS first_ord FROM {EMERGENCY} GROUP BY id) p ON g.id = p.id")
def j2(spark, d):
    pool = table(spark, d, EMERGENCY).groupBy("id").agg(F.min("src_ord").alias("first_ord"))
    return table(spark, d, GOLD).join(pool, "id", "left").select("src_ord", "first_ord")


@query("j3_exclude_ids", f"SELECT src_ord FROM {EMERGENCY} WHERE id NOT IN (SELECT id FROM {GOLD} WHERE id IS NOT NULL UNION SELECT id FROM {SILVER} WHERE id IS NOT NULL) OR id IS NULL")
def j3(spark, d):
    return J.exclude_ids(table(spark, d, EMERGENCY), [table(spark, d, GOLD), table(spark, d, SILVER)], "id").select("src_ord")


@query("j4_text_hash_semi", f"SELECT src_ord FROM {GOLD} WHERE {overlap('tweet')} <> '' AND sha1({overlap('tweet')}) IN (SELECT sha1({overlap('tweet')}) FROM {SILVER})")
def j4(spark, d):
    h = F.sha1(T.overlap_text(F.col("tweet"))).alias("h")
    g = table(spark, d, GOLD).select("src_ord", h, T.overlap_text(F.col("tweet")).alias("t")).filter("t <> ''")
    return g.join(table(spark, d, SILVER).select(h), "h", "left_semi").select("src_ord")


_NAMES = f"(SELECT DISTINCT {low('neighborhood_clean')} AS name FROM gazetteer)"


@query("j5_dictionary_words", f"WITH w AS (SELECT src_ord, list_filter(regexp_split_to_array({low('tweet')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {EMERGENCY}), t AS (SELECT src_ord, unnest(w) AS name FROM w) SELECT src_ord, name FROM t JOIN {_NAMES} n USING (name) QUALIFY row_number() OVER (PARTITION BY src_ord ORDER BY length(name) DESC, name) = 1")
def j5(spark, d):
    names = table(spark, d, "gazetteer").select(T.low(F.col("neighborhood_clean")).alias("name"))
    return J.dictionary_match(spread(table(spark, d, EMERGENCY).select("src_ord", "tweet")), "src_ord", T.low(F.col("tweet")), names, "name")


_DIM = "(SELECT neighborhood_clean, district, province FROM gazetteer QUALIFY row_number() OVER (PARTITION BY neighborhood_clean ORDER BY gaz_id) = 1)"


@query("j6_dimension_lookup", f"SELECT e.src_ord, g.district, g.province FROM {EMERGENCY} e LEFT JOIN {_DIM} g ON e.neighborhood = g.neighborhood_clean")
def j6(spark, d):
    from triagelake.operators.order import keep_least

    dim = keep_least(table(spark, d, "gazetteer").select("neighborhood_clean", "gaz_id", "district", "province"), ["neighborhood_clean"], "gaz_id")
    dim = dim.select(F.col("neighborhood_clean").alias("neighborhood"), "district", "province")
    return table(spark, d, EMERGENCY).select("src_ord", "neighborhood").join(J.small(dim), "neighborhood", "left").select("src_ord", "district", "province")


@query("j7_added_aliases", "SELECT DISTINCT alias FROM (SELECT trim(regexp_replace(neighborhood_name, '\\s+Mahallesi$', '')) AS alias FROM gazetteer) WHERE alias NOT IN (SELECT neighborhood_name FROM gazetteer)")
def j7(spark, d):
    g = table(spark, d, "gazetteer")
    alias = g.select(F.trim(F.regexp_replace("neighborhood_name", "\\s+Mahallesi$", "")).alias("alias")).distinct()
    return alias.join(g.select(F.col("neighborhood_name").alias("alias")), "alias", "left_anti")


@query("j8_near_duplicate_overlap")
def j8(spark, d):
    """Every gold row's most alike silver row: 5-shingle Jaccard of at least 0.85 over whole tables."""
    g, s = (spread(table(spark, d, t).select("src_ord", "tweet")) for t in (GOLD, SILVER))
    return J.near_duplicate_join(g, s, "src_ord", T.overlap_text(F.col("tweet")))


_CH = "concat_ws(',', CASE WHEN trim(coalesce(CAST(a.saglik AS VARCHAR), '')) <> trim(coalesce(CAST(b.saglik AS VARCHAR), '')) THEN 'saglik' END, CASE WHEN trim(coalesce(a.veracity_label, '')) <> trim(coalesce(b.veracity_label, '')) THEN 'veracity_label' END)"


@query("j9_changed_columns", f"SELECT a.id, {_CH} AS changed FROM {_A} a JOIN {_B} b ON a.id = b.id")
def j9(spark, d):
    a, b = annotators(spark, d)
    return J.changed_columns(a, b, "id", ["saglik", "veracity_label"]).select("id", "changed")


@query("j10_table_equality", f"SELECT side, count(*) AS n FROM (SELECT 'left' AS side, id, barinma FROM (SELECT id, barinma FROM {_A} EXCEPT ALL SELECT id, barinma FROM {_B}) UNION ALL SELECT 'right', id, barinma FROM (SELECT id, barinma FROM {_B} EXCEPT ALL SELECT id, barinma FROM {_A})) GROUP BY side")
def j10(spark, d):
    a, b = annotators(spark, d)
    return J.not_equal_tables(a.select("id", "barinma"), b.select("id", "barinma")).groupBy("side").agg(F.count("*").alias("n"))


@query("j11_missing_keys", f"SELECT DISTINCT district FROM {EMERGENCY} WHERE district IS NOT NULL AND district NOT IN (SELECT district FROM gazetteer WHERE district IS NOT NULL)")
def j11(spark, d):
    return table(spark, d, EMERGENCY).filter("district IS NOT NULL").select("district").distinct().join(table(spark, d, "gazetteer").select("district"), "district", "left_anti")


@query("j12_label_pairs", f"{LONG} SELECT a.label AS first, b.label AS second, count(*) AS n FROM (SELECT * FROM long WHERE pred = 1) a JOIN (SELECT * FROM long WHERE pred = 1) b ON a.src_ord = b.src_ord AND a.label < b.label GROUP BY 1, 2")
def j12(spark, d):
    have = F.array_compact(F.array(*(F.when(F.col(f"pred_{c}") == 1, F.lit(c)) for c in L)))
    rows = scored(table(spark, d, GOLD)).select(F.explode(have).alias("first"), have.alias("h")).select("first", F.explode("h").alias("second"))
    return rows.filter("first < second").groupBy("first", "second").agg(F.count("*").alias("n"))


# sampling -----------------------------------------------------------------------------------------


@query("k1_seeded_sample", f"SELECT src_ord FROM {SILVER} ORDER BY md5('42|' || id), id LIMIT 200")
def k1(spark, d):
    """A sampling operator: its size is the feature."""
    return S.uniform(table(spark, d, SILVER), 200, 42, "id").select("src_ord")


@query("k2_strata_quotas", f"SELECT src_ord FROM {SILVER} QUALIFY row_number() OVER (PARTITION BY province ORDER BY md5('42|' || id), id) <= 7")
def k2(spark, d):
    return S.per_stratum(table(spark, d, SILVER), ["province"], 7, 42, "id").select("src_ord")


@query("k3_proportional_allocation", f"SELECT g AS province, size, quota FROM ({quota_sql(SILVER, 'province', 300, 1)})")
def k3(spark, d):
    """Quotas of 300 rows over the provinces by largest remainder."""
    return S.allocated(table(spark, d, SILVER).select("province"), "province", 300, 1)


@query("k4_sample_by_date", sample_sql(SILVER, "date", 400, 42, "src_ord, date"))
def k4(spark, d):
    return S.proportional_sample(table(spark, d, SILVER).select("src_ord", "id", "date"), "date", 400, 42, "id").select("src_ord", "date")


@query("k5_tiered_sample", " UNION ALL ".join(sample_sql(f"(SELECT * FROM {SILVER} WHERE {w})", "date", 150, 42, f"src_ord, '{t}' AS tier") for t, w in (("top", "urgency_score >= 8"), ("high", "urgency_score BETWEEN 4 AND 7"))))
def k5(spark, d):
    """All of the top tier up to 150 rows, the rest from the next tier, by date."""
    s = table(spark, d, SILVER).select("src_ord", "id", "date", "urgency_score")
    top = S.proportional_sample(s.filter("urgency_score >= 8"), "date", 150, 42, "id").withColumn("tier", F.lit("top"))
    nxt = S.proportional_sample(s.filter("urgency_score BETWEEN 4 AND 7"), "date", 150, 42, "id").withColumn("tier", F.lit("high"))
    return top.unionByName(nxt).select("src_ord", "tier")


@query("k6_calibration_subset", f"SELECT src_ord, 'head' AS method FROM (SELECT src_ord FROM {SILVER} ORDER BY src_ord LIMIT 50) UNION ALL SELECT src_ord, 'random' FROM (SELECT src_ord FROM {SILVER} ORDER BY md5('7|' || id), id LIMIT 50)")
def k6(spark, d):
    s = table(spark, d, SILVER)
    head = s.orderBy("src_ord").limit(50).select("src_ord", F.lit("head").alias("method"))
    return head.unionByName(S.uniform(s, 50, 7, "id").select("src_ord", F.lit("random").alias("method")))


_SPLIT = f"SELECT src_ord, guvenlik, psikolojik, CASE WHEN size < 2 OR place <= floor(size * 0.8::DOUBLE + 0.5) THEN 'train' WHEN place <= floor(size * 0.9::DOUBLE + 0.5) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY veracity_label ORDER BY md5('42|' || id), id) AS place, count(*) OVER (PARTITION BY veracity_label) AS size FROM {SILVER})"


@query("k7_three_splits", f"SELECT src_ord, split FROM ({_SPLIT})")
def k7(spark, d):
    return S.split_three(table(spark, d, SILVER).select("src_ord", "id", "veracity_label"), ["veracity_label"], 42, "id", (0.8, 0.1)).select("src_ord", "split")


@query("k8_coverage_repair")
def k8(spark, d):
    df = S.split_three(table(spark, d, SILVER).select("src_ord", "id", "veracity_label", *L), ["veracity_label"], 42, "id")
    return S.repair_coverage(df, list(L), 42, "id").select("src_ord", "split")


@query("k9_multilabel_folds")
def k9(spark, d):
    return S.multilabel_folds(table(spark, d, SILVER).select("src_ord", "id", *L), list(L), 5, 42, "id").select("src_ord", "fold")


@query("k10_shuffle", f"SELECT src_ord, md5('9|' || id) AS place FROM {SILVER}")
def k10(spark, d):
    return table(spark, d, SILVER).select("src_ord", S.seeded(9).alias("place")).orderBy("place")


@query("k11_annotator_copies", f"SELECT src_ord, annotator FROM {GOLD}, (VALUES ('A'), ('B')) t(annotator)")
def k11(spark, d):
    return table(spark, d, GOLD).select("src_ord", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("annotator"))


# rules --------------------------------------------------------------------------------------------


def _any(words) -> str:
    return f"regexp_matches(t, '{_alt(words)}')"


def _weak_sql(profile: str, source: str) -> str:
    bank = X.WEAK[profile]
    cols = ", ".join(f"CASE WHEN {_any(w)} THEN 1 ELSE 0 END AS {c}" for c, w in bank.items())
    none = " AND ".join(f"NOT {_any(w)}" for w in bank.values())
    info = f"CASE WHEN {none} AND {_any(X.INFO_WORDS)} AND NOT {_any(X.URGENT_WORDS)} AND NOT {_any(X.HELP_WORDS)} THEN 1 ELSE 0 END AS bilgi_paylasimi"
    sev = f"greatest(0, CASE WHEN {_any(X.URGENT_WORDS)} THEN 3 ELSE 0 END, CASE WHEN {_any(bank['arama_kurtarma'])} THEN 3 ELSE 0 END, CASE WHEN {_any(bank['saglik'])} THEN 2 ELSE 0 END, CASE WHEN {_any(X.HELP_WORDS)} THEN 1 ELSE 0 END) AS severity"
    return f"SELECT src_ord, {cols}, {info}, {sev}, CASE WHEN {_any(X.DOUBT_WORDS)} THEN 'supheli' ELSE 'dogrulanmis' END AS credibility FROM (SELECT src_ord, {low(source)} AS t FROM {SILVER})"


@query("r1_weak_labels", _weak_sql("A", "tweet"))
def r1(spark, d):
    t = spread(table(spark, d, SILVER).select("src_ord", "tweet")).select("src_ord", T.low(F.col("tweet")).alias("t"))
    return t.select("src_ord", *(v.alias(k) for k, v in R.weak_labels(F.col("t"), "A").items()))


@query("r2_weak_labels_cautious", _weak_sql("B", "coalesce(nullif(trim(coalesce(tweet_clean, '')), ''), tweet)"))
def r2(spark, d):
    text = F.coalesce(F.nullif(F.trim(F.coalesce(F.col("tweet_clean"), F.lit(""))), F.lit("")), F.col("tweet"))
    t = table(spark, d, SILVER).select("src_ord", T.low(text).alias("t"))
    return t.select("src_ord", *(v.alias(k) for k, v in R.weak_labels(F.col("t"), "B").items()))


def _score_sql(c: str) -> str:
    rules = X.RARE_RULES[c]
    total = " + ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN {w} ELSE 0 END" for _, w, p in rules)
    positive = " OR ".join(f"regexp_matches(t, '{p}')" for _, w, p in rules if w > 0)
    names = ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{n}' END" for n, _, p in rules)
    return f"CASE WHEN {positive} THEN greatest(0, {total}) ELSE 0 END AS {c}_score, concat_ws(';', {names}) AS {c}_rules"


_CAND = f"SELECT src_ord, {', '.join(_score_sql(c) for c in X.RARE)} FROM (SELECT src_ord, {low('tweet')} AS t FROM {SILVER})"


def candidates(spark, d):
    t = spread(table(spark, d, SILVER).select("src_ord", "tweet")).select("src_ord", T.low(F.col("tweet")).alias("t")).select("src_ord", *(R.scored_rules(F.col("t"), c).alias(c) for c in X.RARE))
    return t.select("src_ord", *(F.col(f"{c}.{k}").alias(f"{c}_{k}") for c in X.RARE for k in ("score", "rules")))


@query("r3_scored_rules", _CAND)
def r3(spark, d):
    return candidates(spark, d)


@query("r4_candidate_table", f"SELECT src_ord, concat_ws(',', {', '.join(f"CASE WHEN {c}_score > 0 THEN '{c}' END" for c in X.RARE)}) AS labels, greatest({', '.join(f'{c}_score' for c in X.RARE)}) AS best FROM ({_CAND}) WHERE greatest({', '.join(f'{c}_score' for c in X.RARE)}) > 0")
def r4(spark, d):
    c = candidates(spark, d)
    best = F.greatest(*(F.col(f"{x}_score") for x in X.RARE))
    return c.filter(best > 0).select("src_ord", T.true_flags({x: F.col(f"{x}_score") > 0 for x in X.RARE}).alias("labels"), best.alias("best"))


@query("r5_override_reasons", f"SELECT src_ord, CASE WHEN regexp_matches(t, '{_alt(X.DOUBT_WORDS)}') THEN 0 WHEN regexp_matches(t, '{_alt(X.FOCUS['guvenlik'])}') THEN 1 ELSE 0 END AS guvenlik, CASE WHEN regexp_matches(t, '{_alt(X.DOUBT_WORDS)}') THEN 'unconfirmed' WHEN regexp_matches(t, '{_alt(X.FOCUS['guvenlik'])}') THEN 'keyword' ELSE 'none' END AS reason FROM (SELECT src_ord, {low('tweet')} AS t FROM {SILVER})")
def r5(spark, d):
    t = F.col("t")
    doubt, hit = T.any_of(t, X.DOUBT_WORDS), T.any_of(t, X.FOCUS["guvenlik"])
    got = F.when(doubt, F.struct(F.lit(0).alias("y"), F.lit("unconfirmed").alias("r"))).when(hit, F.struct(F.lit(1).alias("y"), F.lit("keyword").alias("r"))).otherwise(F.struct(F.lit(0).alias("y"), F.lit("none").alias("r")))
    return table(spark, d, SILVER).select("src_ord", T.low(F.col("tweet")).alias("t")).select("src_ord", got.alias("g")).select("src_ord", F.col("g.y").alias("guvenlik"), F.col("g.r").alias("reason"))


@query("r6_severity_floor", f"SELECT src_ord, least(3, greatest(coalesce(aciliyet_0_3, 0), CASE WHEN arama_kurtarma = 1 THEN 3 ELSE 0 END, CASE WHEN saglik = 1 THEN 2 ELSE 0 END, CASE WHEN guvenlik = 1 THEN 2 ELSE 0 END)) AS severity FROM {GOLD}")
def r6(spark, d):
    floor = lambda c, k: F.when(F.col(c) == 1, k).otherwise(0)
    return table(spark, d, GOLD).select("src_ord", F.least(F.lit(3), F.greatest(F.coalesce("aciliyet_0_3", F.lit(0)), floor("arama_kurtarma", 3), floor("saglik", 2), floor("guvenlik", 2))).alias("severity"))


@query("r7_completed_pack", f"SELECT count(*) AS n, sum(CASE WHEN c.guvenlik_score > 0 AND g.guvenlik = 1 THEN 1 ELSE 0 END) AS confirmed, sum(CASE WHEN c.guvenlik_score > 0 AND coalesce(g.guvenlik, 0) <> 1 THEN 1 ELSE 0 END) AS added FROM {SILVER} g JOIN ({_CAND}) c USING (src_ord)")
def r7(spark, d):
    j = table(spark, d, SILVER).select("src_ord", "guvenlik").join(candidates(spark, d), "src_ord")
    hit = F.col("guvenlik_score") > 0
    return j.agg(F.count("*").alias("n"), F.count_if(hit & (F.col("guvenlik") == 1)).alias("confirmed"), F.count_if(hit & (F.coalesce("guvenlik", F.lit(0)) != 1)).alias("added"))


_BOTH = f"SELECT coalesce(a.id, b.id) AS id, a.saglik AS saglik_a, b.saglik AS saglik_b, a.barinma AS barinma_a, b.barinma AS barinma_b, a.aciliyet_0_3 AS aciliyet_0_3_a, b.aciliyet_0_3 AS aciliyet_0_3_b, a.veracity_label AS veracity_label_a, b.veracity_label AS veracity_label_b FROM {_A} a FULL OUTER JOIN {_B} b ON a.id = b.id"


@query("r8_adjudication", f"SELECT id, CASE WHEN saglik_a = saglik_b THEN saglik_a END AS saglik_final, CASE WHEN barinma_a = barinma_b THEN barinma_a END AS barinma_final, coalesce(saglik_a <> saglik_b, FALSE) OR coalesce(barinma_a <> barinma_b, FALSE) AS needs_adjudication FROM ({_BOTH})")
def r8(spark, d):
    a, b = annotators(spark, d)
    return R.adjudicate(J.full_outer(a, b, "id", ["saglik", "barinma"]), ["saglik", "barinma"]).select("id", "saglik_final", "barinma_final", "needs_adjudication")


_X, _Y = (f"nullif(trim(coalesce(veracity_label_{s}, '')), '')" for s in "ab")


@query("r9_auto_adjudication", f"SELECT id, greatest(saglik_a, saglik_b) AS saglik_final, greatest(aciliyet_0_3_a, aciliyet_0_3_b) AS aciliyet_0_3_final, CASE WHEN {_X} = {_Y} THEN {_X} WHEN {_X} IS NULL THEN {_Y} WHEN {_Y} IS NULL THEN {_X} ELSE 'supheli' END AS credibility FROM ({_BOTH})")
def r9(spark, d):
    a, b = annotators(spark, d)
    j = R.settle(J.full_outer(a, b, "id", ["saglik", "aciliyet_0_3", "veracity_label"]), ["saglik"], "aciliyet_0_3")
    return j.select("id", "saglik_final", "aciliyet_0_3_final", R.cautious_credibility(F.col("veracity_label_a"), F.col("veracity_label_b")).alias("credibility"))


@query("r10_export_guard", f"SELECT count(*) FILTER (CASE WHEN saglik_a = saglik_b THEN saglik_a END IS NULL) AS blank_finals, count(*) AS n FROM ({_BOTH})")
def r10(spark, d):
    a, b = annotators(spark, d)
    f = R.adjudicate(J.full_outer(a, b, "id", ["saglik"]), ["saglik"])
    return f.agg(F.count_if(F.col("saglik_final").isNull()).alias("blank_finals"), F.count("*").alias("n"))


_KW = f"nullif(trim(regexp_extract(coalesce(tweet, ''), '{X.PLACE_PATTERNS['mahallesi']}', 1)), '')"


@query("r11_precedence", f"SELECT src_ord, coalesce({_KW}, neighborhood) AS place, CASE WHEN {_KW} IS NOT NULL THEN 'keyword' WHEN neighborhood IS NOT NULL THEN 'gazetteer' END AS method FROM {EMERGENCY}")
def r11(spark, d):
    kw = F.nullif(F.trim(F.regexp_extract(T.text_or_empty(F.col("tweet")), X.PLACE_PATTERNS["mahallesi"], 1)), F.lit(""))
    return table(spark, d, EMERGENCY).select("src_ord", F.coalesce(kw, F.col("neighborhood")).alias("place"), F.when(kw.isNotNull(), "keyword").when(F.col("neighborhood").isNotNull(), "gazetteer").alias("method"))


_INFO = f"{LONG}, i AS (SELECT l.src_ord, l.split_name, l.y, l.pred AS before_pred, CASE WHEN l.pred = 0 AND l.prob >= CAST(0.2 AS FLOAT) AND {_signal_sql('g.t')} THEN 1 ELSE l.pred END AS after_pred FROM long l JOIN (SELECT src_ord, {low('tweet')} AS t FROM {GOLD}) g USING (src_ord) WHERE l.label = 'bilgi_paylasimi')"


def information(spark, d):
    df = scored(table(spark, d, GOLD)).withColumn("t", T.low(F.col("tweet")))
    p = F.col("pred_bilgi_paylasimi")
    return df.select("src_ord", "split_name", F.col("bilgi_paylasimi").alias("y"), p.alias("before_pred"), R.raise_information(p, F.col("prob_bilgi_paylasimi"), info_signal(F.col("t"))).alias("after_pred"))


@query("r12_postprocess", f"{_INFO} SELECT src_ord, before_pred, after_pred FROM i")
def r12(spark, d):
    return information(spark, d).select("src_ord", "before_pred", "after_pred")


@query("r13_profile_comparison", f"{_INFO}, p AS (SELECT split_name, 'off' AS label, y, before_pred AS pred FROM i UNION ALL SELECT split_name, 'on', y, after_pred FROM i), c AS (SELECT split_name, label, {_CONF} FROM p GROUP BY 1, 2) SELECT split_name, label AS profile, tp, fp, fn, round({_F1}, 6) AS f1 FROM c")
def r13(spark, d):
    i = information(spark, d)
    cells = F.array(F.struct(F.lit("off").alias("label"), F.col("before_pred").alias("pred")), F.struct(F.lit("on").alias("label"), F.col("after_pred").alias("pred")))
    long = i.select("split_name", "y", F.inline(cells))
    return M.confusion(long, "split_name").select("split_name", F.col("label").alias("profile"), "tp", "fp", "fn", "f1")


@query("r14_dimension_rows", "SELECT province, coalesce(region, 'Unknown') AS region, coalesce(priority, 0) AS priority FROM (SELECT DISTINCT province FROM gazetteer) LEFT JOIN (VALUES " + ", ".join(f"('{n}', '{r}', {p})" for r, (p, names) in X.REGIONS.items() for n in names) + ") t(name, region, priority) ON province = name")
def r14(spark, d):
    cat = spark.createDataFrame([(name, r, p) for r, (p, names) in X.REGIONS.items() for name in names], "province string, region string, priority int")
    return table(spark, d, "gazetteer").select("province").distinct().join(F.broadcast(cat), "province", "left").select("province", F.coalesce("region", F.lit("Unknown")).alias("region"), F.coalesce("priority", F.lit(0)).alias("priority"))


# scoring ------------------------------------------------------------------------------------------


@query("x1_linear_scores", f"SELECT vec_id, round({_logit_sql()}, 6) AS z, CASE WHEN round(1 / (1 + exp(-({_logit_sql()}))), 6) >= 0.5 THEN 1 ELSE 0 END AS pred FROM embeddings")
def x1(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", logit(F.col("embedding")).alias("z"))
    return df.select("vec_id", F.round("z", 6).alias("z"), (F.round(N.sigmoid(F.col("z")), 6) >= 0.5).cast("int").alias("pred"))


@query("x2_adapter", f"SELECT src_ord, sum(pred) AS label_count, max(pred) AS any_need FROM ({LONG} SELECT * FROM long) GROUP BY src_ord")
def x2(spark, d):
    """Texts to scores, predictions and derived columns in one projection."""
    df = scored(table(spark, d, GOLD))
    p = [F.col(f"pred_{c}") for c in L]
    return df.select("src_ord", sum(p[1:], p[0]).alias("label_count"), F.greatest(*p).alias("any_need"))


@query("x4_fold_scores")
def x4(spark, d):
    f = S.multilabel_folds(table(spark, d, GOLD).select("src_ord", "id", *L), list(L), 5, 42, "id").select("src_ord", "fold")
    return gold_long(spark, d).join(f, "src_ord").groupBy("fold", "label").agg(F.round(F.avg(F.col("prob").cast("double")), 6).alias("mean_prob"), F.sum("y").alias("positives"))


_PROBE = "SELECT name, expected, " + low("text") + " AS t FROM (VALUES " + ", ".join(f"('{n}', '{t}', {list(e)})" for n, t, e in X.PROBES) + ") p(name, text, expected)"
_PROBE_Y = {c: _any(X.WEAK["A"][c]) for c in X.WEAK["A"]}
_PROBE_INFO = f"NOT ({' OR '.join(_PROBE_Y.values())}) AND {_any(X.INFO_WORDS)} AND NOT {_any(X.URGENT_WORDS)} AND NOT {_any(X.HELP_WORDS)}"


@query("x6_probe_set", f"SELECT name, expected, found, len(list_filter(expected, lambda x: NOT list_contains(found, x))) = 0 AS covered FROM (SELECT name, expected, list_filter([{', '.join(f"CASE WHEN {_PROBE_Y.get(c, _PROBE_INFO)} THEN '{c}' END" for c in L)}], lambda x: x IS NOT NULL) AS found FROM ({_PROBE}))")
def x6(spark, d):
    df = spark.createDataFrame([(n, t, list(e)) for n, t, e in X.PROBES], "name string, text string, expected array<string>")
    y = R.weak_labels(T.low(F.col("text")), "A")
    got = F.array_compact(F.array(*(F.when(y[c] == 1, F.lit(c)) for c in L)))
    return df.select("name", "expected", got.alias("found"), (F.size(F.array_except("expected", got)) == 0).alias("covered"))


@query("x7_artifact_audit", "SELECT label, abs(threshold - other) <= 1e-6 AS same FROM (VALUES " + ", ".join(f"('{c}', {t}::DOUBLE, {t}::FLOAT::DOUBLE)" for c, t in X.THRESHOLDS.items()) + ") t(label, threshold, other)")
def x7(spark, d):
    df = spark.createDataFrame(list(X.THRESHOLDS.items()), "label string, threshold double")
    return df.select("label", (F.abs(F.col("threshold") - F.col("threshold").cast("float").cast("double")) <= 1e-6).alias("same"))
