"""Queries of scans, projections, coercions, text functions and scalars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from triagelake.functions import coerce as K
from triagelake.functions import lexicon as X
from triagelake.functions import numeric as N
from triagelake.functions import text as T
from triagelake.plans.registry import query
from triagelake.plans.tables import EMERGENCY, GOLD, SILVER, clean, fold, low, overlap, spread, squash, table
from triagelake.sources.readers import available, parts_union, with_text

L = X.LABELS


def _alt(words) -> str:
    return "|".join(words)


@query("s1_scan_profile", f"SELECT count(*) AS n, count(tweet) AS tweets, count(DISTINCT id) AS ids, min(src_ord) AS first_ord, max(src_ord) AS last_ord FROM {EMERGENCY}")
def s1(spark, d):
    return table(spark, d, EMERGENCY).agg(F.count("*").alias("n"), F.count("tweet").alias("tweets"), F.count_distinct("id").alias("ids"), F.min("src_ord").alias("first_ord"), F.max("src_ord").alias("last_ord"))


@query("s3_pruned_scan", f"SELECT src_ord, id, '' AS missing_column, tweet_clean FROM {SILVER}")
def s3(spark, d):
    return available(table(spark, d, SILVER), ["src_ord", "id", "missing_column", "tweet_clean"])


@query("s4_text_fallback", f"SELECT src_ord, coalesce(nullif(trim(coalesce(tweet_clean, '')), ''), tweet) AS text FROM {GOLD}")
def s4(spark, d):
    return with_text(table(spark, d, GOLD), ["src_ord"], "tweet_clean", "tweet").select("src_ord", "text")


@query("s5_parts_in_order", f"SELECT * FROM (SELECT 1 AS part, src_ord, id FROM {GOLD} UNION ALL SELECT 2 AS part, src_ord, id FROM {SILVER})")
def s5(spark, d):
    return parts_union([table(spark, d, GOLD).select("src_ord", "id"), table(spark, d, SILVER).select("src_ord", "id")])


@query("s6_threshold_map", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {X.THRESHOLDS.get(c, 0.5)}::DOUBLE)" for c in (*L, "other")) + ") t(label, threshold)")
def s6(spark, d):
    m = F.create_map(*(F.lit(x) for kv in X.THRESHOLDS.items() for x in kv))
    return spark.createDataFrame([(c,) for c in (*L, "other")], "label string").select("label", F.coalesce(F.try_element_at(m, F.col("label")), F.lit(0.5)).alias("threshold"))


@query("s7_json_documents", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def s7(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@query("s11_nested_first_non_empty", f"SELECT src_ord, coalesce(nullif(trim(coalesce(neighborhood, '')), ''), nullif(trim(coalesce(district, '')), ''), nullif(trim(coalesce(province, '')), '')) AS place FROM {EMERGENCY}")
def s11(spark, d):
    packed = table(spark, d, EMERGENCY).select("src_ord", F.to_json(F.struct("neighborhood", "district", "province")).alias("j"))
    got = packed.select("src_ord", F.from_json("j", "neighborhood string, district string, province string").alias("a"))
    return got.select("src_ord", F.coalesce(*(F.nullif(K.blank(F.col(f"a.{c}")), F.lit("")) for c in ("neighborhood", "district", "province"))).alias("place"))


@query("s15_split_manifest", f"SELECT split_name, count(*) AS n, sum(CASE WHEN guvenlik = 1 THEN 1 ELSE 0 END) AS guvenlik FROM {GOLD} GROUP BY split_name")
def s15(spark, d):
    return table(spark, d, GOLD).groupBy("split_name").agg(F.count("*").alias("n"), F.count_if(F.col("guvenlik") == 1).alias("guvenlik"))


@query("s16_file_fingerprints")
def s16(spark, d):
    from triagelake.sources.readers import fingerprints

    return fingerprints(spark, d)


@query("s18_head", f"SELECT src_ord, id FROM {GOLD} ORDER BY src_ord LIMIT 100")
def s18(spark, d):
    """The first rows in file order, as a debugging aid: the limit is the feature."""
    return table(spark, d, GOLD).orderBy("src_ord").limit(100).select("src_ord", "id")


@query("proj1_available_columns", f"SELECT src_ord, id, tweet FROM {SILVER}")
def proj1(spark, d):
    df = table(spark, d, SILVER)
    return df.select([c for c in ("src_ord", "id", "tweet", "language") if c in df.columns])


@query("proj2_renamed", f"SELECT id, saglik AS saglik_final, barinma AS barinma_final FROM {GOLD}")
def proj2(spark, d):
    return table(spark, d, GOLD).select("id", "saglik", "barinma").withColumnsRenamed({c: f"{c}_final" for c in ("saglik", "barinma")})


@query("proj3_blank_template", f"SELECT src_ord, '' AS saglik, '' AS barinma, '' AS notes FROM {GOLD}")
def proj3(spark, d):
    return table(spark, d, GOLD).select("src_ord").withColumns({c: F.lit("") for c in ("saglik", "barinma", "notes")})


_ADDR = f"regexp_matches(coalesce(tweet_clean, ''), '{_alt(X.ADDRESS)}')"


@query("proj4_compound_filter", f"""SELECT count(*) AS n, count(*) FILTER (kl) AS keyword_location, count(*) FILTER (ua) AS urgent_address, count(*) FILTER (kl OR ua) AS kept FROM (
    SELECT coalesce(has_emergency_keywords AND has_location_keywords, FALSE) AS kl, coalesce(urgency_score >= 3, FALSE) AND {_ADDR} AS ua FROM {EMERGENCY})""")
def proj4(spark, d):
    kl = F.coalesce(F.col("has_emergency_keywords") & F.col("has_location_keywords"), F.lit(False))
    ua = F.coalesce(F.col("urgency_score") >= 3, F.lit(False)) & (T.findall(F.col("tweet_clean"), X.ADDRESS) != "")
    df = table(spark, d, EMERGENCY).select(kl.alias("kl"), ua.alias("ua"))
    return df.agg(F.count("*").alias("n"), F.count_if("kl").alias("keyword_location"), F.count_if("ua").alias("urgent_address"), F.count_if(F.col("kl") | F.col("ua")).alias("kept"))


@query("proj5_long_enough", f"SELECT src_ord, length(tweet_clean) AS n FROM {SILVER} WHERE length(coalesce(tweet_clean, '')) > 40 AND trim(coalesce(tweet_clean, '')) <> ''")
def proj5(spark, d):
    c = T.text_or_empty(F.col("tweet_clean"))
    return table(spark, d, SILVER).filter((F.length(c) > 40) & (F.trim(c) != "")).select("src_ord", F.length(c).alias("n"))


@query("proj6_range_tier", f"SELECT src_ord, urgency_score FROM {SILVER} WHERE urgency_score BETWEEN 3 AND 6")
def proj6(spark, d):
    return table(spark, d, SILVER).filter(F.col("urgency_score").between(3, 6)).select("src_ord", "urgency_score")


@query("proj7_row_sums", f"SELECT src_ord, {' + '.join(f'coalesce({c}, 0)' for c in L)} AS label_count, CASE WHEN greatest({', '.join(f'coalesce({c}, 0)' for c in L)}) >= 1 THEN 1 ELSE 0 END AS any_need FROM {GOLD}")
def proj7(spark, d):
    y = [F.coalesce(F.col(c), F.lit(0)) for c in L]
    return table(spark, d, GOLD).select("src_ord", reduce(lambda a, b: a + b, y).alias("label_count"), (F.greatest(*y) >= 1).cast("int").alias("any_need"))


_LEN = "length(coalesce(tweet, ''))"


@query("proj8_length_buckets", f"""SELECT src_ord, CASE WHEN {_LEN} <= 40 THEN '<=40' WHEN {_LEN} <= 80 THEN '<=80' WHEN {_LEN} <= 140 THEN '<=140' WHEN {_LEN} <= 220 THEN '<=220' ELSE '>220' END AS qa,
    CASE WHEN {_LEN} < 60 THEN 'short' WHEN {_LEN} < 140 THEN 'medium' ELSE 'long' END AS error_length, CASE WHEN {_LEN} < 120 THEN 'short' WHEN {_LEN} < 220 THEN 'medium' ELSE 'long' END AS stress FROM {GOLD}""")
def proj8(spark, d):
    n = F.length(T.text_or_empty(F.col("tweet")))
    return table(spark, d, GOLD).select(
        "src_ord", N.bucket(n, [(40, "<=40"), (80, "<=80"), (140, "<=140"), (220, "<=220")], ">220").alias("qa"),
        N.bucket(n, [(60, "short"), (140, "medium")], "long", False).alias("error_length"), N.bucket(n, [(120, "short"), (220, "medium")], "long", False).alias("stress"),
    )


@query("proj9_urgency_buckets", f"""SELECT b AS bucket, count(*) AS n FROM (SELECT CASE WHEN u IS NULL THEN 'nan' WHEN u <= 0.2 THEN '0.0-0.2' WHEN u <= 0.4 THEN '0.2-0.4' WHEN u <= 0.6 THEN '0.4-0.6' WHEN u <= 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS b FROM
    (SELECT CAST(urgency_score AS DOUBLE) / 10 AS u FROM {GOLD})) GROUP BY b""")
def proj9(spark, d):
    u = F.col("urgency_score").cast("double") / 10
    b = F.when(u.isNull() | F.isnan(u), "nan").otherwise(N.bucket(u, [(0.2, "0.0-0.2"), (0.4, "0.2-0.4"), (0.6, "0.4-0.6"), (0.8, "0.6-0.8")], "0.8-1.0"))
    return table(spark, d, GOLD).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("proj10_priority_tier", f"SELECT src_ord, CASE WHEN urgency_score >= 8 THEN 'top' WHEN urgency_score BETWEEN 4 AND 7 THEN 'high' WHEN urgency_score BETWEEN 1 AND 3 THEN 'mid' ELSE 'low' END AS tier FROM {SILVER}")
def proj10(spark, d):
    u = F.col("urgency_score")
    return table(spark, d, SILVER).select("src_ord", F.when(u >= 8, "top").when(u.between(4, 7), "high").when(u.between(1, 3), "mid").otherwise("low").alias("tier"))


@query("proj11_cardinality", f"SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN k >= 3 THEN '3+' ELSE CAST(k AS VARCHAR) END AS bucket FROM (SELECT {' + '.join(f'(CASE WHEN {c} = 1 THEN 1 ELSE 0 END)' for c in L)} AS k FROM {GOLD})) GROUP BY bucket")
def proj11(spark, d):
    k = reduce(lambda a, b: a + b, (F.when(F.col(c) == 1, 1).otherwise(0) for c in L))
    return table(spark, d, GOLD).groupBy(F.when(k >= 3, "3+").otherwise(k.cast("string")).alias("bucket")).agg(F.count("*").alias("n"))


@query("proj12_text_type", f"SELECT src_ord, CASE {' '.join(f"WHEN regexp_matches({fold('tweet')}, '{p.translate(str.maketrans('ığüşöç', 'igusoc'))}') THEN '{k}'" for k, p in X.TEXT_TYPES)} ELSE 'other' END AS kind FROM {GOLD}")
def proj12(spark, d):
    text = T.ascii_fold(F.col("tweet"))
    kinds = reduce(lambda acc, kp: acc.when(text.rlike(kp[1].translate(str.maketrans(*T.FOLDED))), kp[0]), X.TEXT_TYPES, F)
    return table(spark, d, GOLD).select("src_ord", kinds.otherwise("other").alias("kind"))


@query("proj13_media_flags", f"SELECT src_ord, coalesce(photos <> '[]', FALSE) AS has_photos, coalesce(urls <> '[]', FALSE) AS has_urls FROM {EMERGENCY}")
def proj13(spark, d):
    return table(spark, d, EMERGENCY).select("src_ord", *(F.coalesce(F.col(c) != "[]", F.lit(False)).alias(f"has_{c}") for c in ("photos", "urls")))


@query("proj14_engagement", f"SELECT src_ord, coalesce(total_engagement, 0) + coalesce(urgency_score, 0) AS weight FROM {EMERGENCY}")
def proj14(spark, d):
    return table(spark, d, EMERGENCY).select("src_ord", (F.coalesce(F.col("total_engagement"), F.lit(0)) + F.coalesce(F.col("urgency_score"), F.lit(0))).alias("weight"))


_FLAT = "regexp_replace(coalesce(tweet, ''), '[\\r\\n]+', ' ', 'g')"


@query("proj15_excerpt", f"SELECT src_ord, CASE WHEN length({_FLAT}) > 220 THEN substring({_FLAT}, 1, 220) || '...' ELSE {_FLAT} END AS preview, CASE WHEN length({_FLAT}) > 80 THEN substring({_FLAT}, 1, 80) || '…' ELSE {_FLAT} END AS short FROM {GOLD}")
def proj15(spark, d):
    return table(spark, d, GOLD).select("src_ord", T.excerpt(F.col("tweet"), 220).alias("preview"), T.excerpt(F.col("tweet"), 80, "…").alias("short"))


@query("proj16_label_set", f"SELECT src_ord, concat_ws(',', {', '.join(f"CASE WHEN {c} = 1 THEN '{c}' END" for c in L)}) AS labels FROM {GOLD}")
def proj16(spark, d):
    return table(spark, d, GOLD).select("src_ord", T.true_flags({c: F.col(c) == 1 for c in L}).alias("labels"))


@query("proj17_reason", f"SELECT src_ord, concat_ws(' | ', {', '.join(f"CASE WHEN {c} = 1 THEN '{c}:' || CAST(urgency_score AS VARCHAR) END" for c in X.RARE)}) AS reason FROM {GOLD}")
def proj17(spark, d):
    parts = [F.when(F.col(c) == 1, F.concat(F.lit(f"{c}:"), F.col("urgency_score").cast("string"))) for c in X.RARE]
    return table(spark, d, GOLD).select("src_ord", F.concat_ws(" | ", *parts).alias("reason"))


@query("proj18_place_pair", f"SELECT src_ord, coalesce(province, '') || ' / ' || coalesce(district, '') AS place FROM {GOLD}")
def proj18(spark, d):
    return table(spark, d, GOLD).select("src_ord", F.concat(F.coalesce("province", F.lit("")), F.lit(" / "), F.coalesce("district", F.lit(""))).alias("place"))


@query("proj19_safe_number", "SELECT event_id, CASE WHEN v IS NULL THEN NULL WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE 'fraction' END AS n FROM (SELECT event_id, round(value) AS v FROM events)")
def proj19(spark, d):
    x = K.safe_number(F.round("value").cast("string"))
    return table(spark, d, "events").select("event_id", F.when(x.contains("."), "fraction").otherwise(x).alias("n"))


# coercions -------------------------------------------------------------------------------------

_RAW = "(VALUES (1, ''), (2, 'evet'), (3, 'hayır'), (4, '1.0'), (5, '2'), (6, 'abc'), (7, NULL), (8, ' YES '), (9, '0'), (10, '3'), (11, 'Şüpheli'), (12, 'verified'), (13, 'fake'), (14, 'maybe'), (15, '12.0')) t(k, v)"


def _raw(spark):
    rows = [(1, ""), (2, "evet"), (3, "hayır"), (4, "1.0"), (5, "2"), (6, "abc"), (7, None), (8, " YES "), (9, "0"), (10, "3"), (11, "Şüpheli"), (12, "verified"), (13, "fake"), (14, "maybe"), (15, "12.0")]
    return spark.createDataFrame(rows, "k int, v string")


_NUM = "TRY_CAST(TRY_CAST(trim(v) AS DOUBLE) AS INTEGER)"
_W = "lower(trim(coalesce(v, '')))"


def _bool_sql(zero: bool) -> str:
    t, f = (", ".join(f"'{w}'" for w in x) for x in (K.TRUE_WORDS, K.FALSE_WORDS))
    return f"CASE WHEN {_W} IN ({t}) THEN 1 WHEN {_W} IN ({f}) THEN 0{f" WHEN {_W} = '' THEN 0" if zero else ''} END"


@query("c1_strict_binary", f"SELECT src_ord, {', '.join(f'CASE WHEN coalesce({c}, 0) IN (0, 1) THEN coalesce({c}, 0) END AS {c}' for c in ('saglik', 'guvenlik'))}, coalesce(guvenlik, 0) NOT IN (0, 1) AS violation FROM {GOLD}")
def c1(spark, d):
    """Violations are reported; the strict form itself is applied where there are none."""
    ok = {c: F.when(~K.binary_violation(F.col(c)), K.strict_binary(F.when(~K.binary_violation(F.col(c)), F.col(c)))) for c in ("saglik", "guvenlik")}
    return table(spark, d, GOLD).select("src_ord", *(v.alias(c) for c, v in ok.items()), K.binary_violation(F.col("guvenlik")).alias("violation"))


@query("c2_lenient_binary", f"SELECT k, coalesce({_NUM}, 0) AS value FROM {_RAW}")
def c2(spark, d):
    return _raw(spark).select("k", K.lenient_binary(F.col("v")).alias("value"))


@query("c3_boolean_words", f"SELECT k, {_bool_sql(False)} AS missing, {_bool_sql(True)} AS zero FROM {_RAW}")
def c3(spark, d):
    return _raw(spark).select("k", K.boolean_word(F.col("v")).alias("missing"), K.boolean_word(F.col("v"), True).alias("zero"))


@query("c4_boolean_violations", f"SELECT k, v FROM {_RAW} WHERE ({_bool_sql(False)}) IS NULL")
def c4(spark, d):
    return _raw(spark).filter(K.boolean_word(F.col("v")).isNull())


@query("c5_ordinal", f"SELECT src_ord, CASE WHEN aciliyet_0_3 IN (0, 1, 2, 3) THEN aciliyet_0_3 END AS missing, CASE WHEN aciliyet_0_3 IN (0, 1, 2, 3) THEN aciliyet_0_3 ELSE 0 END AS zero FROM {GOLD}")
def c5(spark, d):
    return table(spark, d, GOLD).select("src_ord", K.ordinal(F.col("aciliyet_0_3")).alias("missing"), K.ordinal(F.col("aciliyet_0_3"), invalid=0).alias("zero"))


@query("c6_credibility", f"SELECT k, CASE {' '.join(f"WHEN {_W} = '{a}' THEN '{b}'" for a, b in K.CREDIBILITY.items())} ELSE {_W} END AS class FROM {_RAW}")
def c6(spark, d):
    return _raw(spark).select("k", K.credibility(F.col("v")).alias("class"))


@query("c7_int_default", f"SELECT k, coalesce(TRY_CAST(TRY_CAST(trim(v) AS DOUBLE) AS BIGINT), -1) AS n FROM {_RAW}")
def c7(spark, d):
    return _raw(spark).select("k", K.int_or(F.col("v"), -1).alias("n"))


_COERCED = [*L, "veracity_label"]
_CLASS = f"CASE {' '.join(f"WHEN {_W} = '{a}' THEN '{b}'" for a, b in K.CREDIBILITY.items())} ELSE {_W} END"


@query("c2_gold_coercions", f"SELECT src_ord, name, v, coalesce({_NUM}, 0) AS lenient, {_bool_sql(False)} AS missing, {_bool_sql(True)} AS zero, ({_bool_sql(False)}) IS NULL AS violation, {_CLASS} AS class, coalesce(TRY_CAST(TRY_CAST(trim(v) AS DOUBLE) AS BIGINT), -1) AS n FROM ({' UNION ALL '.join(f"SELECT src_ord, '{c}' AS name, {c}::VARCHAR AS v FROM {GOLD}" for c in _COERCED)})")
def c2_gold(spark, d):
    """The coercions of c2, c3, c4, c6 and c7 on every label and credibility cell of gold, as text."""
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in _COERCED))
    v, word = F.col("v"), K.boolean_word(F.col("v"))
    return table(spark, d, GOLD).select("src_ord", F.inline(cells)).select(
        "src_ord", "name", "v", K.lenient_binary(v).alias("lenient"), word.alias("missing"), K.boolean_word(v, True).alias("zero"), word.isNull().alias("violation"), K.credibility(v).alias("class"), K.int_or(v, -1).alias("n")
    )


@query("c8_dates", f"SELECT src_ord, TRY_CAST(CASE WHEN regexp_matches(date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN date END AS DATE) AS day FROM {EMERGENCY}")
def c8(spark, d):
    day = F.when(F.col("date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("date")).try_cast("date")
    return table(spark, d, EMERGENCY).select("src_ord", day.alias("day"))


@query("c9_blank_canonical", f"SELECT src_ord, trim(coalesce(neighborhood, '')) AS neighborhood, trim(coalesce(veracity_label, '')) AS veracity_label FROM {GOLD}")
def c9(spark, d):
    return table(spark, d, GOLD).select("src_ord", K.blank(F.col("neighborhood")).alias("neighborhood"), K.blank(F.col("veracity_label")).alias("veracity_label"))


@query("c10_half_even", "SELECT event_id, round_even(value, 1) AS v FROM events")
def c10(spark, d):
    return table(spark, d, "events").select("event_id", F.bround("value", 1).alias("v"))


# text -------------------------------------------------------------------------------------------


@query("t1_clean", f"SELECT src_ord, {clean('tweet')} AS text FROM {GOLD}")
def t1(spark, d):
    return table(spark, d, GOLD).select("src_ord", T.clean(F.col("tweet")).alias("text"))


@query("t2_ascii_fold", f"SELECT src_ord, {fold('tweet')} AS text FROM {EMERGENCY}")
def t2(spark, d):
    return table(spark, d, EMERGENCY).select("src_ord", T.ascii_fold(F.col("tweet")).alias("text"))


@query("t3_strip_accents", f"SELECT src_ord, {squash(f"regexp_replace(translate({low('tweet')}, '{T.ACCENTED[0] + T.FOLDED[0]}', '{T.ACCENTED[1] + T.FOLDED[1]}'), '\\p{{M}}', '', 'g')")} AS text FROM {EMERGENCY}")
def t3(spark, d):
    return table(spark, d, EMERGENCY).select("src_ord", T.strip_accents(F.col("tweet")).alias("text"))


@query("t4_rule_text", f"SELECT doc_id, {squash(f"replace({low('text')}, 'ß', 'ss')")} AS text FROM documents")
def t4(spark, d):
    return table(spark, d, "documents").select("doc_id", T.rule_text(F.col("text")).alias("text"))


@query("t5_overlap_text", f"SELECT src_ord, {overlap('tweet')} AS text FROM {GOLD}")
def t5(spark, d):
    return table(spark, d, GOLD).select("src_ord", T.overlap_text(F.col("tweet")).alias("text"))


_PN = f"trim(regexp_replace({low('neighborhood_name')}, '\\s+(mahallesi|mahalle|mah\\.?|mh\\.?|köyü|semti)\\s*$', '', 'g'))"


@query("t6_place_name", f"SELECT gaz_id, {_PN} AS clean, translate({_PN}, 'ığüşöç', 'igusoc') AS normalized FROM gazetteer")
def t6(spark, d):
    return table(spark, d, "gazetteer").select("gaz_id", T.place_name(F.col("neighborhood_name")).alias("p")).select("gaz_id", "p.clean", "p.normalized")


@query("t7_any_of", f"SELECT src_ord, regexp_matches({low('tweet')}, '{_alt(X.EMERGENCY)}') AS emergency, regexp_matches({low('tweet')}, '{_alt(X.LOCATION)}') AS location, regexp_matches({low('tweet')}, '{_alt(X.AREA)}') AS area FROM {EMERGENCY}")
def t7(spark, d):
    t = T.low(F.col("tweet"))
    return table(spark, d, EMERGENCY).select("src_ord", T.any_of(t, X.EMERGENCY).alias("emergency"), T.any_of(t, X.LOCATION).alias("location"), T.any_of(t, X.AREA).alias("area"))


@query("t8_weighted_score", f"SELECT src_ord, {' + '.join(f"CASE WHEN contains({fold('tweet')}, '{w}') THEN {k} ELSE 0 END" for k, ws in X.URGENCY.values() for w in ws)} AS score FROM {EMERGENCY}")
def t8(spark, d):
    return table(spark, d, EMERGENCY).select("src_ord", T.ascii_fold(F.col("tweet")).alias("t")).select("src_ord", T.weighted_score(F.col("t"), X.URGENCY).alias("score"))


@query("t9_address_parts", f"SELECT src_ord, array_to_string(flatten([{', '.join(f"regexp_extract_all(coalesce(tweet, ''), '{p}')" for p in X.ADDRESS)}]), ' | ') AS parts FROM {EMERGENCY}")
def t9(spark, d):
    return table(spark, d, EMERGENCY).select("src_ord", T.findall(F.col("tweet"), X.ADDRESS).alias("parts"))


@query("t10_official_mention", f"SELECT src_ord, coalesce(regexp_matches(lower(mentions), '{_alt(X.OFFICIAL)}'), FALSE) AS official FROM {EMERGENCY}")
def t10(spark, d):
    return table(spark, d, EMERGENCY).select("src_ord", F.coalesce(F.lower("mentions").rlike(_alt(X.OFFICIAL)), F.lit(False)).alias("official"))


_G1 = [f"nullif(trim(regexp_extract(coalesce(tweet, ''), '{p}', 1)), '')" for p in X.PLACE_PATTERNS.values()]


@query("t11_first_pattern", f"SELECT src_ord, coalesce({', '.join(_G1)}) AS value, CASE {' '.join(f"WHEN {g} IS NOT NULL THEN '{k}'" for g, k in zip(_G1, X.PLACE_PATTERNS))} END AS pattern FROM {EMERGENCY}")
def t11(spark, d):
    return table(spark, d, EMERGENCY).select("src_ord", T.first_group(F.col("tweet"), X.PLACE_PATTERNS).alias("g")).select("src_ord", "g.value", "g.pattern")


@query("t12_one_pattern", f"SELECT src_ord, regexp_extract(coalesce(tweet, ''), '([\\p{{L}}]+) (Mahallesi|ilçesi)', 1) AS value FROM {EMERGENCY}")
def t12(spark, d):
    return table(spark, d, EMERGENCY).select("src_ord", F.regexp_extract(T.text_or_empty(F.col("tweet")), "([\\p{L}]+) (Mahallesi|ilçesi)", 1).alias("value"))


@query("t13_all_groups", f"SELECT value, count(*) AS n FROM (SELECT unnest(flatten([{', '.join(f"regexp_extract_all(coalesce(tweet, ''), '{p}', 1)" for p in X.PLACE_PATTERNS.values())}])) AS value FROM {EMERGENCY}) WHERE trim(value) <> '' GROUP BY value")
def t13(spark, d):
    got = table(spark, d, EMERGENCY).select(F.explode(T.all_groups(F.col("tweet"), list(X.PLACE_PATTERNS.values()))).alias("value"))
    return got.groupBy("value").agg(F.count("*").alias("n"))


_WW = "(^|[^\\p{L}\\p{N}_])(%s)([^\\p{L}\\p{N}_]|$)"


@query("t14_whole_word", f"SELECT src_ord FROM {EMERGENCY} WHERE regexp_matches({low('tweet')}, '{_WW % _alt(('sokak', 'kat', 'daire'))}')")
def t14(spark, d):
    return table(spark, d, EMERGENCY).filter(T.any_word(T.low(F.col("tweet")), ("sokak", "kat", "daire"))).select("src_ord")


@query("t15_pattern_bank", " UNION ALL ".join(f"SELECT '{p}' AS profile, '{c}' AS label, count(*) FILTER (regexp_matches({low('tweet')}, '{_alt(w)}')) AS n FROM {SILVER}" for p, bank in X.WEAK.items() for c, w in bank.items()))
def t15(spark, d):
    """All patterns of both profiles in one scan, then one row per profile and label."""
    t = spread(table(spark, d, SILVER).select("tweet")).select(T.low(F.col("tweet")).alias("t"))
    keys = [(p, c, w) for p, bank in X.WEAK.items() for c, w in bank.items()]
    one = t.agg(*(F.count_if(T.any_of(F.col("t"), w)).alias(f"{p}__{c}") for p, c, w in keys))
    cells = F.array(*(F.struct(F.lit(p).alias("profile"), F.lit(c).alias("label"), F.col(f"{p}__{c}").alias("n")) for p, c, _ in keys))
    return one.select(F.inline(cells))


def _signal_sql(text: str) -> str:
    m, r, c, a = (f"regexp_matches({text}, '{X.INFO_SIGNALS[k]}')" for k in "mrca")
    return f"(({m} AND {r}) OR ({m} AND {c}) OR ({r} AND {c}) OR {a})"


def info_signal(text):
    m, r, c, a = (text.rlike(X.INFO_SIGNALS[k]) for k in "mrca")
    return (m & r) | (m & c) | (r & c) | a


@query("t16_conjunctive_signal", f"SELECT src_ord, {_signal_sql(low('tweet'))} AS signal FROM {GOLD}")
def t16(spark, d):
    return table(spark, d, GOLD).select("src_ord", T.low(F.col("tweet")).alias("t")).select("src_ord", info_signal(F.col("t")).alias("signal"))


@query("t17_split_list", f"SELECT src_ord, array_to_string(list_filter(list_transform(string_split(coalesce(mentions, ''), ','), lambda x: trim(x)), lambda x: x <> ''), ';') AS items FROM {EMERGENCY}")
def t17(spark, d):
    return table(spark, d, EMERGENCY).select("src_ord", F.concat_ws(";", T.split_list(F.col("mentions"))).alias("items"))


@query("t18_shingles", f"SELECT src_ord, len(list_distinct(list_filter(list_transform(range(1, greatest(length({overlap('tweet')}) - 4, 1) + 1), lambda i: substring({overlap('tweet')}, i, 5)), lambda x: x <> ''))) AS shingles FROM {GOLD}")
def t18(spark, d):
    return table(spark, d, GOLD).select("src_ord", T.overlap_text(F.col("tweet")).alias("t")).select("src_ord", F.size(T.shingles(F.col("t"))).alias("shingles"))


def _words_sql(c: str) -> str:
    return f"list_distinct(list_filter(string_split({overlap(c)}, ' '), lambda x: x <> ''))"


@query("t19_jaccard", f"""SELECT src_ord, round(CASE WHEN len(a) + len(b) - len(list_intersect(a, b)) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS similarity
    FROM (SELECT src_ord, {_words_sql('tweet')} AS a, {_words_sql('tweet_clean')} AS b FROM {GOLD})""")
def t19(spark, d):
    words = lambda c: F.array_distinct(F.filter(F.split(T.overlap_text(F.col(c)), " "), lambda x: x != ""))
    df = table(spark, d, GOLD).select("src_ord", words("tweet").alias("a"), words("tweet_clean").alias("b"))
    return df.select("src_ord", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("t20_text_hash", f"SELECT src_ord, sha1({overlap('tweet')}) AS h FROM {GOLD}")
def t20(spark, d):
    return table(spark, d, GOLD).select("src_ord", F.sha1(T.overlap_text(F.col("tweet"))).alias("h"))


@query("t21_hashtags_removed", f"SELECT src_ord, regexp_matches(regexp_replace({low('tweet')}, '#[\\p{{L}}\\p{{N}}_]+', ' ', 'g'), '{_alt(X.FOCUS['guvenlik'])}') AS hit FROM {GOLD}")
def t21(spark, d):
    t = F.regexp_replace(T.low(F.col("tweet")), "#[\\p{L}\\p{N}_]+", " ")
    return table(spark, d, GOLD).select("src_ord", T.any_of(t, X.FOCUS["guvenlik"]).alias("hit"))


@query("t22_placeholders", f"SELECT count(*) FILTER (lower(trim(coalesce(neighborhood, ''))) IN ('unknown', 'nan', 'n/a', 'none', 'null', '-')) AS n FROM {EMERGENCY}")
def t22(spark, d):
    return table(spark, d, EMERGENCY).agg(F.count_if(T.is_placeholder(F.col("neighborhood"))).alias("n"))


@query("t23_lengths", f"SELECT src_ord, length(tweet) AS n FROM {EMERGENCY}")
def t23(spark, d):
    return table(spark, d, EMERGENCY).select("src_ord", F.length("tweet").alias("n"))


# numbers, dates, arrays, json ---------------------------------------------------------------------


def _logit_sql() -> str:
    return "list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * ((i % 7) - 3))) / 8.0::DOUBLE"


def logit(embedding):
    """A fixed linear scorer over the vector."""
    terms = F.transform(embedding, lambda x, i: x.cast("double") * (F.pmod(i + 1, F.lit(7)) - 3))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 8.0


@query("m1_sigmoid", f"SELECT vec_id, round(1 / (1 + exp(-z)), 6) AS p FROM (SELECT vec_id, {_logit_sql()} AS z FROM embeddings)")
def m1(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(N.sigmoid(logit(F.col("embedding"))), 6).alias("p"))


@query("m2_float_threshold", f"SELECT src_ord, CAST(((src_ord * 37) % 500) / 1000.0::DOUBLE AS FLOAT) >= CAST(0.45 AS FLOAT) AS over FROM {GOLD}")
def m2(spark, d):
    return table(spark, d, GOLD).select("src_ord", N.at_least(F.pmod(F.col("src_ord") * 37, F.lit(500)) / 1000.0, F.lit(0.45)).alias("over"))


@query("m3_tolerance", f"SELECT count(*) FILTER (abs(p - 0.45::DOUBLE) <= 1e-5::DOUBLE + 1e-5::DOUBLE * 0.45) AS near FROM (SELECT ((src_ord * 37) % 500) / 1000.0::DOUBLE AS p FROM {GOLD})")
def m3(spark, d):
    return table(spark, d, GOLD).agg(F.count_if(N.close_to(F.pmod(F.col("src_ord") * 37, F.lit(500)) / 1000.0, F.lit(0.45))).alias("near"))


@query("m4_safe_ratio", f"SELECT province, round(CASE WHEN count(*) FILTER (saglik = 1) = 0 THEN 0.0::DOUBLE ELSE count(*) FILTER (guvenlik = 1)::DOUBLE / count(*) FILTER (saglik = 1) END, 6) AS r FROM {GOLD} GROUP BY province")
def m4(spark, d):
    return table(spark, d, GOLD).groupBy("province").agg(F.round(N.ratio(F.count_if(F.col("guvenlik") == 1), F.count_if(F.col("saglik") == 1)), 6).alias("r"))


@query("m6_pos_weight", " UNION ALL ".join(f"SELECT '{c}' AS label, round(CASE WHEN p = 0 THEN 1.0::DOUBLE ELSE greatest(1.0::DOUBLE, least(20.0::DOUBLE, greatest(1.0::DOUBLE, n::DOUBLE / p))) END, 6) AS w FROM (SELECT count(*) FILTER ({c} = 1) AS p, count(*) FILTER ({c} = 0) AS n FROM {GOLD} WHERE split_name = 'train')" for c in L))
def m6(spark, d):
    df = table(spark, d, GOLD).filter("split_name = 'train'")
    one = df.agg(*(F.count_if(F.col(c) == 1).alias(f"p_{c}") for c in L), *(F.count_if(F.col(c) == 0).alias(f"n_{c}") for c in L))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("label"), F.round(N.pos_weight(F.col(f"p_{c}"), F.col(f"n_{c}")), 6).alias("w")) for c in L))))


@query("m8_threshold_grid", "SELECT i / 100.0::DOUBLE AS thr FROM range(5, 96) t(i)")
def m8(spark, d):
    return spark.range(5, 96).select((F.col("id") / 100.0).alias("thr"))


@query("d1_time_span", f"SELECT min(created_at) AS first_at, max(created_at) AS last_at, CAST(floor((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 86400000000) AS BIGINT) AS days FROM {EMERGENCY}")
def d1(spark, d):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    lo, hi = F.min("created_at"), F.max("created_at")
    return table(spark, d, EMERGENCY).agg(lo.alias("first_at"), hi.alias("last_at"), F.floor((us(hi) - us(lo)) / 86400000000).alias("days"))


@query("d2_day", f"SELECT src_ord, CAST(created_at AS DATE) AS day FROM {EMERGENCY}")
def d2(spark, d):
    return table(spark, d, EMERGENCY).select("src_ord", F.to_date("created_at").alias("day"))


_PRI = {"guvenlik": 1, "psikolojik": 2, "bilgi_paylasimi": 3}


@query("a1_best_priority", f"SELECT src_ord, coalesce(least({', '.join(f'CASE WHEN {c} = 1 THEN {k} END' for c, k in _PRI.items())}), 999) AS priority FROM {GOLD}")
def a1(spark, d):
    prio = F.create_map(*(F.lit(x) for kv in _PRI.items() for x in kv))
    labels = F.array_compact(F.array(*(F.when(F.col(c) == 1, F.lit(c)) for c in _PRI)))
    return table(spark, d, GOLD).select("src_ord", F.coalesce(F.array_min(F.transform(labels, lambda x: F.try_element_at(prio, x))), F.lit(999)).alias("priority"))


@query("a2_overlap", f"SELECT src_ord, (guvenlik = 1 OR psikolojik = 1) IS TRUE AS hit FROM {GOLD}")
def a2(spark, d):
    labels = F.array_compact(F.array(*(F.when(F.col(c) == 1, F.lit(c)) for c in L)))
    return table(spark, d, GOLD).select("src_ord", F.arrays_overlap(labels, F.array(F.lit("guvenlik"), F.lit("psikolojik"))).alias("hit"))


@query("a4_map_default", f"SELECT src_ord, CASE veracity_label WHEN 'dogrulanmis' THEN 1.0::DOUBLE WHEN 'supheli' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS trust FROM {GOLD}")
def a4(spark, d):
    m = F.create_map(F.lit("dogrulanmis"), F.lit(1.0), F.lit("supheli"), F.lit(0.5))
    return table(spark, d, GOLD).select("src_ord", F.coalesce(F.try_element_at(m, F.col("veracity_label")), F.lit(0.25)).alias("trust"))


@query("json1_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json1(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("q_urgency_triage", f"""SELECT src_ord, id, score, {clean('tweet_clean')} AS text FROM (SELECT *, {' + '.join(f"CASE WHEN contains({fold('tweet')}, '{w}') THEN {k} ELSE 0 END" for k, ws in X.URGENCY.values() for w in ws)} AS score FROM {EMERGENCY})
    WHERE (regexp_matches({low('tweet')}, '{_alt(X.EMERGENCY)}') AND regexp_matches({low('tweet')}, '{_alt(X.LOCATION)}')) OR (score >= 3 AND regexp_matches(coalesce(tweet, ''), '{_alt(X.ADDRESS)}'))""")
def triage(spark, d):
    """Scan, clean, flag, score and filter: the flagship."""
    df = spread(table(spark, d, EMERGENCY).select("src_ord", "id", "tweet", "tweet_clean"))
    df = df.withColumn("score", T.weighted_score(T.ascii_fold(F.col("tweet")), X.URGENCY))
    flagged = T.bind(T.low(F.col("tweet")), lambda t: T.any_of(t, X.EMERGENCY) & T.any_of(t, X.LOCATION))
    keep = flagged | ((F.col("score") >= 3) & T.any_of(F.col("tweet"), X.ADDRESS))
    return df.filter(keep).select("src_ord", "id", "score", T.clean(F.col("tweet_clean")).alias("text")).orderBy(F.desc("score"), "src_ord")
