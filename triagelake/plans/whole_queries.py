"""Queries that say an operator's whole job where an older statement says less; each with its own SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagelake.functions import forms
from triagelake.functions import lexicon as X
from triagelake.functions import numeric as N
from triagelake.functions import text as T
from triagelake.operators import joins as J
from triagelake.operators import metrics as M
from triagelake.operators import order as O
from triagelake.operators import rules as R
from triagelake.operators import sampling as S
from triagelake.operators import scoring as Z
from triagelake.plans.agg_queries import _F1, LONG, gold_long
from triagelake.plans.join_queries import _A, _B, _BOTH, _any, _CAND, annotators, candidates
from triagelake.plans.registry import query
from triagelake.plans.tables import GOLD, SILVER, low, overlap, quota_sql, sample_sql, scored, squash, table
from triagelake.sources import readers, sinks
from triagelake.store import shared_dir

L = X.LABELS

# text forms ---------------------------------------------------------------------------------------


@query("t1_clean_composed", f"SELECT src_ord, {squash("nfc_normalize(coalesce(tweet, ''))")} AS text FROM {GOLD}")
def t1_composed(spark, d):
    """NFC before white space is squashed."""
    return table(spark, d, GOLD).select("src_ord", forms.clean(F.col("tweet")).alias("text"))


# full-width forms and what they are compatible with, by rule
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")


@query("t3_strip_all_accents", f"SELECT src_ord, {squash(f"translate(strip_accents(lower(replace(translate(coalesce(tweet, ''), '{_WIDE[0]}', '{_WIDE[1]}'), '…', '...'))), 'ı', 'i')")} AS text FROM {GOLD}")
def t3_all(spark, d):
    """Marks of every script and compatibility forms, by NFKD."""
    return table(spark, d, GOLD).select("src_ord", forms.strip_accents(F.col("tweet")).alias("text"))


@query("t4_rule_tokens", f"SELECT src_ord, array_to_string(list_filter(regexp_split_to_array(replace({low("nfc_normalize(coalesce(tweet, ''))")}, 'ß', 'ss'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: x <> ''), ' ') AS text FROM {SILVER}")
def t4_tokens(spark, d):
    """Composed, fully case-folded, tokens joined."""
    return table(spark, d, SILVER).select("src_ord", forms.rule_tokens(F.col("tweet")).alias("text"))


# sources and sinks, written and read back ---------------------------------------------------------


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("s2_csv_read_back", f"SELECT src_ord::VARCHAR AS src_ord, id, nullif(tweet, '') AS tweet FROM {GOLD}")
def s2(spark, d):
    """CSV with quoted line breaks and quotes, all columns as text: what is written is read. CSV has no
    difference between null and empty; both come back as null."""
    path = _place(spark, "csv")
    sinks.write_csv(table(spark, d, GOLD).select("src_ord", "id", F.nullif(F.col("tweet"), F.lit("")).alias("tweet")), path)
    return readers.read_csv(spark, path, "src_ord string, id string, tweet string")


@query("s7_result_documents", f"{LONG} SELECT label_source AS tag, label, sum(y) AS positives FROM long GROUP BY 1, 2")
def s7_documents(spark, d):
    """Result documents, one JSON file a tag, gathered into one table."""
    path = _place(spark, "json")
    counts = gold_long(spark, d, "label_source").groupBy("label_source", "label").agg(F.sum("y").cast("double").alias("y"))
    docs = counts.groupBy(F.col("label_source").alias("tag")).agg(F.map_from_entries(F.collect_list(F.struct("label", "y"))).alias("f1_per_label"))
    docs.repartition(3, "tag").write.json(path)
    return readers.read_experiments(spark, [path], multi_line=False).select("tag", "label", F.col("f1").cast("bigint").alias("positives"))


@query("s12_ordered_csv", f"SELECT row_number() OVER (ORDER BY urgency_score DESC, src_ord) AS line, src_ord::VARCHAR AS src_ord FROM {GOLD}")
def s12(spark, d):
    """One CSV file in a stated order: the line of every row in it."""
    path = _place(spark, "ordered")
    rows = table(spark, d, GOLD).select("src_ord", "urgency_score")
    sinks.write_csv(O.place_in_group(rows, [], [F.desc("urgency_score"), F.col("src_ord")], "line").select("line", "src_ord"), path, ["line"])
    return readers.read_csv(spark, path, "line bigint, src_ord string")


@query("s15_written_splits", f"SELECT split_name, count(*) AS rows FROM {GOLD} GROUP BY split_name")
def s15_written(spark, d):
    """Splits written as folders, and the manifest of what is there."""
    return sinks.write_splits(table(spark, d, GOLD), _place(spark, "splits"), "split_name")


# text overlap across splits -----------------------------------------------------------------------


@query("j4_split_hash_semi", f"SELECT src_ord FROM {GOLD} WHERE split_name IN ('val', 'test') AND {overlap('tweet')} <> '' AND sha1({overlap('tweet')}) IN (SELECT sha1({overlap('tweet')}) FROM {GOLD} WHERE split_name = 'train')")
def j4_split(spark, d):
    """Held-out rows whose normalized text is among the training rows."""
    t = T.overlap_text(F.col("tweet"))
    g = table(spark, d, GOLD).select("src_ord", "split_name", t.alias("t")).filter("t <> ''").withColumn("h", F.sha1("t"))
    return g.filter("split_name IN ('val', 'test')").join(g.filter("split_name = 'train'").select("h"), "h", "left_semi").select("src_ord")


_SH = f"SELECT src_ord AS i, split_name AS p, list_distinct(list_transform(range(1, greatest(length(t) - 4, 1) + 1), lambda k: substring(t, k, 5))) AS s FROM (SELECT src_ord, split_name, {overlap('tweet')} AS t FROM {GOLD}) WHERE t <> ''"


@query("j8_split_overlap", f"WITH sh AS ({_SH}), x AS (SELECT *, unnest(s) AS g FROM sh), c AS (SELECT a.i AS l, b.i AS r, count(*) AS n, any_value(len(a.s)) AS na, any_value(len(b.s)) AS nb FROM x a JOIN x b ON a.g = b.g WHERE a.p IN ('val', 'test') AND b.p = 'train' GROUP BY 1, 2) SELECT l, r, round(n::DOUBLE / (na + nb - n), 6) AS similarity FROM c WHERE n::DOUBLE / (na + nb - n) >= 0.85 - 1e-9 QUALIFY row_number() OVER (PARTITION BY l ORDER BY n::DOUBLE / (na + nb - n) DESC, r) = 1")
def j8_split(spark, d):
    """Every held-out row's most alike training row, 5-shingle Jaccard of at least 0.85."""
    g = table(spark, d, GOLD).select("src_ord", "split_name", "tweet")
    return J.near_duplicate_join(g.filter("split_name IN ('val', 'test')"), g.filter("split_name = 'train'"), "src_ord", T.overlap_text(F.col("tweet")))


# sampling -----------------------------------------------------------------------------------------


@query("k3_quotas", f"SELECT g AS province, size, quota FROM ({quota_sql(f'(SELECT * FROM {SILVER} WHERE province IS NOT NULL)', 'province', 300, 1)})")
def k3_quotas(spark, d):
    """Quotas of 300 rows over the provinces by largest remainder, at least one a province."""
    return S.allocated(table(spark, d, SILVER).select("province").filter("province IS NOT NULL"), "province", 300, 1)


@query("k4_sample_by_day", sample_sql(f"(SELECT * FROM {SILVER} WHERE date IS NOT NULL)", "date", 400, 42, "src_ord, date"))
def k4_day(spark, d):
    """A sample of 400 rows over the dates, in proportion."""
    return S.proportional_sample(table(spark, d, SILVER).select("src_ord", "id", "date").filter("date IS NOT NULL"), "date", 400, 42, "id").select("src_ord", "date")


_TIERS = {"top": "urgency_score >= 8", "high": "urgency_score BETWEEN 4 AND 7", "mid": "urgency_score BETWEEN 1 AND 3"}


@query("k5_tiers_by_province", " UNION ALL ".join(sample_sql(f"(SELECT * FROM {SILVER} WHERE province IS NOT NULL AND {w})", "province", 120, 42, f"src_ord, '{t}' AS tier") for t, w in _TIERS.items()))
def k5_tiers(spark, d):
    """Every tier's share, over the provinces."""
    s = table(spark, d, SILVER).select("src_ord", "id", "province", "urgency_score").filter("province IS NOT NULL")
    parts = [S.proportional_sample(s.filter(w), "province", 120, 42, "id").select("src_ord", F.lit(t).alias("tier")) for t, w in _TIERS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_TIER = "CASE WHEN urgency_score >= 8 THEN 'top' WHEN urgency_score BETWEEN 4 AND 7 THEN 'high' WHEN urgency_score BETWEEN 1 AND 3 THEN 'mid' ELSE 'low' END"


@query("k6_stratified_subset", sample_sql(SILVER, _TIER, 50, 7, "src_ord, g AS tier"))
def k6_stratified(spark, d):
    """A calibration subset that mirrors the urgency tiers, each with a row at least."""
    s = table(spark, d, SILVER).select("src_ord", "id", F.expr(_TIER).alias("tier"))
    return S.proportional_sample(s, "tier", 50, 7, "id").select("src_ord", "tier")


@query("k8_swap_repair")
def k8_swap(spark, d):
    """Test rows of every label by swaps within a stratum; split sizes stay."""
    df = S.split_three(table(spark, d, SILVER).select("src_ord", "id", "veracity_label", *L), ["veracity_label"], 42, "id")
    return S.swap_coverage(df, list(L), "veracity_label", 42, "id").select("src_ord", "split")


@query("k9_rarest_first")
def k9_rarest(spark, d):
    """Iterative stratification into five folds, the rarest label first."""
    return S.rarest_first_folds(table(spark, d, SILVER).select("src_ord", "id", *L), list(L), 5, 42, "id").select("src_ord", "fold")


# metrics ------------------------------------------------------------------------------------------


@query("m7_least_margin_label", f"{LONG} SELECT src_ord, label, round(abs(prob::DOUBLE - thr::DOUBLE), 6) AS margin FROM long QUALIFY row_number() OVER (PARTITION BY src_ord ORDER BY round(abs(prob::DOUBLE - thr::DOUBLE), 6), label) = 1")
def m7_label(spark, d):
    """The label nearest to its threshold, with its margin, inside each row."""
    cells = F.array(*(F.struct(F.round(F.abs(F.col(f"prob_{c}").cast("double") - F.lit(X.THRESHOLDS[c]).cast("float").cast("double")), 6).alias("margin"), F.lit(c).alias("label")) for c in L))
    return scored(table(spark, d, GOLD)).select("src_ord", F.array_min(cells).alias("m")).select("src_ord", "m.label", "m.margin")


_DIFF = {"saglik": "saglik", "barinma": "barinma", "aciliyet_0_3": "aciliyet_0_3", "veracity_label": "veracity_label"}
_NORM = "trim(coalesce(CAST({s}.{c} AS VARCHAR), ''))"
_SIGN = "concat_ws('|', " + ", ".join(f"CASE WHEN {_NORM.format(s='a', c=c)} <> {_NORM.format(s='b', c=c)} THEN '{c}' END" for c in _DIFF) + ")"


@query("g33_signatures", f"WITH c AS (SELECT a.id, {_SIGN} AS signature FROM {_A} a JOIN {_B} b ON a.id = b.id) SELECT signature, count(*) AS n, array_to_string(list_sort(list(id))[1:5], ',') AS examples FROM c WHERE signature <> '' GROUP BY signature")
def g33_signatures(spark, d):
    """Which columns changed together, how often, and up to five ids of each; only the first ids are kept
    while counts are combined."""
    a, b = annotators(spark, d)
    c = J.changed_columns(a, b, "id", list(_DIFF)).select("id", F.replace("changed", F.lit(","), F.lit("|")).alias("signature")).filter("signature <> ''")
    n = c.groupBy("signature").agg(F.count("*").alias("n"))
    first = O.top_per_group(c, ["signature"], [F.col("id")], 5).groupBy("signature").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("examples"))
    return n.join(first, "signature")


_FOLD = "CAST(('0x' || substring(md5('42|' || CAST(src_ord AS VARCHAR)), 1, 7)) AS BIGINT) % 5"


@query("g41_fold_thresholds", f"{LONG}, grid AS (SELECT i AS s FROM range(5, 96) t(i)), sw AS (SELECT label, {_FOLD} AS fold, s / 100.0::DOUBLE AS thr, sum(CASE WHEN y = 1 AND floor(prob::DOUBLE * 100 + 1e-6) >= s THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND floor(prob::DOUBLE * 100 + 1e-6) >= s THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y = 1 AND floor(prob::DOUBLE * 100 + 1e-6) < s THEN 1 ELSE 0 END) AS fn FROM long, grid GROUP BY 1, 2, s), b AS (SELECT label, fold, thr FROM sw QUALIFY row_number() OVER (PARTITION BY label, fold ORDER BY round((2 * tp + 1.0::DOUBLE) / (2 * tp + fp + fn + 1.0::DOUBLE), 9) DESC, thr) = 1) SELECT label, array_to_string(list(thr ORDER BY fold), ' ') AS fold_thresholds, CAST(median(thr) AS DOUBLE) AS median_threshold FROM b GROUP BY label")
def g41_thresholds(spark, d):
    """The best threshold of every fold and label, and their median."""
    fold = F.pmod(F.conv(F.substring(S.seeded(42, "src_ord"), 1, 7), 16, 10).cast("bigint"), F.lit(5))
    key = F.concat_ws("|", "label", fold)
    best = M.best_thresholds(M.threshold_sweep(gold_long(spark, d).withColumn("label", key)))
    parts = best.select(F.split("label", r"\|")[0].alias("label"), F.split("label", r"\|")[1].cast("int").alias("fold"), "thr")
    rows = parts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("fold", "thr"))).alias("t"), F.median("thr").alias("median_threshold"))  # one threshold a fold
    return rows.select("label", F.array_join(F.transform("t", lambda x: x["thr"].cast("string")), " ").alias("fold_thresholds"), "median_threshold")


# overrides and packs ------------------------------------------------------------------------------

_OV = {"guvenlik": "guvenlik", "psikolojik": "psikolojik", "bilgi_paylasimi": "bilgi_paylasimi"}


def _override_sql(c: str) -> str:
    veto = "".join(f" WHEN regexp_matches(t, '{p}') THEN '{name}'" for name, p in X.OVERRIDES[c]["veto"])
    strong = " OR ".join(f"regexp_matches(t, '{p}')" for p in X.OVERRIDES[c]["strong"])
    return f"CASE WHEN {c}_score <= 0 THEN ''{veto} WHEN {strong} THEN 'confirmed' ELSE '{c}_weak' END"


_OVERRIDE = f"SELECT src_ord, t, {', '.join(f'{_override_sql(c)} AS {c}_reason' for c in _OV)} FROM ({_CAND}) JOIN (SELECT src_ord, {low('tweet')} AS t FROM {SILVER}) USING (src_ord)"


def overrides(spark, d):
    c = candidates(spark, d).join(table(spark, d, SILVER).select("src_ord", T.low(F.col("tweet")).alias("t")), "src_ord")
    return c.select("src_ord", "t", *(R.override_reason(F.col("t"), F.col(f"{x}_score"), x).alias(f"{x}_reason") for x in _OV))


@query("r5_all_overrides", f"SELECT src_ord, {', '.join(f"{c}_reason, CASE WHEN {c}_reason = 'confirmed' THEN 1 ELSE 0 END AS {c}" for c in _OV)} FROM ({_OVERRIDE})")
def r5_all(spark, d):
    """All three classifiers: a candidate is vetoed by a named pattern, confirmed by a strong one, or weak."""
    o = overrides(spark, d)
    return o.select("src_ord", *(F.col(f"{c}_reason") for c in _OV), *((F.col(f"{c}_reason") == "confirmed").cast("int").alias(c) for c in _OV))


_PACK_Y = {c: f"CASE WHEN {c}_reason = 'confirmed' THEN 1 ELSE 0 END" if c in _OV else f"CASE WHEN {_any(X.WEAK['A'][c])} THEN 1 ELSE 0 END" for c in L}
_PACK_NOTES = "concat_ws('; ', " + ", ".join(f"CASE WHEN {c}_reason NOT IN ('', 'confirmed') THEN {c}_reason END" for c in _OV) + ")"
_PACK_SEV = "least(3, greatest(" + ", ".join(f"CASE WHEN {c} = 1 THEN {k} ELSE 0 END" for c, k in X.SEVERITY_FLOOR.items()) + "))"


@query("r7_whole_pack", f"SELECT *, {_PACK_SEV} AS severity FROM (SELECT src_ord, {', '.join(f'{y} AS {c}' for c, y in _PACK_Y.items())}, {_PACK_NOTES} AS notes FROM ({_OVERRIDE}))")
def r7_pack(spark, d):
    """The completed pack: weak labels, the three rare ones by their overrides, severity rebuilt, notes."""
    o = overrides(spark, d)
    weak = R.weak_labels(F.col("t"), "A")
    y = {c: (F.col(f"{c}_reason") == "confirmed").cast("int") if c in _OV else weak[c] for c in L}
    notes = F.concat_ws("; ", F.array_compact(F.array(*(F.when(~F.col(f"{c}_reason").isin("", "confirmed"), F.col(f"{c}_reason")) for c in _OV))))
    pack = o.select("src_ord", *(v.alias(c) for c, v in y.items()), notes.alias("notes"))
    return pack.withColumn("severity", F.least(F.lit(3), F.greatest(*(F.when(F.col(c) == 1, k).otherwise(0) for c, k in X.SEVERITY_FLOOR.items()))))


@query("r10_guarded_export", f"SELECT id, coalesce(saglik_a, saglik_b) AS saglik FROM ({_BOTH}) WHERE coalesce(saglik_a, saglik_b) IS NOT NULL AND (saglik_a = saglik_b OR saglik_a IS NULL OR saglik_b IS NULL)")
def r10_guarded(spark, d):
    """Rows whose finals are complete pass the guard, which blocks a table with any blank."""
    a, b = annotators(spark, d)
    f = J.full_outer(a, b, "id", ["saglik"]).withColumn("saglik", F.when((F.col("saglik_a") == F.col("saglik_b")) | F.col("saglik_a").isNull() | F.col("saglik_b").isNull(), F.coalesce("saglik_a", "saglik_b")))
    return R.export_guard(f.filter("saglik IS NOT NULL").select("id", "saglik"), ["saglik"])


# scoring by a linear model over words -------------------------------------------------------------


def _z_sql(c: str) -> str:
    return f"-2.0::DOUBLE + {' + '.join(f"{w}::DOUBLE * (CASE WHEN contains(t, '{x}') THEN 1 ELSE 0 END)" for x, w in Z.MODEL[c])}"


def _scores_sql(source: str, keep: str) -> str:
    p = ", ".join(f"round(1 / (1 + exp(-({_z_sql(c)}))), 6) AS prob_{c}" for c in L)
    y = ", ".join(f"CASE WHEN CAST(prob_{c} AS FLOAT) >= CAST({X.THRESHOLDS[c]} AS FLOAT) THEN 1 ELSE 0 END AS pred_{c}" for c in L)
    return f"SELECT *, {y} FROM (SELECT {keep}, {p} FROM {source})"


_TEXTS = f"(SELECT *, {low('tweet')} AS t FROM {GOLD})"


@query("x2_text_scores", f"SELECT *, {' + '.join(f'pred_{c}' for c in L)} AS label_count, greatest({', '.join(f'pred_{c}' for c in L)}) AS any_need FROM ({_scores_sql(_TEXTS, 'src_ord')})")
def x2_scores(spark, d):
    """Texts through the linear scorer: probabilities, predictions and derived columns in one projection."""
    return Z.with_counts(Z.scores(table(spark, d, GOLD).select("src_ord", "tweet"), F.col("tweet"), "src_ord"))


@query("x4_fold_text_scores", f"WITH s AS ({_scores_sql(_TEXTS, 'src_ord')}) SELECT {_FOLD} AS fold, label, round(avg(prob), 5) AS mean_prob, sum(pred) AS positives, count(*) AS n FROM ({' UNION ALL '.join(f"SELECT src_ord, '{c}' AS label, prob_{c} AS prob, pred_{c} AS pred FROM s" for c in L)}) GROUP BY 1, 2")
def x4_scores(spark, d):
    """Scores of every fold by the scorer."""
    s = Z.scores(table(spark, d, GOLD).select("src_ord", "tweet"), F.col("tweet"), "src_ord")
    fold = F.pmod(F.conv(F.substring(S.seeded(42, "src_ord"), 1, 7), 16, 10).cast("bigint"), F.lit(5))
    cells = F.array(*(F.struct(F.lit(c).alias("label"), F.col(f"prob_{c}").alias("prob"), F.col(f"pred_{c}").alias("pred")) for c in L))
    return s.select(fold.alias("fold"), F.inline(cells)).groupBy("fold", "label").agg(F.round(F.avg("prob"), 5).alias("mean_prob"), F.sum("pred").alias("positives"), F.count("*").alias("n"))


_PROBE_ROWS = "(SELECT name, expected, " + low("text") + " AS t FROM (VALUES " + ", ".join(f"('{n}', '{t}', '{','.join(e)}')" for n, t, e in X.PROBES_10) + ") p(name, text, expected))"


@query("x6_scored_probes", f"SELECT name, expected, concat_ws(',', {', '.join(f"CASE WHEN pred_{c} = 1 THEN '{c}' END" for c in L)}) AS found FROM ({_scores_sql(_PROBE_ROWS, 'name, expected')})")
def x6_scored(spark, d):
    """Ten probes through the scorer."""
    df = spark.createDataFrame([(n, t, ",".join(e)) for n, t, e in X.PROBES_10], "name string, text string, expected string")
    s = Z.scores(df, F.col("text"), "name", "expected")
    return s.select("name", "expected", T.true_flags({c: F.col(f"pred_{c}") == 1 for c in L}).alias("found"))


_AUDIT = f"SELECT count(*) AS n FROM {GOLD}"


@query("x7_written_artifact", f"SELECT (SELECT n FROM ({_AUDIT})) AS rows, (SELECT n FROM ({_AUDIT})) AS expected_rows, 0 AS missing_columns, 0 AS threshold_differences, 0 AS disagreements, 0 AS out_of_range")
def x7_written(spark, d):
    """Predictions and thresholds written as an artifact, read again and held against the canonical ones."""
    rows = table(spark, d, GOLD).select("src_ord", "tweet")
    path, cut = _place(spark, "predictions"), _place(spark, "thresholds")
    Z.with_counts(Z.scores(rows, F.col("tweet"), "src_ord")).write.parquet(path)
    spark.createDataFrame(list(X.THRESHOLDS.items()), "label string, threshold float").write.json(cut)
    return Z.artifact_audit(spark.read.parquet(path), spark.read.schema("label string, threshold double").json(cut), rows)


@query("x3_trained_scorer")
def x3(spark, d):
    """A logistic regression a rare label over hashed words, trained on the train split, judged on the others."""
    return Z.trained_scores(table(spark, d, GOLD), "tweet", list(X.RARE))
