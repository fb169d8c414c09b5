"""Queries of the training-data operators, with the SQL they equal where SQL can say it.

Each takes (spark, folder) and runs over whole tables with production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.plans.registry import shipped

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

EMERGENCY = "emergency_geolocated_96k"
GOLD = "need_classification_gold_combined"
SILVER = "need_classification_silver_63k_profilea_exgold"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = shipped(f)
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("p5_found")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Silver rows grouped by near-duplicate texts: the group's least src_ord with each other one."""
    from triagelake.llm.near_duplicates import near_duplicate_groups

    out = near_duplicate_groups(table(spark, folder, SILVER), "src_ord", "tweet_clean")
    return out.filter("ord <> group_ord").select("group_ord", F.col("ord").alias("src_ord"))


@query("p2_found")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Copies hidden by formatting: each record's least src_ord with every other src_ord of it."""
    from triagelake.llm.formatting_copies import formatting_copies

    out = formatting_copies(table(spark, folder, EMERGENCY), "src_ord", "tweet_clean")
    return out.filter("ord <> keep_ord").select("keep_ord", F.col("ord").alias("copy_ord"))


@query("p2_records")
def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of several copies, with the number of its copies."""
    from triagelake.llm.formatting_copies import formatting_copies

    out = formatting_copies(table(spark, folder, EMERGENCY), "src_ord", "tweet_clean")
    return out.filter("ord = keep_ord").select("keep_ord", "copies")


@query("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Gold rows of val or test found again among the train rows, by id or text."""
    from triagelake.llm.cross_split import split_overlaps

    out = split_overlaps(table(spark, folder, GOLD), "src_ord", "tweet_clean", "split_name", "id")
    return out.select(F.least("train_ord", "eval_ord").alias("ord_a"), F.greatest("train_ord", "eval_ord").alias("ord_b"))


@query("p3_rows")
def p3_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Gold rows whose text is found again across the splits: their class and their number of links."""
    from triagelake.llm.cross_split import overlap_rows

    return overlap_rows(table(spark, folder, GOLD), "src_ord", "tweet_clean", "split_name", "id").withColumnRenamed("ord", "src_ord")


@query("p3_overlap_report")
def p3_overlap_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps per split and source of the evaluation row."""
    from triagelake.llm.cross_split import split_overlaps

    gold = table(spark, folder, GOLD)
    out = split_overlaps(gold, "src_ord", "tweet_clean", "split_name", "id")
    named = out.join(gold.select(F.col("src_ord").alias("eval_ord"), "split_name", "label_source"), "eval_ord")
    return named.groupBy("split_name", "label_source").agg(
        F.count("*").alias("pairs"),
        F.count_distinct("eval_ord").alias("eval_rows"),
        F.count_if("same_id").alias("same_id_pairs"),
        F.round(F.avg("similarity"), 6).alias("mean_similarity"),
        F.round(F.avg("part_eval"), 6).alias("mean_chunk_overlap"),
    )


@query("p4_found")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Gold rows whose tweets look the same but are written with different characters."""
    from triagelake.llm.look_alikes import same_looking_pairs

    return same_looking_pairs(table(spark, folder, GOLD), "src_ord", "tweet")


@query("p4_classes")
def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Gold rows of classes that look the same but are written in several ways, with their links."""
    from triagelake.llm.look_alikes import same_looking_classes

    return same_looking_classes(table(spark, folder, GOLD), "src_ord", "tweet").withColumnRenamed("ord", "src_ord")


@query("p4_consistent")
def p4_consistent(spark: SparkSession, folder: str) -> DataFrame:
    """Every gold tweet in its consistent form."""
    from triagelake.llm.look_alikes import consistent_text

    return consistent_text(table(spark, folder, GOLD), "src_ord", "tweet").select(F.col("ord").alias("src_ord"), "canonical")


@query("p8_ids")
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    from triagelake.llm.tokenize import corpus_ids

    return corpus_ids(table(spark, folder, "documents"), "doc_id", "text")


@query("p8_roundtrip")
def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by whether their ids decode to their text again."""
    from triagelake.llm.tokenize import corpus_ids, decoded

    docs = table(spark, folder, "documents")
    back = decoded(corpus_ids(docs, "doc_id", "text"), "doc_id", "ids")
    both = back.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("source_text")), "doc_id")
    return both.groupBy((F.col("text") == F.col("source_text")).alias("same")).agg(F.count("*").alias("documents"))


@query("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that contain a passage of a held-out item."""
    from triagelake.llm.leaks import leaked_items

    return leaked_items(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def _places(spark: SparkSession, folder: str) -> DataFrame:
    from triagelake.llm.place_names import place_matches

    return place_matches(
        table(spark, folder, EMERGENCY), "src_ord", ["neighborhood", "district", "province"],
        table(spark, folder, "gazetteer"), "gaz_id", ["neighborhood_clean", "district", "province"],
    ).select(F.col("ord").alias("src_ord"), "gaz_id")


@query("p7_found")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The gazetteer entry meant by each hand-filled place that is no listed triple as written."""
    return _places(spark, folder)


@query("p7_unmatched")
def p7_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values that mean no single entry, with their rows."""
    missed = _places(spark, folder).filter("gaz_id = 0").select("src_ord")
    rows = table(spark, folder, EMERGENCY).join(missed, "src_ord")
    return rows.groupBy("neighborhood", "district", "province").agg(F.count("*").alias("rows"))


@query("p6_found")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every item of personal data in gold tweets: its row, field, kind and number within the field."""
    from triagelake.llm.personal_data import personal_data

    out = personal_data(table(spark, folder, GOLD), "src_ord", ["tweet", "tweet_clean"], texts_too=False)
    return out.select(F.col("ord").alias("src_ord"), "field_name", F.explode("items").alias("i")).select("src_ord", "field_name", "i.kind", "i.nth")


@query("p6_masked")
def p6_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Every gold text with its personal data replaced by typed placeholders."""
    from triagelake.llm.personal_data import personal_data

    return personal_data(table(spark, folder, GOLD), "src_ord", ["tweet", "tweet_clean"]).select(F.col("ord").alias("src_ord"), "field_name", "masked")


def _sample(spark: SparkSession, folder: str, draw: bool = True) -> tuple[DataFrame, DataFrame]:
    from triagelake.llm.target_sample import plan_report, target_sample

    return (target_sample if draw else plan_report)(table(spark, folder, GOLD), "id", "split_name", ["guvenlik", "psikolojik"], table(spark, folder, "sampling_targets"))


P1_FOUND = """
WITH units AS (
    SELECT DISTINCT id, split_name, guvenlik, psikolojik FROM need_classification_gold_combined
    WHERE id IS NOT NULL AND guvenlik IN (0, 1) AND psikolojik IN (0, 1)
), cells AS (
    SELECT t.plan_id, t.guvenlik, t.psikolojik, t.target_share, t.sample_size, t.min_rows, count(DISTINCT u.id) AS available
    FROM sampling_targets t LEFT JOIN units u
      ON u.guvenlik = t.guvenlik AND u.psikolojik = t.psikolojik AND (t.split_name IS NULL OR t.split_name = u.split_name)
    GROUP BY ALL
)
SELECT plan_id, guvenlik, psikolojik FROM cells
WHERE available < greatest(min_rows, round(target_share * sample_size, 6))
"""


@query("p1_found", P1_FOUND)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the plans that gold rows cannot fill."""
    _, report = _sample(spark, folder, draw=False)
    return report.filter("gap > 0").select("plan_id", "guvenlik", "psikolojik")


@query("p1_sample")
def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The ids drawn for every plan."""
    return _sample(spark, folder)[0]


@query("p1_report")
def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Available, needed and drawn ids of every plan's cells, with the gap and the shares."""
    return _sample(spark, folder, draw=False)[1]


@query("p10_found")
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of grade 4 or 5 on the readers' scale."""
    from triagelake.llm.reading_level import reading_levels

    out = reading_levels(table(spark, folder, "documents"), table(spark, folder, "graded_documents"))
    return out.filter("grade >= 3.5").select("doc_id")


@query("p10_levels")
def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The estimated grade of every document."""
    from triagelake.llm.reading_level import reading_levels

    return reading_levels(table(spark, folder, "documents"), table(spark, folder, "graded_documents"))


@query("p10_by_source")
def p10_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-validated error of the estimate per source, whole sources held out."""
    from triagelake.llm.reading_level import train

    _, got = train(table(spark, folder, "documents"), table(spark, folder, "graded_documents"))
    rows = [(str(s), float(g), float(h)) for s, g, h in zip(got["source"], got["grade"], got["held_out"])]
    held = spark.createDataFrame(rows, "source string, grade double, estimate double")
    return held.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.round(F.avg(F.abs(F.col("grade") - F.col("estimate"))), 6).alias("mean_error"),
        F.round(F.avg((F.abs(F.col("grade") - F.col("estimate")) <= 1).cast("double")), 6).alias("within_one"),
    )
