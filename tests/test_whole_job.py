"""Queries and operators that must do the whole of their job: every column, every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions.lexicon import LABELS
from triagelake.operators import joins as J
from triagelake.operators import sampling as S
from triagelake.plans import agg_queries, registry
from triagelake.plans.tables import EMERGENCY, GOLD, SILVER


def test_conflicts_in_every_label_column(spark, tmp_path):
    columns = [*LABELS, "aciliyet_0_3", "veracity_label"]
    plain = dict.fromkeys(LABELS, 0) | {"aciliyet_0_3": 1, "veracity_label": "dogru"}
    rows = []
    for i, c in enumerate(columns):  # a text for each column: twice the same but for that column
        other = "yanlis" if c == "veracity_label" else 2
        rows += [plain | {"tweet": f"metin {i}"}, plain | {"tweet": f"metin {i}", c: other}]
    rows += [plain | {"tweet": "bos"}, plain | {"tweet": "bos", "veracity_label": None}]
    rows += [plain | {"tweet": "ayni"}, plain | {"tweet": "ayni"}, plain | {"tweet": "tek"}]
    spark.createDataFrame(rows, ", ".join(["tweet string", *(f"{c} int" for c in columns[:-1]), "veracity_label string"])).write.parquet(f"{tmp_path}/{GOLD}.parquet")
    got = {r["key"]: [c for c in columns if r[c] > 1] for r in registry.queries()["g16_all_label_conflicts"](spark, str(tmp_path)).collect()}
    assert got == {f"metin {i}": [c] for i, c in enumerate(columns)} | {"bos": ["veracity_label"]}


def test_every_row_has_its_place_in_the_mixed_sort(spark, tmp_path):
    rows = [(i, i * 7 % 5, None if i % 11 == 0 else float(i * 13 % 17)) for i in range(1000)]
    spark.createDataFrame(rows, "src_ord long, urgency_score int, total_engagement double").repartition(5).write.parquet(f"{tmp_path}/{EMERGENCY}.parquet")
    got = sorted(tuple(r)[::-1] for r in registry.queries()["w1_whole_sort"](spark, str(tmp_path)).select("src_ord", "place").collect())
    want = sorted(rows, key=lambda r: (-r[1], r[2] is None, -(r[2] or 0), r[0]))
    assert got == [(k, r[0]) for k, r in enumerate(want, 1)]


def test_dictionary_names_of_any_length(spark):
    docs = spark.createDataFrame([(1, "bir iki üç dört beş altı yedi"), (2, "üç dört"), (3, "iki üç dört beş")], "k int, t string")
    names = spark.createDataFrame([("iki üç dört beş",), ("bir iki üç dört beş altı",), ("dört",), (None,)], "name string")
    got = {r.k: r["name"] for r in J.dictionary_match(docs, "k", F.col("t"), names, "name").collect()}
    assert got == {1: "bir iki üç dört beş altı", 2: "dört", 3: "iki üç dört beş"}
    assert J.dictionary_match(docs, "k", F.col("t"), names.limit(0), "name").count() == 0


def test_allocation_loses_no_group_beyond_the_bound(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(f"p{i % 4}",) for i in range(40)], "province string").write.parquet(f"{tmp_path}/{SILVER}.parquet")
    k3 = registry.queries()["k3_proportional_allocation"]
    monkeypatch.setattr(S, "MAX_GROUPS", 4)
    plain = sorted(map(tuple, k3(spark, str(tmp_path)).collect()))
    assert [r[0] for r in plain] == ["p0", "p1", "p2", "p3"] and sum(r[2] for r in plain) == 40
    monkeypatch.setattr(S, "MAX_GROUPS", 3)
    assert sorted(map(tuple, k3(spark, str(tmp_path)).collect())) == plain


def test_rare_labels_decide_between_equal_macros(spark):
    cells = [("a", "guvenlik", 9, 1, 1), ("a", "saglik", 1, 9, 9), ("b", "guvenlik", 1, 9, 9), ("b", "saglik", 90, 10, 10)]
    conf = spark.createDataFrame([(t, c, tp, fp, fn, 2 * tp / (2 * tp + fp + fn)) for t, c, tp, fp, fn in cells], "tag string, label string, tp long, fp long, fn long, f1 double")
    got = agg_queries.rank_with_rare(conf, "tag").orderBy("place").collect()
    assert [r["tag"] for r in got] == ["a", "b"] and got[0]["macro"] == got[1]["macro"] and got[0]["micro"] < got[1]["micro"]


def test_six_slices_hold_every_row(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/{GOLD}.parquet").count()
    got = registry.queries()["g23_six_slices"](spark, folder).groupBy("slice").agg(F.sum("n").alias("n")).collect()
    assert {r["slice"]: r["n"] for r in got} == dict.fromkeys(("aciliyet_0_3", "urgency_score", "text_length", "gold_label_count", "province", "province_district"), rows)


def test_false_alarms_beside_gold_labels(spark):
    folder = "/root/testdata/sf0.001"
    wide = [r.asDict() for r in agg_queries.scored(spark.read.parquet(f"{folder}/{GOLD}.parquet")).collect()]
    want = {(a, b): n for a in LABELS for b in LABELS if (n := sum(r[a] == 0 and r[f"pred_{a}"] == 1 and r[b] == 1 for r in wide))}
    assert want and {(r["fired"], r["gold"]): r["n"] for r in registry.queries()["g28_fp_cofire"](spark, folder).collect()} == want


def test_coercions_of_dirty_gold_cells(spark, tmp_path):
    rows = [dict.fromkeys(LABELS, 0) | {"src_ord": 1, "saglik": None, "veracity_label": " Fake "}, dict.fromkeys(LABELS, 1) | {"src_ord": 2, "saglik": 2, "veracity_label": None}]
    spark.createDataFrame(rows, ", ".join(["src_ord long", *(f"{c} int" for c in LABELS), "veracity_label string"])).write.parquet(f"{tmp_path}/{GOLD}.parquet")
    got = {(r["src_ord"], r["name"]): (r["lenient"], r["missing"], r["zero"], r["violation"], r["class"], r["n"]) for r in registry.queries()["c2_gold_coercions"](spark, str(tmp_path)).collect()}
    assert len(got) == 20
    assert got[1, "saglik"] == (0, None, 0, True, "", -1) and got[2, "saglik"] == (2, None, None, True, "2", 2) and got[2, "barinma"] == (1, 1, 1, False, "1", 1)
    assert got[1, "veracity_label"] == (0, None, None, True, "asilsiz", -1) and got[2, "veracity_label"] == (0, None, 0, True, "", -1)
