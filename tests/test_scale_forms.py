"""Ways beyond a bound give what the bounded way gives; operators without SQL against brute force."""

from __future__ import annotations

import random
import unicodedata
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triagelake import store
from triagelake.functions import forms
from triagelake.functions import lexicon as X
from triagelake.operators import joins as J
from triagelake.operators import metrics as M
from triagelake.operators import order as O
from triagelake.operators import rules as R
from triagelake.operators import sampling as S
from triagelake.operators import scoring as Z
from triagelake.operators import shingles as H


def test_staging_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            applicationId, master = "cluster-1", "spark://host:7077"

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="shared folder"):
        store.shared_dir(Cluster)


@pytest.mark.parametrize("n, least", [(40, 1), (7, 1), (100, 1), (3000, 1), (25, 3)])
def test_allocation_in_spark_equals_the_drivers(spark, monkeypatch, n, least):
    r = random.Random(n)
    rows = [(f"g{i}",) for i in range(14) for _ in range(r.choice([1, 1, 2, 60, 300]))] + [(None,)] * 5
    df = spark.createDataFrame(rows, "g string")
    plain = sorted((x["g"] or "", x["size"], x["quota"]) for x in S.allocated(df, "g", n, least).collect())
    monkeypatch.setattr(S, "MAX_GROUPS", 0)
    assert sorted((x["g"] or "", x["size"], x["quota"]) for x in S.allocated(df, "g", n, least).collect()) == plain
    assert sum(q for _, _, q in plain) == min(n, len(rows))


def test_similar_pairs_in_slices(spark, monkeypatch):
    rows = [(i, i, [1, 2, 3, 4], [1, 2, 3, 4 + i % 2]) for i in range(50)]
    df = spark.createDataFrame([(a, b, [x << 20 for x in s], [x << 20 for x in t]) for a, b, s, t in rows], "a bigint, b bigint, sa array<bigint>, sb array<bigint>").coalesce(1)
    plain = sorted(map(tuple, H.similar_pairs(df, 0.9).collect()))
    monkeypatch.setattr(H, "PAIR_ROWS", 3)
    assert sorted(map(tuple, H.similar_pairs(df, 0.9).collect())) == plain and len(plain) == 25


@pytest.mark.parametrize("seed, t", [(1, 0.85), (2, 0.7), (3, 0.95)])
def test_near_duplicates_write_no_shingles_and_lose_none(spark, monkeypatch, seed, t):
    r = random.Random(seed)
    words = ["".join(r.choice("abcçdeğhıiklmnoöprsştuüvyz") for _ in range(r.randint(2, 9))) for _ in range(120)]
    texts = ["a", "abcd", "abcde", "abcdef", "ab" * 300]
    for _ in range(260):
        w = r.choice(texts).split() if r.random() < 0.6 else [r.choice(words) for _ in range(r.choice([1, 2, 4, 12, 40, 60]))]
        for _ in range(r.choice([0, 1, 1, 2])):
            w[r.randrange(len(w))] = r.choice(words)
        if r.random() < 0.2:
            r.shuffle(w)
        texts.append(" ".join(w))
    texts += [" ".join(r.choice(words) for _ in range(60)) for _ in range(400)]
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in texts]
    side = [r.randrange(2) for _ in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    want = {}
    for i in (i for i, s in enumerate(side) if not s):
        best = max((alike(i, j), -j) for j, s in enumerate(side) if s)
        if best[0] >= t - 1e-9:
            want[i] = (-best[1], round(best[0], 6))
    staged = []

    def weighed(df, name):
        path = store.stage_path(df, name)
        staged.append(sum(p.stat().st_size for p in Path(path.removeprefix("file://")).glob("*.parquet")))
        return spark.read.parquet(path)

    monkeypatch.setattr(J, "stage", weighed)
    if seed == 1:
        monkeypatch.setattr(H, "GROUP", 9000)  # several groups in a band
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, side)), "o bigint, t string, side int").repartition(2)
    got = J.near_duplicate_join(df.filter("side = 0"), df.filter("side = 1"), "o", F.col("t"), t).collect()
    assert {x["l"]: (x["r"], x["similarity"]) for x in got} == want and len(got) == len(want) > 20
    assert sum(staged) < 3 * sum(len(x.encode()) for x in texts)


def test_pairs_of_parts_in_slices(monkeypatch):
    texts = [f"aynı söz burada yine aynı {i % 7}" for i in range(60)]
    plain = H._alike(texts[:30], texts[30:], 5, 0.85, 9)
    monkeypatch.setattr(H, "PAIRS", 11)
    assert all((x == y).all() for x, y in zip(plain, H._alike(texts[:30], texts[30:], 5, 0.85, 9))) and len(plain[0]) == 900


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-30, 300), min_size=2, max_size=5), st.integers(0, 60), st.data())
def test_level_fill_equals_one_row_at_a_time(need, n, data):
    need = np.array(need) / 5
    slots = np.array(data.draw(st.lists(st.integers(0, 40), min_size=len(need), max_size=len(need))))
    left, room, got = need.copy(), slots.copy(), np.zeros(len(need), int)
    for _ in range(min(n, slots.sum())):
        free = [i for i in range(len(need)) if room[i]]
        i = max(free, key=lambda i: (round(left[i], 9), room[i], -i))
        left[i], room[i], got[i] = left[i] - 1, room[i] - 1, got[i] + 1
    made = S.level_fill(need, slots, n)
    assert made.sum() == got.sum() and (made <= slots).all()
    assert np.allclose(np.sort(need - made), np.sort(need - got))  # equal needs may be served in another order


def test_folds_spread_every_label(spark):
    r = random.Random(3)
    rows = [(str(i), int(r.random() < 0.02), int(r.random() < 0.3), int(r.random() < 0.5), r.choice([None, 0, 1])) for i in range(997)]
    df = spark.createDataFrame(rows, "id string, a int, b int, c int, d int")
    got = S.rarest_first_folds(df, list("abcd"), 5, 1, "id")
    assert got.exceptAll(S.rarest_first_folds(df.orderBy(F.rand(5)), list("abcd"), 5, 1, "id")).count() == 0
    by = got.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in "abcd")).collect()
    assert len(by) == 5 and sum(x["n"] for x in by) == 997 and {x["n"] for x in by} <= {199, 200}
    for c in "abcd":
        counts = [x[c] for x in by]
        assert max(counts) - min(counts) <= 2, (c, counts)
    assert S.rarest_first_folds(df.limit(0), list("abcd"), 5, 1, "id").count() == 0


def test_swaps_repair_coverage_and_keep_sizes(spark):
    rows = [(f"{i:02}", "train" if i < 20 else "val" if i < 24 else "test", f"s{i % 2}", int(i in (2, 4)), int(i == 21), int(i == 7), int(i in (3, 25))) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, split string, g string, a int, b int, c int, e int")
    got = S.swap_coverage(df, list("abce"), "g", 1, "id")
    sizes = lambda x: {r["split"]: r["count"] for r in x.groupBy("split").count().collect()}
    assert sizes(got) == sizes(df)
    test = got.filter("split = 'test'").agg(*(F.sum(c).alias(c) for c in "abce")).first()
    assert test["a"] == 1 and test["c"] == 0 and test["e"] == 1  # c has one row in all: not enough
    assert test["b"] == 0  # one row in all, too
    assert got.select("id", "g").exceptAll(df.select("id", "g")).count() == 0
    again = S.repair_coverage(df, list("abce"), 1, "id")
    assert again.filter("split = 'test' AND a = 1").count() == 1 and again.count() == 30


def test_exact_quantiles_equal_numpy(spark):
    r = random.Random(9)
    rows = [(g, v) for g, n in (("x", 1), ("y", 2), ("z", 999), ("w", 300)) for v in (r.choice([0.25, r.random(), r.random() ** 4]) for _ in range(n))] + [("w", None)]
    got = {x["g"]: x for x in M.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"m": 0.5, "p": 0.95, "lo": 0.0, "hi": 1.0}, bins=16).collect()}
    for g in "xyzw":
        mine = [v for k, v in rows if k == g and v is not None]
        assert np.allclose([got[g][k] for k in ("m", "p", "lo", "hi")], np.quantile(mine, [0.5, 0.95, 0, 1]))


def test_duplicates_with_nulls_and_a_hot_key(spark):
    rows = [(i, "u" if i < 1500 else None if i < 1503 else f"v{i}", None if i % 2 else "t") for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, user_id string, tweet string")
    got = {r["i"]: r["is_duplicate"] for r in O.mark_duplicates(df, ["user_id", "tweet"]).collect()}
    assert len(got) == 2000 and all(got[i] for i in range(1503) if i != 1501) or got[1501] is False
    assert got[1501] is False and not any(got[i] for i in range(1503, 2000))  # the only null user with a null text


def test_running_sum_over_ranges(spark):
    rows = [(i, (i * 7) % 11) for i in range(200)]
    got = {r["i"]: r["s"] for r in O.running_sum(spark.createDataFrame(rows, "i int, v int"), "v", [F.desc("i")], "s").collect()}
    assert got == {i: sum((j * 7) % 11 for j in range(i + 1, 200)) for i in range(200)}


def test_small_goes_by_the_size_estimate(spark, monkeypatch):
    df = spark.range(10)
    assert "ResolvedHint" in J.small(df)._jdf.queryExecution().analyzed().toString() or J.small(df) is not df
    monkeypatch.setattr(J, "SMALL_BYTES", 1)
    assert J.small(df) is df


def test_unicode_forms(spark):
    odd = ["éÄ", "İIıi", "ﬁne ß ẞ ΣΑΣ", "ａｂｃ ①", "ẋ̣", None, "", "กำ", "한글 한", "a \n b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    got = {r["i"]: r for r in df.select("i", forms.composed(F.col("t")).alias("nfc"), forms.case_folded(F.col("t")).alias("fold"), forms.without_marks(F.col("t")).alias("bare"), forms.clean(F.col("t")).alias("clean")).collect()}
    for i, t in enumerate(odd):
        if t is None:
            assert got[i]["nfc"] is got[i]["fold"] is got[i]["bare"] is None and got[i]["clean"] == ""
            continue
        assert got[i]["nfc"] == unicodedata.normalize("NFC", t)
        assert got[i]["fold"] == unicodedata.normalize("NFC", t).casefold()
        bare = "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Mn")
        assert got[i]["bare"] == unicodedata.normalize("NFC", bare)
    assert df.limit(0).select(forms.case_folded(F.col("t"))).collect() == []
    assert spark.createDataFrame([("Straße,  étÉ_1! ",)], "t string").select(forms.rule_tokens(F.col("t"))).first()[0] == "strasse été_1"


def test_guard_and_audit_see_what_is_wrong(spark):
    with pytest.raises(ValueError, match="2 rows"):
        R.export_guard(spark.createDataFrame([(1, "a"), (None, "b"), (2, " ")], "y int, v string"), ["y", "v"])
    texts = spark.createDataFrame([(1, "enkaz altında ses geliyor"), (2, None)], "i int, t string")
    made = Z.with_counts(Z.scores(texts, F.col("t"), "i"))
    cut = spark.createDataFrame(list(X.THRESHOLDS.items()), "label string, threshold double")
    clean = Z.artifact_audit(made, cut, texts).first().asDict()
    assert clean == {"rows": 2, "expected_rows": 2, "missing_columns": 0, "threshold_differences": 0, "disagreements": 0, "out_of_range": 0}
    broken = made.limit(1).withColumn("pred_saglik", 1 - F.col("pred_saglik")).withColumn("prob_barinma", F.lit(1.5)).withColumn("pred_barinma", F.lit(1)).drop("prob_altyapi")
    seen = Z.artifact_audit(broken, cut.filter("label <> 'saglik'"), texts).first().asDict()
    assert (seen["rows"], seen["expected_rows"], seen["missing_columns"], seen["threshold_differences"], seen["disagreements"], seen["out_of_range"]) == (1, 2, 1, 1, 1, 1)


def test_a_trained_scorer_learns(spark):
    rows = [(["train", "test"][i % 4 == 0], "silah sesi var" if i % 3 == 0 else f"yol kapalı {i}", int(i % 3 == 0), 0) for i in range(120)] + [("test", None, None, 0)]
    got = {(r["label"], r["split_name"]): r for r in Z.trained_scores(spark.createDataFrame(rows, "split_name string, t string, a int, b int"), "t", ["a", "b"], 256).collect()}
    assert got["a", "test"]["f1"] == 1.0 and got["b", "test"]["tp"] == 0 and got["b", "train"]["tn"] == 90
