"""Operators on small fixtures: edge cases, brute force and properties."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triagelake.functions import coerce as K
from triagelake.functions import text as T
from triagelake.operators import joins as J
from triagelake.operators import metrics as M
from triagelake.operators import order as O
from triagelake.operators import sampling as S
from triagelake.operators.shingles import shingle_hashes
from triagelake.sources import readers, sinks
from triagelake.sources.osm import OsmPlaces, places
from triagelake.streaming import triage


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_text_edges(spark):
    assert one(spark, None, T.clean) == ""
    assert one(spark, "  a\n\t b ", T.clean) == "a b"
    assert one(spark, "IĞÜŞÖÇ ışık", T.ascii_fold) == "igusoc isik"
    assert one(spark, "Straße  X", T.rule_text) == "strasse x"
    assert one(spark, "@ali #Kar https://a.b/c Yağdı!", T.overlap_text) == "kar yağdı"
    shingles = lambda c: F.size(T.shingles(c))
    assert [one(spark, x, shingles) for x in ("", "abcd", "abcde", "abcdef", "aaaaaaa")] == [0, 1, 1, 2, 1]


def test_coercions(spark):
    assert [one(spark, x, K.lenient_binary) for x in (None, "", "1.0", "abc", "2")] == [0, 0, 1, 0, 2]
    assert [one(spark, x, K.boolean_word) for x in ("evet", "HAYIR", "", "x")] == [1, 0, None, None]
    assert [one(spark, x, K.ordinal) for x in ("3", "4", "x", None)] == [3, None, None, None]
    with pytest.raises(Exception, match="not 0 or 1"):
        one(spark, "2", K.strict_binary)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 200), min_size=1, max_size=12), st.integers(0, 400), st.integers(0, 2))
def test_allocation_sums_and_fits(sizes, n, least):
    got = S.proportional_allocation(sizes, n, least)
    assert sum(got) == min(n, sum(sizes)) and all(0 <= g <= s for g, s in zip(got, sizes))


def test_splits_and_folds_partition_rows(spark):
    df = spark.createDataFrame([(str(i), f"s{i % 7}", i % 2, i % 3 == 0) for i in range(300)] + [("solo", "alone", 1, True)], "id string, g string, a int, b boolean")
    a = S.split_three(df, ["g"], 1, "id")
    assert a.exceptAll(S.split_three(df.orderBy(F.rand(3)), ["g"], 1, "id")).count() == 0
    n = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert sum(n.values()) == 301 and abs(n["train"] - 240) <= 8
    folds = S.multilabel_folds(df, ["a"], 5, 1, "id").groupBy("fold", "a").count().collect()
    assert all(abs(r["count"] - 30) <= 2 for r in folds)
    some = spark.createDataFrame([(str(i), int(i == 4), "train" if i < 9 else "test") for i in range(12)], "id string, a int, split string")
    assert S.repair_coverage(some, ["a"], 1, "id").filter("split = 'test' AND a = 1").count() == 1


def test_kappa(spark):
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "a int, b int")
    assert M.kappa(same, 3).first()["kappa"] == 1
    assert M.kappa(spark.createDataFrame([(0, 0)] * 5, "a int, b int"), 2).first()["kappa"] is None
    assert M.kappa(spark.createDataFrame([(None, 1)], "a int, b int"), 2, False).count() <= 1


def test_sweep_equals_direct_count(spark):
    r = random.Random(1)
    rows = [(i, "x", r.randint(0, 1), r.randrange(0, 1001) / 1000) for i in range(200)]
    long = spark.createDataFrame(rows, "src_ord int, label string, y int, prob double")
    for s in M.threshold_sweep(long).filter("thr IN (0.05, 0.5, 0.95)").collect():
        assert s.tp == sum(y and int(p * 100 + 1e-6) >= round(s.thr * 100) for _, _, y, p in rows)
        assert s.tp + s.fn == sum(y for _, _, y, _ in rows)


def test_near_duplicate_join_equals_brute_force(spark):
    r = random.Random(2)
    base = ["".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(25)]
    edit = lambda t: "".join(c if r.random() > 0.02 else r.choice("xyz") for c in t)
    left = [(i, x) for i, x in enumerate([*base, "", None, base[0], "abc"])]
    right = [(100 + i, x) for i, x in enumerate([*(edit(t) for t in base), *(edit(t) for t in base[:9]), base[3], "", None, "abc"])]

    def grams(t):
        return {t[i : i + 5] for i in range(max(len(t) - 4, 1))} if t else set()

    want = {}
    for (i, a), (j, b) in itertools.product(left, right):
        if a and b:
            s = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
            if s >= 0.85 - 1e-9 and (i not in want or (-s, j) < want[i]):
                want[i] = (-s, j)
    schema = "src_ord int, t string"
    got = J.near_duplicate_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "src_ord", T.text_or_empty(F.col("t"))).collect()
    assert {(x.l, x.r, x.similarity) for x in got} == {(i, j, round(-s, 6)) for i, (s, j) in want.items()}
    assert [len({t[i : i + 5] for i in range(max(len(t) - 4, 1))}) if t else 0 for t in ("", "abcd", "aaaaaaa", "abcdefg")] == shingle_hashes(["", "abcd", "aaaaaaa", "abcdefg"], 5)[1].tolist()


def test_dictionary_match_prefers_the_longest(spark):
    docs = spark.createDataFrame([(1, "yeni mahalle, yeni"), (2, "yeniköy"), (3, None), (4, "(sanayi) yeni")], "k int, t string")
    names = spark.createDataFrame([("yeni",), ("yeni mahalle",), ("sanayi",)], "name string")
    got = {r.k: r["name"] for r in J.dictionary_match(docs, "k", T.text_or_empty(F.col("t")), names, "name").collect()}
    assert got == {1: "yeni mahalle", 4: "sanayi"}


def test_ranking_edges(spark):
    df = spark.createDataFrame([(None, 3, "c"), (None, 1, "a"), ("x", 2, "b"), ("x", 5, None)], "id string, o int, v string")
    assert {(r.id, r.o, r.v) for r in O.keep_least(df, ["id"], "o").collect()} == {(None, 1, "a"), ("x", 2, "b")}
    assert O.mark_duplicates(df, ["id"]).filter("is_duplicate").count() == 4
    assert O.keep_least(df.limit(0), ["id"], "o").count() == 0


def test_full_outer_and_changes(spark):
    a = spark.createDataFrame([("1", 1), ("2", None)], "id string, y int")
    b = spark.createDataFrame([("2", 0), ("3", 1)], "id string, y int")
    assert {(r.id, r.provenance) for r in J.full_outer(a, b, "id", ["y"]).collect()} == {("1", "left_only"), ("2", "both"), ("3", "right_only")}
    assert J.changed_columns(a, b, "id", ["y"]).first()["changed"] == "y"
    assert {r.id for r in J.exclude_ids(a, [b], "id").collect()} == {"1"}


def test_csv_round_trip_with_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([("1630000000001918605", 'iki\nsatır, "tırnak"', 1), ("2", "düz", 0)], "id string, t string, y int")
    sinks.write_csv(df, str(tmp_path / "x"), ["id"], single=True)
    back = readers.read_csv(spark, str(tmp_path / "x"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "parts").mkdir()
    for i in (2, 10):
        (tmp_path / "parts" / f"part_{i}.csv").write_text(f"id,t\n{i},metin\n", encoding="utf-8-sig")
    parts = readers.read_parts(spark, str(tmp_path / "parts" / "*.csv"), "id string, t string")
    assert [(r.part, r.id) for r in parts.orderBy("part").collect()] == [(2, "2"), (10, "10")]
    with pytest.raises(ValueError, match="missing columns: q"):
        readers.require(df, ["q"])


def test_reports_and_metadata(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.5)], "k string, v double")
    sinks.write_report({"x": df}, str(tmp_path))
    assert "a\\|b" in (tmp_path / "report.md").read_text() and json.loads((tmp_path / "report.json").read_text()) == {"x": [{"k": "a|b", "v": 0.5}]}
    assert sinks.enrich({"n": 1}, {"n": "rows"}, {"m": 2}, {"rows": 1}) == {"rows": 1, "m": 2}
    with pytest.raises(ValueError):
        sinks.enrich({"n": 1}, {}, {}, {"n": 2})
    manifest = sinks.write_splits(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "i int, split string"), str(tmp_path / "s"), "split")
    assert {tuple(r) for r in manifest.collect()} == {("a", 1), ("b", 2)}
    for tag, f1 in (("one", 0.5), ("two", 0.75)):
        (tmp_path / f"{tag}.json").write_text(json.dumps({"tag": tag, "f1_per_label": {"x": f1}} if tag == "one" else {"f1_per_label": {"x": f1}}))
    got = readers.read_experiments(spark, [str(tmp_path / "one.json"), str(tmp_path / "two.json")])
    assert {tuple(r) for r in got.collect()} == {("one", "x", 0.5), ("two", "x", 0.75)}


def test_map_service_source(spark, tmp_path):
    assert list(places([{"address": {"suburb": "", "quarter": "Q"}, "lat": "1.5", "lon": ""}])) == [("Q", None, 1.5, None)]
    (tmp_path / "a.json").write_text(json.dumps({"elements": [{"tags": {"name": "N", "place": "village"}, "lat": 1, "lon": 2}]}))
    spark.dataSource.register(OsmPlaces)
    got = spark.read.format("osm_places").options(queries="a|missing", folder=str(tmp_path)).load().collect()
    assert [tuple(r) for r in got] == [("a", "N", "village", 1.0, 2.0)]


def test_streams(spark, tmp_path):
    rows = [(1, "acil enkaz", "2027-01-01 10:05:00"), (1, "acil enkaz", "2027-01-01 10:06:00"), (2, "sakin", "2027-01-01 11:00:00"), (3, None, None)]
    df = spark.createDataFrame(rows, "id int, tweet string, at string").withColumn("at", F.col("at").try_cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    m = triage.triaged(triage.message_stream(spark, str(tmp_path / "in"), df.schema))
    counts = triage.drain(triage.window_counts(m, "at"), "counts_t", "complete", str(tmp_path / "c1"))
    assert sorted((r.messages, r.urgent) for r in counts.collect()) == [(1, 0), (2, 2)]
    firsts = triage.drain(triage.first_sightings(m, "at", "id"), "firsts_t", "append", str(tmp_path / "c2"))
    assert sorted(r.id for r in firsts.collect()) == [1, 2]


def test_the_library_does_not_need_the_subpackage():
    import pathlib

    import triagelake

    for p in pathlib.Path(triagelake.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "triagelake.llm" not in p.read_text()


def test_places_without_gathering_a_group(spark):
    rows = [(i, None if i % 5 == 0 else f"g{i % 3 if i % 2 else 0}", (i * 7919) % 1000) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, g string, o int")
    got = O.place_in_group(df, ["g"], [F.col("o"), F.col("i")], "place", "size").collect()
    want = {}
    for g in {r[1] for r in rows}:
        mine = sorted((o, i) for i, x, o in rows if x == g)
        want |= {i: (k + 1, len(mine)) for k, (_, i) in enumerate(mine)}
    assert {r.i: (r.place, r.size) for r in got} == want and len(got) == 400
    assert O.place_in_group(df.limit(0), ["g"], [F.col("i")]).count() == 0
