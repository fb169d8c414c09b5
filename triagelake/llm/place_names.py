"""p7: hand-filled places mapped to a canonical list, by token repair and soft TF-IDF.

Each distinct filled-in value gives name tokens (single words and neighbouring words joined). Every
distinct token of the table is joined once to the list's vocabulary by edit distance with swaps: both
sides give the keys that their first letters leave after deletions, equal keys make a candidate, and
the distance is computed for candidates only. Corrected tokens of all fields are then combined: an
entry's score is the sum over its names of inverse frequency times similarity, and the best entry is
taken if it stands alone. The list is joined like any table: neither its size nor its names have a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm import codepoints as C
from triagelake.llm.wordsets import attach
from triagelake.store import stage

EDGE = 0.85  # how near to a district a name at the edge of the budget must be
PREFIX = 8  # letters of which deletion keys are made

_ACCENTS = str.maketrans("çğışöüâîûé", "cgisouaiue")


def plain_tokens(texts: pa.Array) -> list[list[tuple[str, bool]]]:
    """Per text, folded words without accents, and whether a full stop follows. Null texts have none."""
    cp, offs = C.folded(texts)
    w = C.words(cp, offs)
    s = cp.astype("<u4").tobytes().decode("utf-32-le", "replace").translate(_ACCENTS)
    dot = np.append(cp, 0)[w.end] == ord(".")
    flat = [(s[a:b], d) for a, b, d in zip(w.start.tolist(), w.end.tolist(), dot.tolist())]
    return [flat[a:b] for a, b in zip(w.offs[:-1].tolist(), w.offs[1:].tolist())]


def name_keys(texts: list[str]) -> list[str]:
    return ["".join(x for x, _ in got) for got in plain_tokens(pa.array(texts, pa.string()))]


def budget(n: int) -> int:
    """Edits a name of n letters may have."""
    return 0 if n < 5 else 1 if n < 8 else 2


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, key): hashes of what the first PREFIX letters leave after up to budget + 1 deletions.

    If a token is at most budget + 1 edits or swaps from a name, its first letters and the name's have a
    common subsequence that lacks at most so many letters of either, so the two share a key. No pair is lost.
    """
    size = np.array([len(w) for w in words])
    at, keys = [], []
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        p = min(n, PREFIX)
        text = "".join(words[i][:p] for i in rows)
        letters = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(rows), p).astype(np.uint64)
        part = [[C.mix(letters[:, i] + np.uint64((j + 1) << 32)) for j in range(i + 1)] for i in range(p)]
        for d in range(min(p, budget(n) + 1) + 1):
            for gone in combinations(range(p), d):
                kept = [i for i in range(p) if i not in gone]
                keys.append(C.mix(sum((part[i][j] for j, i in enumerate(kept)), np.zeros(len(rows), np.uint64))))
                at.append(rows)
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pair = np.unique(np.stack([np.concatenate(at).astype(np.uint64), np.concatenate(keys)]), axis=1)
    return pair[0].astype(np.int64), pair[1]


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distance with swaps of neighbours of each a[i] to b[i], a vector operation per cell of the table."""
    out = np.zeros(len(a), np.int64)
    size = np.array([(len(x), len(y)) for x, y in zip(a, b)]).reshape(-1, 2)
    for n, m in np.unique(size, axis=0).tolist():
        rows = np.flatnonzero((size[:, 0] == n) & (size[:, 1] == m))
        x, y = (np.frombuffer("".join(w[i] for i in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), k).T for w, k in ((a, n), (b, m)))
        before: list[np.ndarray] = []
        last = [np.full(len(rows), j) for j in range(m + 1)]
        for i in range(1, n + 1):
            row = [np.full(len(rows), i)]
            for j in range(1, m + 1):
                best = np.minimum(np.minimum(last[j], row[j - 1]) + 1, last[j - 1] + (x[i - 1] != y[j - 1]))
                if i > 1 and j > 1:
                    swap = (x[i - 1] == y[j - 2]) & (x[i - 2] == y[j - 1])
                    best = np.where(swap, np.minimum(best, before[j - 2] + 1), best)
                row.append(best)
            before, last = last, row
        out[rows] = last[m]
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 5000):
            part = b.slice(at, 5000).column(0)
            row, key = deletion_keys(part.to_pylist())
            yield pa.RecordBatch.from_arrays([part.take(pa.array(row)), pa.array(key.view(np.int64))], ["word", "key"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, n = b.column(0).to_pylist(), b.column(1).to_pylist()
        dist = distances(a, n)
        allowed = np.array([budget(len(x)) for x in a], np.int64)
        longer = np.array([max(len(x), len(y)) for x, y in zip(a, n)], float)
        ok = np.flatnonzero(dist <= allowed + 1)
        take = pa.array(ok)
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array((1 - dist / np.maximum(longer, 1))[ok]), pa.array((dist > allowed)[ok].astype(np.int32))], ["token", "name", "sim", "beyond"])


def repaired_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, name, sim, beyond): the names each distinct token may mean. beyond is 1 for a name one edit
    beyond the budget and -1 for a name of the wider levels of which the token is an abbreviation.

    vocabulary has (name, wide). Few bytes but much work: tokens are spread over all tasks by a key of
    their own, since the partitions of a distinct() are merged by their size.
    """
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = stage(tokens.distinct(), "tokens")
    same = tokens.join(vocabulary.select(F.col("name").alias("token")), "token").select("token", F.col("token").alias("name"), F.lit(1.0).alias("sim"), F.lit(0).alias("beyond"))
    short = vocabulary.filter("wide").select("name", F.explode(F.array_distinct(F.transform(F.array(*(F.lit(k) for k in (3, 4, 5))), lambda k: F.substring("name", F.lit(1), k)))).alias("token"))
    begun = tokens.join(short.filter(F.length("token") >= 3), "token").select("token", "name", F.lit(0.9).alias("sim"), F.lit(-1).alias("beyond"))
    longest = vocabulary.agg(F.max(F.length("name"))).first()[0] or 0
    odd = tokens.filter(F.length("token").between(4, longest + budget(longest + 3) + 1)).join(vocabulary.select(F.col("name").alias("token")), "token", "left_anti")
    spread = lambda df, c: df.select(c).repartition(parts, F.xxhash64(F.lit("spread"), c))
    a = spread(odd, "token").mapInArrow(_keyed, "word string, key bigint").withColumnRenamed("word", "token")
    b = spread(vocabulary, "name").mapInArrow(_keyed, "word string, key bigint").withColumnRenamed("word", "name")
    pairs = a.join(b, "key").filter(F.abs(F.length("token") - F.length("name")) <= 3).select("token", "name").distinct()
    near = pairs.repartition(parts, F.xxhash64(F.lit("spread"), "token", "name")).mapInArrow(_compared, "token string, name string, sim double, beyond int")
    return same.unionByName(begun).unionByName(near)


def listed_entries(listed: DataFrame, id_: str, names: list[str]) -> DataFrame:
    """(gaz_id, k0, k1, k2, idf0, idf1, idf2): the entries with the keys of their names and how rare those are."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [pa.array(name_keys(b.column(i).to_pylist()), pa.string()) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["gaz_id", "k0", "k1", "k2"])

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"n{i}") for i, c in enumerate(names)]
    out = stage(listed.select(F.col(id_).cast("bigint").alias("gaz_id"), *text).mapInArrow(keys, "gaz_id bigint, k0 string, k1 string, k2 string"), "entries")
    n = out.count()
    for level in range(3):
        key = f"k{level}"
        rare = out.filter(F.col(key) != "").groupBy(key).agg(F.log(1 + F.lit(float(n)) / F.count("*")).alias(f"idf{level}"))
        out = out.join(rare, key, "left")
    return stage(out.select("gaz_id", *(f"k{i}" for i in range(3)), *(F.coalesce(f"idf{i}", F.lit(0.0)).alias(f"idf{i}") for i in range(3))), "entries")


def best_entries(corrected: DataFrame, entries: DataFrame) -> DataFrame:
    """(vid, gaz_id): the entry that the corrected tokens of each value mean, if a single one is best.

    corrected has (vid, name, levels, sim, beyond, flag). The first field's names choose the entries; the
    similarity of the entry's names of the wider levels among all names of the value is added. A name at
    the edge of the budget counts only with its district given, at least EDGE alike.
    """
    local = F.when((F.col("flag").bitwiseAND(1) == 1) & (F.col("levels").bitwiseAND(1) == 1), F.struct("sim", (-F.greatest("beyond", F.lit(0))).alias("edge")))
    wide = F.when(F.col("beyond") <= 0, F.col("sim"))
    per = corrected.groupBy("vid", "name", "levels").agg(F.max(local).alias("local"), F.max(wide).alias("wide"))
    by = per.groupBy("vid").agg(F.collect_list(F.struct("name", "levels", "local", "wide")).alias("names"))  # as many as a value has names

    def similarity(level: int, key: str) -> Column:
        here = F.filter("names", lambda x: (x["levels"].bitwiseAND(1 << level) != 0) & (x["name"] == F.col(key)))
        return F.coalesce(F.array_max(F.transform(here, lambda x: x["wide"])), F.lit(0.0))

    chosen = by.select("vid", "names", F.explode(F.filter("names", lambda x: x["local"].isNotNull())).alias("c"))
    both = chosen.select("vid", "names", F.col("c.name").alias("k0"), F.col("c.local.sim").alias("sim"), (F.col("c.local.edge") < 0).alias("edge")).join(entries, "k0")
    both = both.withColumns({"d": similarity(1, "k1"), "p": similarity(2, "k2")}).filter((~F.col("edge")) | (F.col("d") >= EDGE))
    score = F.round(F.col("idf0") * F.col("sim") + F.col("idf1") * F.col("d") + F.col("idf2") * F.col("p"), 9)
    ties = both.withColumn("score", score).filter("score > 0").groupBy("vid", "score").agg(F.count("*").alias("n"), F.min("gaz_id").alias("gaz_id"))
    top = ties.groupBy("vid").agg(F.max_by(F.struct("n", "gaz_id"), "score").alias("top"))
    return top.select("vid", F.when(F.col("top.n") == 1, F.col("top.gaz_id")).otherwise(F.lit(0)).cast("bigint").alias("gaz_id"))


def place_matches(rows: DataFrame, ord_: str, filled: list[str], listed: DataFrame, id_: str, listed_names: list[str]) -> DataFrame:
    """(ord, gaz_id) of each row whose first field is filled and whose fields are no listed triple as written.

    `filled` and `listed_names` name the columns from the narrowest to the widest. gaz_id is 0 where no
    entry, or no single one, is meant. Distinct values are resolved once; rows with a blank or null
    first field are left out; other fields may be null or blank. An empty list maps everything to 0.
    Extra columns make no difference. The list may be of any size.
    """
    spark = rows.sparkSession
    n, d, p = (F.col(c).cast("string") for c in filled)
    base = rows.select(F.col(ord_).alias("ord"), n.alias("n"), F.coalesce(d, F.lit("")).alias("d"), F.coalesce(p, F.lit("")).alias("p"))
    base = base.filter(F.regexp_replace("n", r"(?U)\s+", "") != "")
    known = listed.select(*(F.col(c).alias(k) for c, k in zip(listed_names, "ndp")))
    odd = stage(base.join(known.distinct(), ["n", "d", "p"], "left_anti"), "odd")
    total = odd.count()
    values = odd.groupBy("n", "d", "p").agg(F.count("*").alias("rows"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for triple in zip(*(plain_tokens(b.column(i)) for i in range(3))):
                mine: dict[str, int] = {}
                for level, got in enumerate(triple):
                    for i, (w, stop) in enumerate(got):
                        flag = (1 if level == 0 else 2) | (4 if stop and level and 3 <= len(w) <= 5 else 0)
                        mine[w] = mine.get(w, 0) | flag
                        if i:
                            two = got[i - 1][0] + w
                            mine[two] = mine.get(two, 0) | (1 if level == 0 else 2)
                out.append([{"token": k, "flag": v} for k, v in mine.items()])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.list_(pa.struct([("token", pa.string()), ("flag", pa.int32())])))], ["n", "d", "p", "rows", "tokens"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    spread = values.repartition(parts, F.xxhash64(F.lit("spread"), "n", "d", "p"))
    parsed = spread.mapInArrow(split, "n string, d string, p string, rows bigint, tokens array<struct<token:string,flag:int>>")
    parsed = stage(parsed.withColumn("vid", F.monotonically_increasing_id()), "values")
    entries = listed_entries(listed, id_, listed_names)
    levels = F.explode(F.array(*(F.struct(F.col(f"k{i}").alias("name"), F.lit(1 << i).alias("level")) for i in range(3)))).alias("x")
    vocabulary = entries.select(levels).select("x.*").filter("name <> ''").groupBy("name").agg(F.expr("bit_or(level)").alias("levels"))
    vocabulary = stage(vocabulary.withColumn("wide", F.col("levels") > 1), "vocabulary")
    used = parsed.select("vid", F.inline("tokens"))
    repaired = stage(repaired_tokens(used.select("token"), vocabulary).join(vocabulary.select("name", "levels"), "name"), "repaired")
    corrected = used.join(repaired, "token").filter("beyond >= 0 OR flag >= 4").select("vid", "name", "levels", "sim", "beyond", "flag")
    ranked = best_entries(corrected, entries)
    solved = parsed.select("vid", "n", "d", "p", "rows").join(ranked, "vid", "left").select("n", "d", "p", "rows", F.coalesce("gaz_id", F.lit(0)).alias("gaz_id"))
    return attach(odd, stage(solved, "solved"), ["n", "d", "p"], "rows", total).select("ord", "gaz_id")
