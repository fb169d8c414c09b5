"""p3: the same or nearly the same records across splits, by content-defined chunks.

A record is normalised to its distinct words in hash order, so that moved words, case, punctuation
and spacing make no difference. Records meet across the splits in blocks of their rarest words, the
chunks of one word; the words they share decide. What chunks cut by content two records share,
summed by length, is each one's overlap fraction: a rolling hash over a window of one word cuts the
sequence, chunks are one or a few words, and an edit changes only the chunks it touches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm import codepoints as C
from triagelake.llm import wordsets as W
from triagelake.store import stage

CUT = 8  # a chunk ends before a word unless the word's hash is divisible by this
HOT_ROWS = 1000  # the pairs of larger classes and ids are dealt to several tasks
ALL_WORDS = 16  # records of fewer words are cut at every word


def chunks(row: np.ndarray, tok: np.ndarray, n: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, digest, length) of the chunks; rows in `every` are cut at every word."""
    by = np.lexsort((tok, row))
    row, tok = row[by], tok[by]
    h = C.mix(tok.astype(np.uint64) + np.uint64(0xC2B2AE35))
    head = np.ones(len(row), bool)
    head[1:] = row[1:] != row[:-1]
    cut = head | (h % np.uint64(CUT) != 0) | every[row]
    start = np.flatnonzero(cut)
    if not len(start):
        return row, h, row
    length = np.diff(np.append(start, len(row)))
    return row[start], C.mix(np.add.reduceat(h, start) + length.astype(np.uint64)), length


def side_sketches(sets: DataFrame) -> list[np.ndarray]:
    """Counts of words by the low bits of their hash, of the records of train and of val and test; of fixed size."""
    return [W.frequency_sketch(sets.filter(side)) for side in ("in_train", "in_eval")]


def split_sides(side: np.ndarray, ord_: np.ndarray, sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which postings to emit, and under which part of their block; sizes: how many records of each side a block has.

    A side of more than BLOCK_ROWS records is dealt to groups, and each group of one side with each of
    the other is a part. A posting goes to the parts of its own group, as many as the other side has
    groups, so every pair of a block meets in one part of bounded size, and in that alone.
    """
    groups = [np.maximum(1, -(-x.astype(np.int64) // W.BLOCK_ROWS)) for x in sizes]
    own, others = np.where(side == 0, groups[0], groups[1]), np.where(side == 0, groups[1], groups[0])
    grp = (C.mix(ord_.astype(np.uint64)) % own.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(side)), others)
    other = np.arange(len(at)) - np.repeat(np.cumsum(others) - others, others)
    return at, np.where(side[at] == 0, grp[at] * W.PART + other, other * W.PART + grp[at])


def word_postings(sets: DataFrame, sketches: list[np.ndarray], t: float) -> DataFrame:
    """One row per record, side and word of its prefix that a record of the other side may share.

    Two records of similarity t have at least t n of the n words of either in common, so the rarest
    word both have is among the first n - ceil(t n) + 1 of each: no pair is lost. `cap` is the largest
    partner that still reaches the overlap if this is that word.
    """
    held = sets.sparkSession.sparkContext.broadcast(sketches)
    mask = np.uint32((1 << W.SKETCH_BITS) - 1)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = held.value[0].astype(np.int64) + held.value[1]
        for b in batches:
            if not b.num_rows:
                continue
            ord_ = b.column(0).to_numpy()
            row, tok, n = W.flat_lists(b.column(1))
            sides = np.stack([np.asarray(b.column(2)), np.asarray(b.column(3))]).astype(bool)
            sig = W.signatures(row, tok, len(n))
            by = W.ranked(row, tok, both)
            row, tok = row[by], tok[by]
            place = np.arange(len(tok)) - (np.cumsum(n) - n)[row]
            m = place < (n - np.ceil(t * n - W.EPS).astype(np.int64) + 1)[row]
            row, tok, place = row[m], tok[m], place[m]
            df = [x[tok & mask] for x in held.value]
            for side in (0, 1):
                met = df[1 - side] - sides[1 - side][row] > 0  # by another record of the other side
                k = np.flatnonzero(sides[side][row] & met)
                r, w = row[k], tok[k]
                at, part = split_sides(np.full(len(k), side), ord_[r], [x[k] for x in df])
                cap = np.floor((n[r] - place[k]) * (1 + t) / t + W.EPS).astype(np.int64) - n[r]
                r = r[at]
                cols = [w[at].view(np.int32), part, ord_[r], n[r].astype(np.int32), cap[at].astype(np.int32), np.full(len(at), side, np.int32), np.full(len(at), side, np.int32)]
                cols += [sig[r, i].view(np.int64) for i in range(W.SIG_WORDS)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in W.POSTING.split(", ")])

    return sets.select("ord", "toks", "in_train", "in_eval").mapInArrow(post, W.POSTING)


def overlap_fractions(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """(a, b, similarity, part_a, part_b): candidate pairs that reach t, with the share of each record's
    words that lie in chunks both have."""
    s = sets.select("ord", "toks")
    both = pairs.join(s.withColumnsRenamed({"ord": "a", "toks": "ta"}), "a").join(s.withColumnsRenamed({"ord": "b", "toks": "tb"}), "b")

    def shared(keys: list[np.ndarray], weights: np.ndarray, rows: int) -> np.ndarray:
        key = np.concatenate(keys)
        by = np.argsort(key, kind="stable")
        key, w = key[by], np.concatenate([weights, np.zeros(len(keys[1]), np.int64)])[by]
        twice = np.flatnonzero(key[1:] == key[:-1])
        return np.bincount((key[twice] >> np.uint64(32)).astype(np.int64), weights=w[twice], minlength=rows)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ra, ta, na = W.flat_lists(b.column(2))
            rb, tb, nb = W.flat_lists(b.column(3))
            up = lambda r, d: r.astype(np.uint64) << np.uint64(32) | (d & np.uint64(0xFFFFFFFF))
            same = shared([up(ra, ta.astype(np.uint64)), up(rb, tb.astype(np.uint64))], np.ones(len(ra), np.int64), b.num_rows)
            every = np.minimum(na, nb) < ALL_WORDS  # short pairs are compared word by word
            ca, da, la = chunks(ra, ta, na, every)
            cb, db, _ = chunks(rb, tb, nb, every)
            mass = shared([up(ca, da), up(cb, db)], la, b.num_rows)
            sim = same / (na + nb - same)
            ok = np.flatnonzero(sim >= t - W.EPS)
            take = pa.array(ok)
            cols = [b.column(0).take(take), b.column(1).take(take), pa.array(sim[ok]), pa.array((mass / na)[ok]), pa.array((mass / nb)[ok])]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "similarity", "part_a", "part_b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint, similarity double, part_a double, part_b double")


def linked_classes(base: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of rows (ord, text, side): classes has (ord, side, rep, trains, evals), one row per row
    with words, where rep is the least ord of its word set and trains and evals count the rows of each side;
    links has (a, b, similarity, part_a, part_b), train class and eval class. Both are staged."""
    sets = stage(W.word_sets(base, "ord", "text", "side"), "sets")
    reps = sets.groupBy("d1", "d2").agg(F.min("ord").alias("rep"), F.count("*").alias("copies"), F.count_if(F.col("side") == 0).alias("trains"), F.count_if(F.col("side") == 1).alias("evals"))
    joined = W.attach(sets, reps, ["d1", "d2"], "copies", sets.count())
    joined = joined.withColumns({"in_train": F.col("trains") > 0, "in_eval": F.col("evals") > 0})
    classes = stage(joined.withColumn("toks", F.when(F.col("ord") == F.col("rep"), F.col("toks"))).drop("d1", "d2"), "classes")
    lead = classes.filter("ord = rep")
    pairs = W.candidates(word_postings(lead, side_sketches(lead), t), t, W.task_count(lead, t, 2.0), sided=True)
    near = overlap_fractions(pairs, lead, t)
    own = lead.filter("in_train AND in_eval").select(F.col("rep").alias("a"), F.col("rep").alias("b"), *(F.lit(1.0).alias(c) for c in ("similarity", "part_a", "part_b")))
    return classes.select("ord", "side", "rep", "trains", "evals"), stage(near.unionByName(own), "links")


def _sides(rows: DataFrame, ord_: str, text: str, split: str, id_: str) -> DataFrame:
    side = F.when(F.col(split) == "train", 0).when(F.col(split).isin("val", "test"), 1)
    return rows.select(F.col(ord_).alias("ord"), F.col(text).alias("text"), F.col(id_).alias("id"), side.alias("side")).filter("side IS NOT NULL")


def overlap_rows(rows: DataFrame, ord_: str, text: str, split: str, id_: str, t: float = 0.7) -> DataFrame:
    """(ord, class_ord, links): one row per row whose text is found again on the other side, with its class
    (the least ord with the same words) and the number of rows of the other side it overlaps with. Same as
    the pairs of split_overlaps by text, without expanding them; the id plays no part."""
    classes, links = linked_classes(_sides(rows, ord_, text, split, id_), t)
    sizes = classes.filter("ord = rep").select("rep", "trains", "evals")
    of_train = links.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("evals").alias("links")).withColumn("side", F.lit(0))
    of_eval = links.join(sizes.withColumnRenamed("rep", "a"), "a").groupBy(F.col("b").alias("rep")).agg(F.sum("trains").alias("links")).withColumn("side", F.lit(1))
    found = of_train.unionByName(of_eval).join(sizes, "rep").withColumn("copies", F.when(F.col("side") == 0, F.col("trains")).otherwise(F.col("evals")))
    out = W.attach(classes.select("ord", "rep", "side"), stage(found.select("rep", "side", "links", "copies"), "row-links"), ["rep", "side"], "copies", classes.count())
    return out.select("ord", F.col("rep").alias("class_ord"), "links")


def split_overlaps(rows: DataFrame, ord_: str, text: str, split: str, id_: str, t: float = 0.7) -> DataFrame:
    """(train_ord, eval_ord, similarity, part_train, part_eval, same_id) of every overlapping pair of rows.

    A pair is a row of split `train` and one of `val` or `test` with the same non-null id, or with at
    least t of their distinct words in common. Similarity is null where only the id is the same. Rows
    without words match by id only; rows of no or another split are in no pair; repeated rows count as
    rows. An empty table gives no rows. Rows of a class or id of very many are dealt to many tasks.
    """
    base = _sides(rows, ord_, text, split, id_)
    classes, linked = linked_classes(base, t)
    sizes = classes.filter("ord = rep").select("rep", "trains", "evals")
    linked = linked.join(sizes.select(F.col("rep").alias("a"), "trains"), "a").join(sizes.select(F.col("rep").alias("b"), "evals"), "b")
    train = classes.filter("side = 0").select(F.col("rep").alias("a"), F.col("ord").alias("train_ord"), "trains")
    held = classes.filter("side = 1").select(F.col("rep").alias("b"), F.col("ord").alias("eval_ord"), "evals")
    by_text = W.salted(held, W.salted(train, linked, "a", "trains", HOT_ROWS), "b", "evals", HOT_ROWS)
    by_text = by_text.select("train_ord", "eval_ord", "similarity", F.col("part_a").alias("part_train"), F.col("part_b").alias("part_eval"))
    ids = base.filter("id IS NOT NULL").select("ord", "id", "side")
    both = ids.groupBy("id").agg(F.count_if(F.col("side") == 0).alias("trains"), F.count_if(F.col("side") == 1).alias("evals")).filter("trains > 0 AND evals > 0")
    ids = stage(W.attach(ids, both.withColumn("copies", F.col("trains") + F.col("evals")), ["id"], "copies", base.count()), "ids")
    by_id = W.salted(
        ids.filter("side = 0").select("id", F.col("ord").alias("train_ord"), "copies"),
        ids.filter("side = 1").select("id", F.col("ord").alias("eval_ord"), "copies"), "id", "copies", HOT_ROWS,
    ).select("train_ord", "eval_ord", F.lit(True).alias("same_id"))
    out = by_text.join(by_id, ["train_ord", "eval_ord"], "full_outer")
    return out.withColumn("same_id", F.coalesce("same_id", F.lit(False)))
