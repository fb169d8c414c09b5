"""p9: passages of held-out items inside documents, by pigeonhole pieces and Myers verification.

A passage is NEED or more item words in a row (or a whole shorter item) of which at most BUDGET are
altered or have a word added before them. Every such passage is cut into BUDGET + 1 pieces, one of which is intact, so it holds
three item words in a row exactly: those pieces are looked up in every document. Exact runs around
the hits are stretched over altered and added words, all hits at once, and what reaches the length
is verified by Myers' bit-parallel distance over words. Words that a document leaves out are errors
that the stretch does not allow: texts built from the same phrases lack the items' own words.

An exact run of the whole length always counts. A passage with errors rests on fewer words, and where
those are stock phrases of the corpus they prove nothing: such a passage counts only if one of its
matched words is rare among the documents that do not hold the item for certain. The frequencies are
those of all documents, counted in the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm import codepoints as C
from triagelake.store import stage

NEED = 10
BUDGET = 2
PIECE = 3
RARE_SHARE = 0.004  # of all documents: a word found in more of them beside the item's own leaks is no evidence
RARE_FLOOR = 3  # documents; below this a word is rare in a corpus of any size
MAX_ITEM_WORDS = 2_000_000  # the bound of what is broadcast; more items go in blocks


class Items:
    """Words of all items on end, and the sorted table of their pieces."""

    def __init__(self, ids: np.ndarray, texts: pa.Array):
        cp, offs = C.folded(texts)
        w = C.words(cp, offs)
        self.ids, self.offs, self.hash, self.row = ids, w.offs, w.hash, w.row
        piece, at = pieces(w.hash, w.row)
        by = np.argsort(piece, kind="stable")
        self.piece, self.at = piece[by], at[by]
        self.word, self.which = np.unique(w.hash, return_inverse=True)


def pieces(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of PIECE words in a row within one text, and where they start."""
    if len(h) < PIECE:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[: 1 - PIECE] == row[PIECE - 1 :])
    key = np.zeros(len(at), np.uint64)
    for i in range(PIECE):
        key = C.mix(key + h[at + i])
    return key, at


def _reach(ih: np.ndarray, dh: np.ndarray, a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray, step: int) -> np.ndarray:
    """How many words match exactly from (a, b) on in the direction of step, up to NEED."""
    n = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(NEED):
        x, y = a[live] + step * k, b[live] + step * k
        ok = (x < a_end[live]) & (y < b_end[live]) if step > 0 else (x >= a_end[live]) & (y >= b_end[live])
        live = live[ok]
        if not len(live):
            break
        live = live[ih[a[live] + step * k] == dh[b[live] + step * k]]
        n[live] += 1
    return n


def _stretch(ih, dh, a, b, a_end, b_end, step: int) -> list[np.ndarray]:
    """Item words covered beyond a run's end with 0, 1, ... BUDGET altered or added words."""
    cover = [np.zeros(len(a), np.int64) for _ in range(BUDGET + 1)]

    def go(a: np.ndarray, b: np.ndarray, done: np.ndarray, used: int) -> None:
        for skip in (1, 0):  # an altered word of the item, or none: a word was added
            x, y = a + step * skip, b + step
            n = _reach(ih, dh, x, y, a_end, b_end, step)
            total = np.where(n > 0, done + skip + n, 0)
            np.maximum(cover[used + 1], total, out=cover[used + 1])
            if used + 1 < BUDGET:
                far = done + skip + n
                go(x + step * n, y + step * n, np.where(n > 0, far, -(10**6)), used + 1)

    go(a, b, np.zeros(len(a), np.int64), 0)
    for k in range(1, BUDGET + 1):
        np.maximum(cover[k], cover[k - 1], out=cover[k])
    return cover


def myers(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edit distance of each row of pattern (words, at most 63) within its row of text, bit-parallel.

    Zeros pad the text and match nothing.
    """
    rows, m = pattern.shape
    one = np.uint64(1)
    pv = np.full(rows, (1 << m) - 1, np.uint64)
    mv = np.zeros(rows, np.uint64)
    score = np.full(rows, m)
    best = score.copy()
    top = np.uint64(1 << (m - 1))
    weight = one << np.arange(m, dtype=np.uint64)
    for j in range(text.shape[1]):
        eq = ((pattern == text[:, j : j + 1]) * weight).sum(axis=1, dtype=np.uint64)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score = score + ((ph & top) != 0) - ((mh & top) != 0)
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
        best = np.minimum(best, score)
    return best


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... n[i] of them, for every i on end."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def counted(items: Items, w: C.Words, row: np.ndarray, item: np.ndarray) -> np.ndarray:
    """For every item word: texts that hold it, less those of them that hold the item ((row, item) pairs)."""
    net = np.zeros(len(items.hash), np.int64)
    if not len(w.hash) or not len(items.word):
        return net
    k = np.minimum(np.searchsorted(items.word, w.hash), len(items.word) - 1)
    hit = items.word[k] == w.hash
    held = np.unique(w.row[hit] * len(items.word) + k[hit])
    net += np.bincount(held % len(items.word), minlength=len(items.word))[items.which]
    if len(row):
        n = items.offs[item + 1] - items.offs[item]
        at = _spans(items.offs[item], n)
        key = np.repeat(row, n) * len(items.word) + items.which[at]
        found = held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key
        net -= np.bincount(at[found], minlength=len(net))
    return net


def passages(items: Items, w: C.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, item) held for certain, each once; and (row, item, item word) of the matched words of every
    passage with errors of the other pairs."""
    none = np.zeros(0, np.int64)
    key, at = pieces(w.hash, w.row)
    lo, hi = np.searchsorted(items.piece, key), np.searchsorted(items.piece, key, side="right")
    n = hi - lo
    b = np.repeat(at, n)
    if not len(b):
        return none, none, none, none, none
    a = items.at[_spans(lo, n)]
    same = (a > 0) & (b > 0)  # keep the first hit of an exact run
    prev = np.zeros(len(a), bool)
    prev[same] = (items.hash[a[same] - 1] == w.hash[b[same] - 1]) & (items.row[a[same] - 1] == items.row[a[same]]) & (w.row[b[same] - 1] == w.row[b[same]])
    a, b = a[~prev], b[~prev]
    item, doc = items.row[a], w.row[b]
    a0, a1, b0, b1 = items.offs[item], items.offs[item + 1], w.offs[doc], w.offs[doc + 1]
    run = _reach(items.hash, w.hash, a, b, a1, b1, 1)
    need = np.minimum(NEED, a1 - a0)
    pairs = doc * (len(items.offs) - 1) + item
    certain = np.unique(pairs[run >= need])
    left_over = ~np.isin(pairs, certain)
    right = _stretch(items.hash, w.hash, a + run, b + run, a1, b1, 1)
    left = _stretch(items.hash, w.hash, a - 1, b - 1, a0, b0, -1)
    most = np.zeros(len(a), np.int64)
    for k in range(BUDGET + 1):
        most = np.maximum(most, run + left[k] + right[BUDGET - k])
    ok = np.flatnonzero((most >= need) & left_over)
    a, b, item, doc, need, pairs = a[ok], b[ok], item[ok], doc[ok], need[ok], pairs[ok]
    a0, a1, b0, b1 = a0[ok], a1[ok], b0[ok], b1[ok]
    wide = NEED + 2 * (NEED + BUDGET)
    keys = []
    for back in range(NEED):  # every window of the passage that holds the run's first word
        start = a - back
        use = np.flatnonzero((start >= a0) & (start + need <= a1) & ((need == NEED) | (start == a0)))
        if not len(use):
            continue
        near = b[use][:, None] - NEED - BUDGET + np.arange(wide)
        inside = (near >= b0[use][:, None]) & (near < b1[use][:, None])
        text = np.where(inside, w.hash[np.clip(near, 0, len(w.hash) - 1)], np.uint64(0))
        pos = start[use][:, None] + np.arange(NEED)
        within = np.arange(NEED) < need[use][:, None]
        pat = items.hash[np.where(within, pos, start[use][:, None])]
        # an item below the length is covered wholly by the stretch; the distance is for whole windows
        good = np.flatnonzero((need[use] < NEED) | (myers(pat, text) <= BUDGET))
        if not len(good):
            continue
        matched = np.zeros((len(good), NEED), bool)
        place = NEED + BUDGET - back + np.arange(NEED)
        for shift in range(-BUDGET, BUDGET + 1):
            matched |= pat[good] == text[good][:, np.clip(place + shift, 0, wide - 1)]
        r, c = np.nonzero(matched & within[good])
        keys.append(np.stack([pairs[use[good[r]]], pos[good[r], c]]))
    if not keys:
        return certain // (len(items.offs) - 1), certain % (len(items.offs) - 1), none, none, none
    got = np.unique(np.concatenate(keys, axis=1), axis=1)
    return certain // (len(items.offs) - 1), certain % (len(items.offs) - 1), got[0] // (len(items.offs) - 1), got[0] % (len(items.offs) - 1), got[1]


DDL = "doc_id bigint, item_id bigint, certain boolean, word array<int>, docs array<bigint>"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("certain", pa.bool_()), ("word", pa.list_(pa.int32())), ("docs", pa.list_(pa.int64()))])


def _searched(items: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with the item words their passages match, then one row of word counts of the partition:
    the last count is the number of documents."""
    net = np.zeros(len(items.hash) + 1, np.int64)
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            w = C.words(*C.folded(part.column(1)))
            row, item, row2, item2, word = passages(items, w)
            net[:-1] += counted(items, w, row, item)
            net[-1] += part.num_rows
            pair, first = np.unique(row2 * len(items.ids) + item2, return_index=True)
            ids = part.column(0).take(pa.array(np.concatenate([row, pair // max(len(items.ids), 1)])))
            sure = np.arange(len(ids)) < len(row)
            offs = np.concatenate([np.zeros(len(row), np.int64), first, [len(word)]]).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(offs), pa.array(word.astype(np.int32)))
            which = pa.array(items.ids[np.concatenate([item, pair % max(len(items.ids), 1)])])
            yield pa.RecordBatch.from_arrays([ids, which, pa.array(sure), words, pa.nulls(len(ids), SCHEMA.field("docs").type)], schema=SCHEMA)
    at = np.flatnonzero(net)
    if len(at):
        yield pa.RecordBatch.from_pylist([{"doc_id": None, "item_id": None, "certain": None, "word": at.astype(np.int32), "docs": net[at]}], schema=SCHEMA)


def leaked_items(documents: DataFrame, doc_id: str, text: str, held_out: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id) of every document that contains an item's passage.

    The held-out items are the stated query set: their number of words is checked against
    MAX_ITEM_WORDS, and more are taken in blocks of that size, each against all documents; the word
    counts that the driver adds up are as many as a block has words. Case, punctuation, spacing and
    the encoding of accents make no difference. A word is rare if at most RARE_SHARE of the documents
    (but at least RARE_FLOOR) hold it without holding the item for certain. Null and empty texts and
    items without words are in no pair; repeated rows give repeated pairs; an empty table none.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    base = held_out.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("t")).filter("t IS NOT NULL")
    size = base.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-size // (2 * MAX_ITEM_WORDS)) or 1
    out = None
    for k in range(blocks):
        got = base.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow()
        texts = got.column("t").combine_chunks() if got.num_rows else pa.array([], pa.string())
        held = spark.sparkContext.broadcast(Items(got.column("item_id").to_numpy(), texts))
        searched = stage(docs.mapInArrow(lambda batches, held=held: _searched(held.value, batches), DDL), "passages")
        counts = searched.filter("certain IS NULL").select(F.inline(F.arrays_zip("word", "docs"))).groupBy("word").agg(F.sum("docs").alias("docs")).toArrow()
        net = np.zeros(len(held.value.hash) + 1, np.int64)
        net[counts.column("word").to_numpy()] = counts.column("docs").to_numpy()
        rare = spark.sparkContext.broadcast(net[:-1] <= max(RARE_FLOOR, RARE_SHARE * net[-1]))

        def proven(batches: Iterator[pa.RecordBatch], rare=rare) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words = b.column(3)
                any_rare = np.zeros(b.num_rows, bool)
                any_rare[pc.list_parent_indices(words).to_numpy()[rare.value[words.flatten().to_numpy()]]] = True
                yield b.select(["doc_id", "item_id"]).filter(pa.array(any_rare))

        sure = searched.filter("certain").select("doc_id", "item_id")
        found = sure.unionByName(searched.filter("NOT certain").mapInArrow(proven, "doc_id bigint, item_id bigint"))
        out = found if out is None else out.unionByName(found)
    return out
