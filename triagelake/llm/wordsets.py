"""Word-set similarity over whole tables: tokens, a bounded frequency sketch, and blocked pair search.

Similar texts are found without loss by prefix filtering. Each text's distinct words are put in one
global order, rarest first; two texts whose sets have at least `t` of their words in common share a
word among the first few of both. Texts meet only in the blocks of those words, and inside a block
a forest of signature trees is walked in pairs: nodes hold OR-combined bitmaps, size ranges and the
largest partner they allow, and a node pair goes as soon as no pair below it can reach the needed
overlap. What is left is verified exactly on the words.

Words are runs of letters, digits and marks of the canonical, case-folded text. A word is known by
32 bits of its hash; two words of one pair of texts are mistaken for each other about once in 10^8
pairs. Texts without words (null, empty, blank, marks only) have no set and are in no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm import codepoints as C
from triagelake.store import stage

SKETCH_BITS = 20  # the frequency sketch has 2^20 counters: 4 MB, whatever the input
SIG_WORDS = 4  # 256-bit signatures
LEAF = 8  # children of a node of the signature tree
PART_ROWS = 400_000  # postings of one task
BLOCK_ROWS = 20_000  # blocks of words that more texts hold are split into pairs of groups
EPS = 1e-9


def overlap_needed(n: np.ndarray, t: float) -> np.ndarray:
    """Words that two sets of n words together must share to reach similarity t."""
    return np.ceil(n * (t / (1 + t)) - EPS).astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 4000):
            part = b.slice(at, 4000)
            cp, offs = C.folded(part.column(1))
            w = C.words(cp, offs)
            if not len(w.hash):
                continue
            key = w.row.astype(np.uint64) << np.uint64(32) | (w.hash >> np.uint64(32))
            key = np.unique(key)
            row = (key >> np.uint64(32)).astype(np.int64)
            tok = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            n = np.bincount(row, minlength=part.num_rows)
            have = np.flatnonzero(n)
            begin = np.concatenate([[0], np.cumsum(n[have])])
            wide = tok.astype(np.uint64)
            d1 = np.add.reduceat(C.mix(wide + np.uint64(0x51ED27)), begin[:-1])
            d2 = np.add.reduceat(C.mix(wide * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7)), begin[:-1])
            cols = [
                part.column(0).take(pa.array(have)),
                pa.array(d1.view(np.int64)),
                pa.array(d2.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(tok.view(np.int32))),
            ]
            names = ["ord", "d1", "d2", "toks"]
            for k in range(2, part.num_columns):
                cols.append(part.column(k).take(pa.array(have)))
                names.append(part.schema.names[k])
            yield pa.RecordBatch.from_arrays(cols, names)


def word_sets(rows: DataFrame, ord_: str, text: str, *more: str) -> DataFrame:
    """(ord, d1, d2, toks, *more): the distinct words of each text and a 128-bit digest of the set.

    Rows without words are left out. `more` names columns that are carried along.
    """
    picked = rows.select(F.col(ord_).cast("bigint").alias("ord"), F.col(text).cast("string").alias("text"), *more)
    kinds = "".join(f", {c} {picked.schema[c].dataType.simpleString()}" for c in more)
    return picked.mapInArrow(_sets, f"ord bigint, d1 bigint, d2 bigint, toks array<int>{kinds}")


def attach(rows: DataFrame, keyed: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined with keyed (one row a key), where `size` of keyed says how many rows have the key.

    Keys that hold over a thousandth of all rows are at most a thousand: they are broadcast, so no
    task gets all rows of a hot key. All others are joined by a shuffle.
    """
    cut = max(1000, total // 1000)
    hot = keyed.filter(F.col(size) > cut).withColumn("_hot", F.lit(True))
    cold = keyed.filter(F.col(size) <= cut)
    marked = rows.join(F.broadcast(hot), keys, "left")
    done = marked.filter(F.col("_hot")).drop("_hot")
    extra = [c for c in keyed.columns if c not in keys]
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot", *extra)
    return done.unionByName(rest.join(cold, keys))


SALT = 64  # tasks that share the pairs of a hot class


def salted(left: DataFrame, right: DataFrame, key: str, size: str, cut: int) -> DataFrame:
    """left joined with right on key, where both have `size`, how many rows of left hold the key: the rows
    of a key of more than `cut` are dealt to SALT tasks, and the other side goes to each of them."""
    hot = F.col(size) > cut
    a = left.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(*(c for c in left.columns if c != key)), F.lit(SALT))).otherwise(0)).drop(size)
    b = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint"))))).drop(size)
    return a.join(b, [key, "_salt"]).drop("_salt")


def frequency_sketch(sets: DataFrame) -> np.ndarray:
    """Counts of words by the low bits of their hash, summed over all rows; its size is fixed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            tok = b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint32)
            total += np.bincount(tok & np.uint32((1 << SKETCH_BITS) - 1), minlength=1 << SKETCH_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    found = sets.select("toks").mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    got = found.toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.int32)
    out[got.column("at").to_numpy()] = np.minimum(got.column("n").to_numpy(), 2**31 - 1)
    return out


def ranked(row: np.ndarray, tok: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The order of (row, rarest word first); ties by the hash, so it is one order for all rows."""
    df = sketch[tok & np.uint32((1 << SKETCH_BITS) - 1)].astype(np.uint64)
    key = np.minimum(df, np.uint64(0xFFFFFFFF)) << np.uint64(32) | tok.astype(np.uint64)
    return np.lexsort((key, row))


def signatures(row: np.ndarray, tok: np.ndarray, n: int) -> np.ndarray:
    """A bitmap of SIG_WORDS x 64 bits for each of n rows."""
    bit = (C.mix(tok.astype(np.uint64)) >> np.uint64(13)) % np.uint64(64 * SIG_WORDS)
    flat = np.unique(row.astype(np.int64) * (64 * SIG_WORDS) + bit.astype(np.int64))
    bits = np.zeros(n * 64 * SIG_WORDS, bool)
    bits[flat] = True
    return np.packbits(bits.reshape(n, SIG_WORDS * 64), axis=1, bitorder="little").view(np.uint64)


def flat_lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each element, elements as unsigned, and list sizes."""
    offs = np.asarray(col.offsets)
    tok = col.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
    n = np.diff(offs)
    return np.repeat(np.arange(len(n)), n), tok, n


PART = 1 << 31  # a part number is low * PART + high
POSTING = "tok int, part bigint, ord bigint, n int, cap int, side int, grp int, " + ", ".join(f"s{i} bigint" for i in range(SIG_WORDS))


def split_blocks(tok: np.ndarray, ord_: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which postings to emit, under which part of their block, and in which group they are.

    A block of at most BLOCK_ROWS texts is one part. A larger one has g groups, and each pair of
    groups is a part: a posting goes to the g parts that hold its group, so every pair of texts of
    the block still meets, in one part of bounded size.
    """
    g = np.maximum(1, -(-df.astype(np.int64) // BLOCK_ROWS))
    grp = (C.mix(ord_.astype(np.uint64)) % g.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(tok)), g)
    other = np.arange(len(at)) - np.repeat(np.cumsum(g) - g, g)
    low, high = np.minimum(grp[at], other), np.maximum(grp[at], other)
    return at, low * PART + high, grp


def word_postings(sets: DataFrame, sketch: np.ndarray, t: float) -> DataFrame:
    """One row per text and word of its prefix that another text may share."""
    held = sets.sparkSession.sparkContext.broadcast(sketch)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ord_ = b.column(0).to_numpy()
            row, tok, n = flat_lists(b.column(1))
            sig = signatures(row, tok, len(n))
            by = ranked(row, tok, held.value)
            row, tok = row[by], tok[by]
            begin = np.cumsum(n) - n
            place = np.arange(len(tok)) - begin[row]
            df = held.value[tok & np.uint32((1 << SKETCH_BITS) - 1)]
            prefix = n - np.ceil(t * n - EPS).astype(np.int64) + 1
            take = (place < prefix[row]) & (df > 1)
            row, tok, place, df = row[take], tok[take], place[take], df[take]
            # the largest partner that still reaches the overlap if this is the first common word
            cap = np.floor((n[row] - place) * (1 + t) / t + EPS).astype(np.int64) - n[row]
            at, part, grp = split_blocks(tok, ord_[row], df)
            r = row[at]
            cols = [tok[at].view(np.int32), part, ord_[r], n[r].astype(np.int32), cap[at].astype(np.int32), np.zeros(len(at), np.int32), grp[at].astype(np.int32)]
            cols += [sig[r, i].view(np.int64) for i in range(SIG_WORDS)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in POSTING.split(", ")])

    return sets.select("ord", "toks").mapInArrow(post, POSTING)


class Forest:
    """Signature trees over the rows of all blocks of a task, level by level in arrays."""

    def __init__(self, block: np.ndarray, n: np.ndarray, cap: np.ndarray, sig: np.ndarray):
        low, high, big, sig_ = n, n, cap, sig
        spare = n - np.bitwise_count(sig).sum(axis=1)  # words that share a bit with another of the text
        self.levels = [(block, low, high, big, spare, sig_, np.arange(len(n) + 1))]
        for _ in range(3):
            head = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            size = np.diff(np.concatenate([head, [len(block)]]))
            inner = np.arange(len(block)) - np.repeat(head, size)
            start = np.flatnonzero(inner % LEAF == 0)
            block = block[start]
            low, high, big = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start), np.maximum.reduceat(big, start)
            spare = np.maximum.reduceat(spare, start)
            sig_ = np.bitwise_or.reduceat(sig_, start, axis=0)
            self.levels.append((block, low, high, big, spare, sig_, np.append(start, len(inner))))

    def possible(self, la: int, a: np.ndarray, lb: int, b: np.ndarray, t: float) -> np.ndarray:
        """Which node pairs may hold a pair of texts of similarity t."""
        _, low_a, high_a, big_a, spare_a, sig_a, _ = self.levels[la]
        _, low_b, high_b, big_b, spare_b, sig_b, _ = self.levels[lb]
        na, nb = low_a[a], low_b[b]
        ok = (high_a[a] >= t * nb - EPS) & (high_b[b] >= t * na - EPS) & (nb <= big_a[a]) & (na <= big_b[b])
        at = np.flatnonzero(ok)
        if la < 2 and len(at):  # larger nodes' bitmaps are full
            x, y = a[at], b[at]
            both = np.zeros(len(at), np.int64)
            for i in range(SIG_WORDS):
                both += np.bitwise_count(sig_a[x, i] & sig_b[y, i])
            most = both + np.minimum(spare_a[x], spare_b[y])
            ok[at] = most >= overlap_needed(na[at] + nb[at], t)
        return ok

    def children(self, level: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into x, and child, for all children of the nodes x."""
        start = self.levels[level][6]
        n = start[x + 1] - start[x]
        i = np.repeat(np.arange(len(x)), n)
        return i, start[x][i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)

    def pairs(self, a: np.ndarray, b: np.ndarray, t: float, level: int = 3, same: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Walk the node pairs down to rows; memory is bounded by taking them in slices."""
        for at in range(0, len(a), 1 << 14):
            x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
            ok = self.possible(level, x, level, y, t)
            x, y = x[ok], y[ok]
            if not len(x):
                continue
            i, cx = self.children(level, x)
            if level == 1:  # rows of one side against leaves, then against rows
                ly = y[i]
                ok = self.possible(0, cx, 1, ly, t)
                cx, ly = cx[ok], ly[ok]
                j, cy = self.children(1, ly)
                cx = cx[j]
                if same:
                    keep = cx < cy
                    cx, cy = cx[keep], cy[keep]
                ok = self.possible(0, cx, 0, cy, t)
                yield cx[ok], cy[ok]
            else:
                j, cy = self.children(level, y[i])
                cx = cx[j]
                if same:
                    keep = cx <= cy
                    cx, cy = cx[keep], cy[keep]
                yield from self.pairs(cx, cy, t, level - 1, same)


def block_pairs(t: float, sided: bool):
    """A function over the postings of one partition that gives candidate pairs (a, b), each once.

    Sided: only pairs of a text of side 0 with one of side 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        tab = pa.Table.from_batches(got)
        c = {k: tab.column(k).to_numpy() for k in tab.schema.names}
        sig = np.stack([c[f"s{i}"] for i in range(SIG_WORDS)], axis=1).view(np.uint64)
        block = C.mix(C.mix(c["part"].view(np.uint64)) + c["tok"].astype(np.int64).view(np.uint64))
        by = np.lexsort((c["n"], c["cap"] // 4, c["side"], block))
        ids = np.unique(block, return_inverse=True)[1][by]
        side = c["side"][by]
        size = np.bincount(ids)
        keep = size[ids] > 1
        by, ids, side = by[keep], ids[keep], side[keep]
        if not len(by):
            return
        ord_, n, cap, grp, part = c["ord"][by], c["n"][by].astype(np.int64), c["cap"][by].astype(np.int64), c["grp"][by], c["part"][by]
        forest = Forest(ids.astype(np.int64) * 2 + (side if sided else 0), n, cap, sig[by])
        top = forest.levels[3][0]
        if sided:
            first = np.searchsorted(top, (top // 2) * 2 + 1)
            end = np.searchsorted(top, (top // 2) * 2 + 2)
            count = np.where(top % 2 == 0, end - first, 0)
        else:
            first = np.arange(len(top))
            count = np.searchsorted(top, top, side="right") - first
        tops = np.arange(len(top))
        found: list[np.ndarray] = []
        held = 0
        for lo in range(0, len(top), 4096):
            k = count[lo : lo + 4096]
            a = np.repeat(tops[lo : lo + 4096], k)
            b = np.repeat(first[lo : lo + 4096], k) + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
            for x, y in forest.pairs(a, b, t, 3, not sided):
                wide = part[x] // PART != part[x] % PART
                ok = ~wide | (grp[x] != grp[y])
                x, y = ord_[x[ok]], ord_[y[ok]]
                ok = x != y
                x, y = x[ok], y[ok]
                if not sided:
                    x, y = np.minimum(x, y), np.maximum(x, y)
                if len(x):
                    found.append(np.stack([x, y], axis=1))
                    held += len(x)
                if held > 1 << 21:
                    found = [np.unique(np.concatenate(found), axis=0)]
                    if len(found[0]) > 1 << 20:
                        yield _pairs(found.pop())
                    held = sum(map(len, found))
        if found:
            yield _pairs(np.unique(np.concatenate(found), axis=0))

    return run


def _pairs(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], ["a", "b"])


def task_count(sets: DataFrame, t: float, features: float = 1.0) -> int:
    """Tasks for the postings of all prefixes, so that each holds about PART_ROWS of them: what a task
    gathers does not grow with the input."""
    n = F.size("toks")
    rows = sets.agg(F.sum(n - F.ceil(n * t) + 1)).first()[0] or 0
    return max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(rows * features) // PART_ROWS))


def candidates(postings: DataFrame, t: float, parts: int, sided: bool = False) -> DataFrame:
    """Distinct candidate pairs (a, b) of all blocks, searched by so many tasks."""
    pairs = postings.repartition(parts, "tok", "part").mapInArrow(block_pairs(t, sided), "a bigint, b bigint")
    return pairs.distinct()


def verified(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """(a, b, shared, similarity) of the candidate pairs whose sets reach t, on the words themselves."""
    s = sets.select("ord", "toks")
    both = pairs.join(s.withColumnsRenamed({"ord": "a", "toks": "ta"}), "a").join(s.withColumnsRenamed({"ord": "b", "toks": "tb"}), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ra, ta, na = flat_lists(b.column(2))
            rb, tb, nb = flat_lists(b.column(3))
            key = np.concatenate([ra.astype(np.uint64) << np.uint64(32) | ta, rb.astype(np.uint64) << np.uint64(32) | tb])
            key.sort()
            twice = key[1:][key[1:] == key[:-1]] >> np.uint64(32)
            shared = np.bincount(twice.astype(np.int64), minlength=b.num_rows)
            sim = shared / (na + nb - shared)
            ok = np.flatnonzero(sim >= t - EPS)
            take = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(shared[ok].astype(np.int32)), pa.array(sim[ok])], ["a", "b", "shared", "similarity"])

    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint, shared int, similarity double")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the least vertex of each one's component, by label passing with jumps."""
    v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    lab = np.arange(len(v))
    while True:
        lo = np.minimum(lab[x], lab[y])
        new = lab.copy()
        np.minimum.at(new, lab[x], lo)
        np.minimum.at(new, lab[y], lo)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        new = new[lab]
        if (new == lab).all():
            return v, v[lab]
        lab = new


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as a star forest with the same components."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    tab = pa.Table.from_batches(got)
    v, root = _forest(tab.column(0).to_numpy(), tab.column(1).to_numpy())
    ok = v != root
    yield pa.RecordBatch.from_arrays([pa.array(root[ok]), pa.array(v[ok])], ["a", "b"])


ONE_TASK_EDGES = 2_000_000


def components(edges: DataFrame) -> DataFrame:
    """(v, root): each vertex of the edges (a, b) with the least vertex of its component.

    Every partition first reduces its edges to a star forest. While more than ONE_TASK_EDGES are
    left, a round hooks each vertex to its least neighbour, relabels the edges by it and keeps the
    hooks; at or below that one task finishes. Nothing goes to the driver but the number of edges.
    """
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = stage(edges.select("a", "b").mapInArrow(_shrink, "a bigint, b bigint"), "edges")
    hooks: list[DataFrame] = []
    while left.count() > ONE_TASK_EDGES:
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stage(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "hooks")
        hooks.append(hook)
        x = left.join(hook.withColumnsRenamed({"v": "a", "root": "ra"}), "a").join(hook.withColumnsRenamed({"v": "b", "root": "rb"}), "b")
        x = x.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a <> b").distinct()
        left = stage(x.repartition(parts, "a").mapInArrow(_shrink, "a bigint, b bigint"), "edges")
    out = left.coalesce(1).mapInArrow(_shrink, "a bigint, b bigint").select(F.col("b").alias("v"), F.col("a").alias("root"))
    for hook in reversed(hooks):
        up = hook.join(out.select(F.col("v").alias("root"), F.col("root").alias("top")), "root", "left")
        up = up.select("v", F.coalesce("top", "root").alias("root")).filter("v <> root")
        out = stage(up.unionByName(out.join(up.select("v"), "v", "left_anti")), "roots")
    return out


def set_classes(sets: DataFrame) -> tuple[DataFrame, int]:
    """(ord, rep, copies, toks): rows with equal word sets share the least ord as rep.

    Staged; the words stay with the representative only.
    """
    total = sets.count()
    reps = sets.groupBy("d1", "d2").agg(F.min("ord").alias("rep"), F.count("*").alias("copies"))
    joined = attach(sets, reps, ["d1", "d2"], "copies", total)
    kept = F.when(F.col("ord") == F.col("rep"), F.col("toks")).alias("toks")
    more = [c for c in sets.columns if c not in ("ord", "d1", "d2", "toks")]
    return stage(joined.select("ord", "rep", "copies", kept, *more), "classes"), total
