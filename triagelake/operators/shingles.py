"""Character shingles as hashes, and pairs of texts that share most of them, batch by batch in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIG_WORDS = 4
PAIR_ROWS = 1 << 13  # pairs compared at once: their number must fit 14 bits
SLICE = 2000  # texts whose shingles are made at once
PAIRS = 1 << 20  # candidate pairs looked at at once
GROUP = 24_000_000  # shingles of a group of texts


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts on end, in their upper bits, and how many each has. A text shorter than k
    is one shingle, an empty one has none."""
    size = np.array([len(t) for t in texts], np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    begin = np.cumsum(size) - size
    count = np.where(size == 0, 0, np.maximum(size - k + 1, 1))
    row = np.repeat(np.arange(len(texts)), count)
    at = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    x = np.concatenate([cp + np.uint64(1), np.zeros(k, np.uint64)])
    h = np.zeros(len(cp), np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + x[i : i + len(cp)])
    h = h[at]
    short = np.flatnonzero(size[row] < k)
    at, end, g = at[short], (begin + size)[row[short]], np.zeros(len(short), np.uint64)
    for i in range(k):
        g = _mix(g * np.uint64(0x9E3779B97F4A7C15) + np.where(at + i < end, x[at + i], np.uint64(0)))
    h[short] = g
    low = np.uint64(max(14, len(texts).bit_length()))  # row in the upper bits, the upper bits of the hash below: one plain sort
    key = np.sort(row.astype(np.uint64) << (np.uint64(64) - low) | h >> low)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key << low, np.bincount((key >> (np.uint64(64) - low)).astype(np.int64), minlength=len(texts))


def sized_texts(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """df (key, text, ...) with n, how many distinct shingles each text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in ((b, at) for b in batches for at in range(0, b.num_rows, SLICE)):
            b = whole.slice(at, SLICE)
            n = shingle_hashes(b.column(text).to_pylist(), k)[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n.astype(np.int32))], [*b.schema.names, "n"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, n int")


def band_of(n: np.ndarray, t: float) -> np.ndarray:
    """Bands of sizes: the largest size of a band is at most 1/t times its least."""
    return np.floor(np.log(np.maximum(n, 1)) / -np.log(t)).astype(np.int64)


def most_apart(na: np.ndarray | int, nb: np.ndarray | int, t: float) -> np.ndarray:
    """In how many shingles two sets of na and nb differ at most if they reach Jaccard t."""
    return np.floor((na + nb) * ((1 - t) / (1 + t)) + 1e-9).astype(np.int64)


def _prints(texts: list[str], k: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A digest of the shingles in each part, parity bits of all shingles, and the sizes."""
    keys, bits, sizes = [], [], []
    for at in range(0, len(texts), SLICE):
        h, n = shingle_hashes(texts[at : at + SLICE], k)
        row = np.repeat(np.arange(len(n)), n)
        part = ((_mix(h + np.uint64(0x51ED27)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cell = row * parts + part
        mixed = _mix(h * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7)) >> np.uint64(32)
        key = np.bincount(cell, weights=mixed.astype(np.float64), minlength=len(n) * parts).astype(np.uint64)  # sums of 32 bits, exact
        keys.append((_mix(_mix(key)) >> np.uint64(16)).astype(np.uint32).reshape(len(n), parts))
        bit = row * (64 * SIG_WORDS) + ((h >> np.uint64(24)) % np.uint64(64 * SIG_WORDS)).astype(np.int64)
        odd = (np.bincount(bit, minlength=len(n) * 64 * SIG_WORDS) & 1).astype(bool)
        bits.append(np.packbits(odd.reshape(len(n), -1), axis=1, bitorder="little").view(np.uint64))
        sizes.append(n)
    return np.concatenate(keys), np.concatenate(bits), np.concatenate(sizes)


def _alike(left: list[str], right: list[str], k: int, t: float, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of texts that have the shingles of one part in common, fit by size, and differ in no more
    parity bits than sets of Jaccard t may."""
    (ka, ba, na), (kb, bb, nb) = _prints(left, k, parts), _prints(right, k, parts)
    found = np.zeros(0, np.int64)
    for i in range(parts):
        by = np.argsort(kb[:, i], kind="stable")
        key = kb[by, i]
        first = np.searchsorted(key, ka[:, i])
        count = np.searchsorted(key, ka[:, i], side="right") - first
        end = np.cumsum(count)
        for lo in range(0, int(end[-1]), PAIRS):  # a part that very many texts share is taken in slices
            at = np.arange(lo, min(lo + PAIRS, int(end[-1])))
            x = np.searchsorted(end, at, side="right")
            y = by[first[x] + at - (end - count)[x]]
            ok = (np.minimum(na[x], nb[y]) >= t * np.maximum(na[x], nb[y]) - 1e-9).nonzero()[0]
            x, y = x[ok], y[ok]
            apart = np.zeros(len(x), np.int64)
            for w in range(SIG_WORDS):
                apart += np.bitwise_count(ba[x, w] ^ bb[y, w])
            ok = apart <= most_apart(na[x], nb[y], t)
            found = np.union1d(found, x[ok] * len(right) + y[ok])
    return found // len(right), found % len(right)


def near_pairs(texts: DataFrame, k: int, t: float) -> DataFrame:
    """(a, b, similarity) of the rows (id, t, n, l, r) of distinct texts: all pairs of a text of l with another
    of r whose shingle sets reach Jaccard t.

    Sets of Jaccard t differ in a bounded number of shingles. If the shingles are dealt by their hash to
    one part more, some part is the same in both: no pair is lost. Texts travel as they are, once to each
    pair of groups of their band of sizes, and all else is made and dropped in the task: nothing of the size of
    all shingles is ever written. The number of groups of a band follows from its texts, so a task holds
    at most GROUP shingles of a side.
    """
    sizes = np.array([tuple(x) for x in texts.groupBy("n").agg(F.count_if("l").alias("l"), F.count_if("r").alias("r")).collect()], np.int64).reshape(-1, 3)
    held = lambda band, side: int(sizes[_in_band(sizes[:, 0], band, side, t), 1 + side].sum())
    inner = [(int(x), held(x, 0), held(x, 1)) for x in np.unique(band_of(sizes[:, 0], t))]
    most = lambda band: int(np.ceil(t ** -(band + 1)))
    groups = {band: [max(1, -(-c * most(band) // GROUP)) for c in (nl, nr)] for band, nl, nr in inner if nl and nr}
    kind = "task bigint, side int, id bigint, t string"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_, n = b.column("id").to_numpy(), b.column("n").to_numpy()
            for side in (0, 1):
                have = np.flatnonzero(np.asarray(b.column("lr"[side])))
                for band in groups:
                    x = have[_in_band(n[have], band, side, t)]
                    own, others = groups[band][side], groups[band][1 - side]
                    grp = (_mix(id_[x].view(np.uint64)) % np.uint64(own)).astype(np.int64)
                    for other in range(others if len(x) else 0):
                        task = (band << 40) + ((grp << 20) + other if side == 0 else (other << 20) + grp)
                        take = pa.array(x)
                        yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(np.full(len(x), side, np.int32)), b.column("id").take(take), b.column("t").take(take)], ["task", "side", "id", "t"])

    def search(tab: pa.Table) -> pa.Table:
        side = tab.column("side").to_numpy()
        id_ = tab.column("id").to_numpy()
        at = [np.flatnonzero(side == i) for i in (0, 1)]
        top = most(int(tab.column("task")[0].as_py()) >> 40)
        got = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(at[0]) and len(at[1]):
            text = [tab.column("t").take(pa.array(i)).to_pylist() for i in at]
            x, y = _alike(*text, k, t, int(most_apart(top, int(top / t) + 1, t)) + 1)
            other = id_[at[0][x]] != id_[at[1][y]]
            x, y = x[other], y[other]
            parts = []
            for lo in range(0, len(x), SLICE):
                i, j = x[lo : lo + SLICE], y[lo : lo + SLICE]
                sim = jaccard(*shingle_hashes([text[0][v] for v in i], k), *shingle_hashes([text[1][v] for v in j], k))
                ok = sim >= t - 1e-9
                parts.append((id_[at[0][i[ok]]], id_[at[1][j[ok]]], sim[ok]))
            if parts:
                got = [np.concatenate(c) for c in zip(*parts)]
        return pa.table([pa.array(c) for c in got], ["a", "b", "similarity"])

    tasks = 2 * sum(a * b for a, b in groups.values())
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select("id", "t", "n", "l", "r").mapInArrow(deal, kind).repartition(max(least, tasks), "task")  # few bytes, much work: not to be put together
    return dealt.groupBy("task").applyInArrow(search, "a bigint, b bigint, similarity double")


def _in_band(n: np.ndarray, band: int, side: int, t: float) -> np.ndarray:
    """Texts of the right are in the band of their size, those of the left in all bands of sizes that fit."""
    if side:
        return band_of(n, t) == band
    return (band_of(t * n - 1e-6, t) <= band) & (band <= band_of(n / t + 1e-6, t))


def jaccard(ha: np.ndarray, na: np.ndarray, hb: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The Jaccard of row by row of two lists of sets, given on end."""
    # row in the upper bits, 50 bits of the hash below: one sort finds all shared ones
    key = np.sort(np.concatenate([np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(50) | h >> np.uint64(14) for h, n in ((ha, na), (hb, nb))]))
    twice = key[1:][key[1:] == key[:-1]] >> np.uint64(50)
    shared = np.bincount(twice.astype(np.int64), minlength=len(na))
    return shared / np.maximum(1, na + nb - shared)


def similar_pairs(pairs: DataFrame, t: float) -> DataFrame:
    """(a, b, similarity) of the rows (a, b, sa, sb) whose shingle sets reach Jaccard t, on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in ((b, at) for b in batches for at in range(0, b.num_rows, PAIR_ROWS)):
            b = whole.slice(at, PAIR_ROWS)
            sets = [x for i in (2, 3) for x in (b.column(i).flatten().to_numpy().view(np.uint64), np.diff(np.asarray(b.column(i).offsets)))]
            sim = jaccard(*sets)
            ok = np.flatnonzero(sim >= t - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), b.column(1).take(pa.array(ok)), pa.array(sim[ok])], ["a", "b", "similarity"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint, similarity double")
