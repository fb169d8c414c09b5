"""p2: copies hidden by formatting, by radix partitioning on canonical bytes and counting tries.

The canonical form of a text keeps its letters, digits, marks and emoji, case-folded, without white
space and punctuation; the fields of a labelled text are put in one order. Canonical bytes are
partitioned by their leading bytes: buckets with too many texts are split by further bytes until
each fits, and each bucket is counted in a trie whose terminals count the copies.

The letters I, i, ı and İ fold to one byte, since I is the capital of ı in Turkish and of i in
English. Terminals keep how each text wrote them, so that two texts that differ by ı against i, with
no capital I between them, stay two records.

Defined cases: null texts and texts without letters or digits are left out; repeated rows are
copies; texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm import codepoints as C
from triagelake.llm.wordsets import attach
from triagelake.store import stage

# The labels of labelled messages.
LABELS = ("il", "ilçe", "mahalle", "adres", "durum", "ihtiyaç", "kişi", "saat")
MIN_LABELS = 4  # a text is labelled if it starts with a label and holds this many different ones
BUCKET_ROWS = 20_000
MAX_SPLIT = 2048  # so many split prefixes of a depth are broadcast, more are joined
CHUNK_ROWS = 200_000  # rows whose copies are combined at once before they are shuffled


def _label_hashes(labels: tuple[str, ...]) -> np.ndarray:
    cp, offs = C.folded(pa.array([x for x in labels]))
    return C.words(cp, offs).hash


def canonical_forms(col: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical code points, row offsets, and the kind of i of each: 0 other, 1 ı, 2 i or İ, 3 I."""
    t = C.tables()
    cp, offs = C.decode(col)
    cp, offs = C.canonical(cp, offs, look_alikes=False)
    low = C.gather(t["fold"], cp)
    keep = C.gather(t["word"], low) | (C.gather(t["emoji"], low) & (low > 0xFF))
    w = C.words(low, offs)
    keep &= (np.diff(w.offs) > 0)[C.row_of(offs)]  # emoji alone are no record
    if len(w.hash):
        is_label = np.isin(w.hash, labels)
        n = len(offs) - 1
        kinds = np.unique(np.stack([w.row[is_label], np.searchsorted(np.sort(labels), w.hash[is_label])]), axis=1)
        many = np.bincount(kinds[0], minlength=n) >= MIN_LABELS
        heads = w.offs[:-1][np.diff(w.offs) > 0]
        starts = np.zeros(n, bool)
        starts[w.row[heads]] = is_label[heads]
        fields = many & starts
        if fields.any():
            head = is_label & fields[w.row]
            at = np.flatnonzero(head)
            # every word of a labelled row belongs to the segment of the last label before it
            seg_of_word = np.cumsum(head) - 1
            inside = fields[w.row]
            place = np.arange(len(w.hash)) - at[np.maximum(seg_of_word, 0)]
            part = C.mix(w.hash * np.uint64(3) + place.astype(np.uint64))
            seg_hash = np.zeros(len(at), np.uint64)
            np.add.at(seg_hash, seg_of_word[inside], part[inside])
            row_of_seg = w.row[at]
            order = np.lexsort((seg_hash, row_of_seg))
            seg_start = w.start[at]
            seg_end = np.append(seg_start[1:], 0)
            last = np.append(row_of_seg[1:] != row_of_seg[:-1], True)
            seg_end[last] = offs[1:][row_of_seg[last]]
            size = (seg_end - seg_start)[order]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            moved = np.repeat(seg_start[order], size) + inner
            index = np.arange(len(low))
            target = np.concatenate([np.arange(a, b) for a, b in zip(seg_start[_firsts(row_of_seg)], offs[1:][row_of_seg[_firsts(row_of_seg)]])])
            index[target] = moved
            low, cp, keep = low[index], cp[index], keep[index]
    kind = np.zeros(len(low), np.uint8)
    kind[low == ord("i")] = 2
    kind[cp == 0x131] = 1
    kind[cp == ord("I")] = 3
    low2, offs2 = C.keep_only(low, offs, keep)
    return low2, offs2, kind[keep]


def _firsts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def _digest(cp: np.ndarray, kind: np.ndarray, offs: np.ndarray, salt: int) -> np.ndarray:
    place = (np.arange(len(cp)) - np.repeat(offs[:-1], np.diff(offs))).astype(np.uint64)
    part = C.mix((cp.astype(np.uint64) << np.uint64(24)) + (kind.astype(np.uint64) << np.uint64(56)) + place + np.uint64(salt << 40))
    return C.mix(np.add.reduceat(part, offs[:-1]))


FORMS = "ord bigint, d1 bigint, d2 bigint, form binary, kinds binary, least bigint, n bigint"


def _forms(labels: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _label_hashes(labels)
        for b in batches:
            for at in range(0, b.num_rows, 5000):
                part = b.slice(at, 5000)
                cp, offs, kind = canonical_forms(part.column(1), known)
                have = np.flatnonzero(np.diff(offs))
                if not len(have):
                    continue
                offs = np.append(offs[:-1][have], offs[-1])
                d1, d2 = _digest(cp, kind, offs, 1), _digest(cp, kind, offs, 2)
                ord_ = part.column(0).take(pa.array(have)).to_numpy()
                # copies within the batch are counted here: only the first of them carries the bytes
                _, first, group, n = np.unique(d1 ^ C.mix(d2), return_index=True, return_inverse=True, return_counts=True)
                least = np.full(len(first), np.iinfo(np.int64).max)
                np.minimum.at(least, group, ord_)
                lead = np.zeros(len(have), bool)
                lead[first] = True
                form = C.encode(cp, offs, lead).cast(pa.binary())
                is_i = kind > 0
                i_cp, i_offs = C.keep_only((kind + 48).astype(np.uint32), offs, is_i)
                kinds = C.encode(i_cp, i_offs, lead).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ord_), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), form, kinds, pa.array(least[group]), pa.array(n[group])],
                    ["ord", "d1", "d2", "form", "kinds", "least", "n"],
                )

    return run


def bucketed(forms: DataFrame) -> DataFrame:
    """forms with their bucket: the radix partitioning, by depth 2, 4, 8, ...

    A round counts the texts of the buckets still open by their next bytes; buckets of more than
    BUCKET_ROWS texts are open, and their prefixes stay a table that the texts are joined with.
    """
    out = forms.withColumn("bucket", F.substring("form", 1, 2)).withColumn("_open", F.lit(True))
    depth = 2
    while True:
        prefix = F.substring("form", 1, depth)
        big = out.filter(F.col("_open") & (F.length("form") > depth)).groupBy(prefix.alias("_p")).agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET_ROWS)
        big = stage(big.select("_p", F.lit(True).alias("_split")), "prefixes")
        n = big.count()
        if not n:
            return out.drop("_open")
        out = out.join(F.broadcast(big) if n <= MAX_SPLIT else big, prefix == F.col("_p"), "left")
        out = out.withColumn("_open", F.col("_open") & F.coalesce("_split", F.lit(False))).drop("_p", "_split")
        depth *= 2
        out = out.withColumn("bucket", F.when(F.col("_open"), F.substring("form", 1, depth)).otherwise(F.col("bucket")))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one digest as one row, CHUNK_ROWS at a time: a hot record sends a row a chunk."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            tab = pa.Table.from_batches(held).combine_chunks()
            got = tab.group_by(["d1", "d2"], use_threads=False).aggregate([("bucket", "first"), ("form", "first"), ("kinds", "first"), ("least", "min"), ("n", "sum")])
            yield from got.select(["bucket_first", "d1", "d2", "form_first", "kinds_first", "least_min", "n_sum"]).rename_columns(["bucket", "d1", "d2", "form", "kinds", "least", "n"]).to_batches()

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK_ROWS:
            yield from flush(held)
            held = []
    yield from flush(held)


class Trie:
    """Keys by chunks of bytes; a branch with one key holds its tail, a terminal counts copies."""

    STEP = 8

    def __init__(self) -> None:
        self.root: dict = {}
        self.ends: list[dict[bytes, list]] = []

    def add(self, key: bytes, kinds: bytes, least: int, n: int, digest: tuple[int, int]) -> None:
        node, at, step = self.root, 0, self.STEP
        while True:
            chunk = key[at : at + step]
            at += step
            there = node.get(chunk)
            if there is None:
                end: dict[bytes, list] = {}
                self.ends.append(end)
                node[chunk] = (key[at:], end)
                break
            if type(there) is dict:
                node = there
                continue
            tail, end = there
            if tail == key[at:]:
                break
            node[chunk] = node = {tail[:step]: (tail[step:], end)}  # split the branch
        seen = end.get(kinds)
        if seen is None:
            end[kinds] = [least, n, digest]
        else:
            seen[0] = min(seen[0], least)
            seen[1] += n


def records(end: dict[bytes, list]) -> Iterator[tuple[int, int, list]]:
    """(least ord, copies, digests) of each record at a terminal, by how its texts wrote their i."""
    if len(end) == 1:
        least, n, digest = next(iter(end.values()))
        yield least, n, [digest]
        return
    kinds = np.array([np.frombuffer(k, np.uint8) for k in end])
    either = (kinds == 51).any(axis=0)  # a capital I is both: it joins the two there
    kinds = kinds.copy()
    kinds[:, either] = 0
    by: dict[bytes, list] = {}
    for k, (least, n, digest) in zip(kinds, end.values()):
        r = by.setdefault(k.tobytes(), [least, 0, []])
        r[0] = min(r[0], least)
        r[1] += n
        r[2].append(digest)
    for least, n, digests in by.values():
        yield least, n, digests


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of two or more copies. Rows come in the order of their buckets: one trie is held at a time."""
    trie, of = Trie(), None
    out: list[list[int]] = [[], [], [], []]

    def close() -> None:
        for end in trie.ends:
            for least, n, digests in records(end):
                if n > 1:
                    for d1, d2 in digests:
                        for col, x in zip(out, (d1, d2, least, n)):
                            col.append(x)

    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(7)]
        for bucket, d1, d2, form, kinds, least, n in zip(*cols):
            if bucket != of:
                close()
                trie, of = Trie(), bucket
            trie.add(form, kinds, least, n, (d1, d2))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["d1", "d2", "keep_ord", "copies"])
        out = [[], [], [], []]
    close()
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["d1", "d2", "keep_ord", "copies"])


def formatting_copies(rows: DataFrame, ord_: str, text: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(ord, keep_ord, copies): every row of a record of two or more copies with its least ord."""
    picked = rows.select(F.col(ord_).cast("bigint").alias("ord"), F.col(text).cast("string").alias("text"))
    forms = stage(picked.mapInArrow(_forms(labels), FORMS), "forms")
    total = forms.count()
    variants = forms.filter(F.col("form").isNotNull())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shape = "bucket binary, d1 bigint, d2 bigint, form binary, kinds binary, least bigint, n bigint"
    placed = bucketed(variants).select(*(c.split()[0] for c in shape.split(", "))).mapInArrow(_combined, shape)
    tries = placed.repartition(max(parts, -(-total // 500_000)), "bucket").sortWithinPartitions("bucket")
    counted = tries.mapInArrow(_count, "d1 bigint, d2 bigint, keep_ord bigint, copies bigint")
    found = stage(counted, "records")
    return attach(forms.select("ord", "d1", "d2"), found, ["d1", "d2"], "copies", total).select("ord", "keep_ord", "copies")
