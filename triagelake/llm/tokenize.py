"""p8: the whole corpus as ids of a public byte-level BPE, by a table of distinct words.

Texts are split into the tokenizer's words in Spark. Blocks of documents name their distinct words,
each distinct word of the corpus is encoded once, and its ids are joined back to the blocks that
hold it and set in by position. No word occurrence is shuffled by itself. Decoding gathers the
bytes of each id from the id-to-piece table, whose size is the vocabulary's.

Defined cases: a null and an empty text both have an empty list; strings that look like special
tokens are ordinary text; texts are read whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.wordsets import attach
from triagelake.store import stage

TOKENIZERS = "/opt/tokenizers"
# Fixed value: how byte-level BPE vocabularies of this family split text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_CHARS = 4_000_000  # a block of documents holds about so many characters


def _splitter():
    import regex

    return regex.compile(WORDS).findall


def _encoder(folder: str, name: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{folder}/{name}.json")
    t.encode_special_tokens = True
    return t


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, by rule."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def corpus_ids(documents: DataFrame, doc_id: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of every document, ids without special tokens."""
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chars, rows = docs.agg(F.sum(F.length("text")), F.count("*")).first()
    blocks = max(1, -(-(chars or 0) // BLOCK_CHARS), -(-rows // 50_000))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter()
        seen: dict[int, set[str]] = {}
        held = 0
        for b in batches:
            for text, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mine = seen.setdefault(block, set())
                before = len(mine)
                mine.update(split(text))
                held += len(mine) - before
            if held > 2_000_000:
                yield from _words(seen)
                seen, held = {}, 0
        yield from _words(seen)

    def _words(seen: dict[int, set[str]]) -> Iterator[pa.RecordBatch]:
        for block, words in seen.items():
            got = list(words)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(got), pa.int32()), pa.array(got, pa.string())], ["block", "word"])

    held = docs.select("text", "block").mapInArrow(distinct, "block int, word string").distinct()
    held = stage(held, "block-words")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _encoder(folder, name)
        for b in batches:
            got = [x.ids for x in t.encode_batch(b.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.int32()))], ["word", "blocks", "ids"])

    coded = held.groupBy("word").agg(F.count("*").alias("blocks")).mapInArrow(encode, "word string, blocks bigint, ids array<int>")
    # a common word is in every block: such words are few and are broadcast
    table = attach(held, stage(coded, "coded"), ["word"], "blocks", held.count()).select("block", "word", "ids")

    def place(key: tuple, docs: pa.Table, words: pa.Table) -> pa.Table:
        split = _splitter()
        ids = words.column("ids").combine_chunks()
        flat, offs = ids.flatten().to_numpy(), np.asarray(ids.offsets) - ids.offsets[0].as_py() if len(ids) else np.zeros(1, np.int64)
        at = {w: i for i, w in enumerate(words.column("word").to_pylist())}
        size, out, lens = np.diff(offs), [], []
        for text in docs.column("text").to_pylist():
            k = np.fromiter(map(at.__getitem__, split(text)), np.int64)
            n = size[k]
            total = int(n.sum())
            out.append(flat[np.repeat(offs[:-1][k] - np.cumsum(n) + n, n) + np.arange(total)] if total else flat[:0])
            lens.append(total)
        ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
        data = np.concatenate(out) if out else np.zeros(0, np.int32)
        return pa.table({"doc_id": docs.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(data.astype(np.int32)))})

    return docs.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(place, "doc_id bigint, ids array<int>")


def decoded(coded: DataFrame, doc_id: str, ids: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) from ids: a broadcast join with the id-to-piece table of the vocabulary."""
    with open(f"{folder}/{name}.json", encoding="utf-8") as f:
        model = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    pieces = [b""] * (max(model.values()) + 1)
    for piece, i in model.items():
        pieces[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
    held = coded.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for b in batches:
            got = [b"".join([p[i] for i in x]).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], ["doc_id", "text"])

    return coded.select(doc_id, ids).mapInArrow(run, "doc_id bigint, text string")
