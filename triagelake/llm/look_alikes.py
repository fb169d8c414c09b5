"""p4: one consistent form for text that looks the same, by table gathers over code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm import codepoints as C
from triagelake.llm import wordsets as W
from triagelake.store import stage

HOT_ROWS = 1000  # pairs of larger classes are dealt to several tasks


def canonical_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 5000):
            part = b.slice(at, 5000)
            col = part.column(part.num_columns - 1)
            valid = np.asarray(col.is_valid())
            out = C.encode(*C.canonical(*C.decode(col)), valid)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], col, out], [*part.schema.names, "canonical"])


def consistent_text(rows: DataFrame, ord_: str, text: str) -> DataFrame:
    """(ord, text, canonical) of every row.

    canonical is the text with full-width forms, unusual spaces, hidden characters, combining accents
    and look-alike letters brought to one form (see codepoints.canonical). A null text stays null, an
    empty one empty; texts are read whole.
    """
    picked = rows.select(F.col(ord_).cast("bigint").alias("ord"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(canonical_text, "ord bigint, text string, canonical string")


def same_looking_classes(rows: DataFrame, ord_: str, text: str) -> DataFrame:
    """(class_ord, ord, form_ord, links, rows): one row per row of a class of texts that look the same but are
    written in more than one way.

    class_ord is the least ord of the class, form_ord that of the rows with exactly the same characters,
    links the number of rows of the class written otherwise, rows the size of the class. Texts of which
    nothing is drawn (null, empty, blank) are in no class. Texts are known by 128-bit digests. Sizes are
    aggregated before they are joined back, so a class of very many rows is never gathered.
    """
    forms = consistent_text(rows, ord_, text).filter(F.trim("canonical") != "")
    keyed = stage(forms.select("ord", F.unhex(F.md5("canonical")).alias("look"), F.unhex(F.md5("text")).alias("form")), "looks")
    ways = keyed.groupBy("look", "form").agg(F.min("ord").alias("form_ord"), F.count("*").alias("same"))
    whole = ways.groupBy("look").agg(F.min("form_ord").alias("class_ord"), F.sum("same").alias("rows"), F.count("*").alias("ways")).filter("ways > 1")
    ways = stage(ways.join(whole, "look").drop("ways"), "classes")
    return W.attach(keyed, ways, ["look", "form"], "same", keyed.count()).select("class_ord", "ord", "form_ord", (F.col("rows") - F.col("same")).alias("links"), "rows")


def same_looking_pairs(rows: DataFrame, ord_: str, text: str) -> DataFrame:
    """(ord_a, ord_b): rows whose texts look the same but are not the same characters, smaller first.

    The pairs of same_looking_classes; the rows of a class of very many are dealt to many tasks.
    """
    kept = stage(same_looking_classes(rows, ord_, text), "members")
    a = kept.select("class_ord", F.col("ord").alias("ord_a"), F.col("form_ord").alias("form_a"), "rows")
    b = kept.select("class_ord", F.col("ord").alias("ord_b"), F.col("form_ord").alias("form_b"), "rows")
    return W.salted(a, b, "class_ord", "rows", HOT_ROWS).filter("ord_a < ord_b AND form_a <> form_b").select("ord_a", "ord_b")
