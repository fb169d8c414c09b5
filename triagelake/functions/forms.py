"""Unicode forms, Arrow batch by batch as one text: Spark has no expression for them."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from triagelake.functions import text as T


def _whole(x: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """change applied to all texts of a batch at once; null stays null. Texts are held apart by a character that
    nothing composes with; one that is in a text itself has the batch taken text by text."""
    texts = x.to_pylist()
    if any(t and "\x00" in t for t in texts):
        return pa.array([None if t is None else change(t) for t in texts], pa.string())
    made = change("\x00".join(t or "" for t in texts)).split("\x00")
    return pa.array([None if t is None else m for t, m in zip(texts, made)], pa.string())


@F.arrow_udf(StringType())
def composed(x: pa.Array) -> pa.Array:
    """NFC; null stays null."""
    return _whole(x, lambda t: unicodedata.normalize("NFC", t))


@lru_cache(maxsize=1)
def _marks() -> dict[int, None]:
    """All non-spacing marks, by rule, as a table that removes them."""
    return {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Mn"}


@F.arrow_udf(StringType())
def without_marks(x: pa.Array) -> pa.Array:
    """NFKD without non-spacing marks, composed again; null stays null."""
    return _whole(x, lambda t: unicodedata.normalize("NFC", unicodedata.normalize("NFKD", t).translate(_marks())))


@F.arrow_udf(StringType())
def case_folded(x: pa.Array) -> pa.Array:
    """Full case folding of the NFC form; null stays null."""
    return _whole(x, lambda t: unicodedata.normalize("NFC", t).casefold())


def clean(c: Column) -> Column:
    """functions.text.clean of the composed form."""
    return T.clean(composed(T.text_or_empty(c)))


def strip_accents(c: Column) -> Column:
    """Lower case without any mark, compatibility forms resolved, the dotless i as i, spaces squashed."""
    plain = F.translate(without_marks(F.lower(T.text_or_empty(c))), "ı", "i")
    return F.trim(F.regexp_replace(plain, "[\\s\\p{Z}]+", " "))


def rule_tokens(c: Column) -> Column:
    """Case-folded words (letters, digits, underscores) joined by one space: what whole-token rules read."""
    words = F.split(case_folded(T.text_or_empty(c)), "[^\\p{L}\\p{M}\\p{N}_]+")
    return F.array_join(F.filter(words, lambda w: w != ""), " ")
