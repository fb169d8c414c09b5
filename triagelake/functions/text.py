"""Text expressions: normalizers, keyword tests, pattern extraction, shingles. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDED = ("ığüşöç", "igusoc")  # fixed values: letters and what they fold to
ACCENTED = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
WORD_EDGE = "[^\\p{L}\\p{N}_]"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f uses it and wherever the optimizer moves the result."""
    return F.transform(F.array(c), lambda x: f(x)).getItem(0)


def clean(c: Column) -> Column:
    """White space of any kind squashed to one space and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(text_or_empty(c), "[\\s\\p{Z}]+", " "))


def low(c: Column) -> Column:
    """Lower case; the dotted capital I gives i and a combining dot, as Unicode has it."""
    return F.lower(text_or_empty(c))


def ascii_fold(c: Column) -> Column:
    return F.translate(low(c), *FOLDED)


def strip_accents(c: Column) -> Column:
    """Lower case without Latin accents; the dotless i becomes i."""
    plain = F.translate(low(c), ACCENTED[0] + FOLDED[0], ACCENTED[1] + FOLDED[1])
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "\\p{M}", ""), "[\\s\\p{Z}]+", " "))


def rule_text(c: Column) -> Column:
    """Case-folded (ß as ss) with single spaces, for rules over whole tokens."""
    return F.trim(F.regexp_replace(F.replace(low(c), F.lit("ß"), F.lit("ss")), "[\\s\\p{Z}]+", " "))


def overlap_text(c: Column) -> Column:
    """Lower case without links, mentions, hash signs and punctuation: the form whose hash is compared."""
    x = F.regexp_replace(low(c), "https?://\\S+|www\\.\\S+", " ")
    x = F.regexp_replace(x, "@[\\p{L}\\p{N}_]+", " ")
    x = F.regexp_replace(x, "[^\\p{L}\\p{N}_\\s]", " ")
    return F.trim(F.regexp_replace(x, "[\\s\\p{Z}]+", " "))


def place_name(c: Column) -> Column:
    """struct(clean, normalized) of a place name without its trailing type word."""
    x = F.trim(F.regexp_replace(low(c), "\\s+(mahallesi|mahalle|mah\\.?|mh\\.?|köyü|semti)\\s*$", ""))
    return F.struct(x.alias("clean"), F.translate(x, *FOLDED).alias("normalized"))


def any_of(c: Column, words: Sequence[str]) -> Column:
    """Whether any word occurs as a substring; words are joined into one pattern and read as patterns."""
    return text_or_empty(c).rlike("|".join(words))


def any_word(c: Column, words: Sequence[str]) -> Column:
    return text_or_empty(c).rlike(f"(^|{WORD_EDGE})({'|'.join(words)})({WORD_EDGE}|$)")


def weighted_score(c: Column, weights: dict[str, tuple[int, Sequence[str]]]) -> Column:
    """Sum of category weights over the distinct keywords that occur literally."""
    def total(t: Column) -> Column:
        return reduce(lambda a, b: a + b, (F.when(F.contains(t, F.lit(w)), k).otherwise(0) for k, words in weights.values() for w in words))

    return bind(c, total)


def findall(c: Column, patterns: Sequence[str], joiner: str = " | ") -> Column:
    """All matches, pattern by pattern, joined."""
    return F.concat_ws(joiner, F.flatten(F.array(*(F.regexp_extract_all(text_or_empty(c), F.lit(p), F.lit(0)) for p in patterns))))


def first_group(c: Column, patterns: dict[str, str]) -> Column:
    """struct(value, pattern): group 1 of the first pattern, in order, that matches."""
    found = {k: F.nullif(F.trim(F.regexp_extract(text_or_empty(c), p, 1)), F.lit("")) for k, p in patterns.items()}
    which = reduce(lambda acc, k: acc.when(found[k].isNotNull(), k), found, F)
    return F.struct(F.coalesce(*found.values()).alias("value"), which.alias("pattern"))


def all_groups(c: Column, patterns: Sequence[str]) -> Column:
    parts = F.flatten(F.array(*(F.regexp_extract_all(text_or_empty(c), F.lit(p), F.lit(1)) for p in patterns)))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def split_list(c: Column, sep: str = ",") -> Column:
    return F.filter(F.transform(F.split(text_or_empty(c), sep), lambda x: F.trim(x)), lambda x: x != "")


def shingles(c: Column, k: int = 5) -> Column:
    """Distinct k-character shingles; a shorter text is one shingle, an empty one none."""
    n = F.greatest(F.length(c) - (k - 1), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(c, i, F.lit(k))), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    inter = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(inter, F.size(a) + F.size(b) - inter), F.lit(0.0))


def excerpt(c: Column, n: int, mark: str = "...") -> Column:
    flat = F.regexp_replace(text_or_empty(c), "[\\r\\n]+", " ")
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit(mark))).otherwise(flat)


def true_flags(flags: dict[str, Column], joiner: str = ",") -> Column:
    return F.concat_ws(joiner, F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items()))))


def is_placeholder(c: Column, words: Sequence[str] = ("unknown", "nan", "n/a", "none", "null", "-")) -> Column:
    return F.lower(F.trim(text_or_empty(c))).isin(*words)
