"""Text columns as numpy code-point arrays: look-up gathers instead of calls per row.

An Arrow string column is copied once into one array of code points with row offsets. Every
mapping below is a gather in a table over code points, every deletion a boolean mask, every
one-to-many mapping an expansion by offsets, and canonical composition a sequence of vector
passes over adjacent pairs. Tables are built from the interpreter's Unicode data by rule.

Defined cases: a null text has zero code points and stays null; an empty text stays empty; a text
of any length is processed whole.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

TABLE = 0x20000  # code points above are mapped to themselves

# Letters of other scripts that are drawn like Latin ones, and those Latin ones.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ё": "ë", "ї": "ï",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ё": "Ë",
    "Ї": "Ï", "Ү": "Y",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "օ": "o", "ɡ": "g", "ɑ": "a",
}

ZWNJ, ZWJ, VS16 = 0x200C, 0x200D, 0xFE0F


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Look-up tables over code points below TABLE, from Unicode data."""
    same = np.arange(TABLE, dtype=np.uint32)
    plain, lower, fold = same.copy(), same.copy(), same.copy()
    word = np.zeros(TABLE, bool)
    letter = np.zeros(TABLE, bool)
    upper = np.zeros(TABLE, bool)
    hidden = np.zeros(TABLE, bool)
    ccc = np.zeros(TABLE, np.uint8)
    singles = np.zeros(TABLE, bool)
    emoji = np.zeros(TABLE, bool)
    digit = np.zeros(TABLE, bool)
    first, second, whole = [], [], []
    for c in range(0x80):
        ch = chr(c)
        word[c], letter[c], digit[c], upper[c] = ch.isalnum(), ch.isalpha(), ch.isdigit(), ch.isupper()
        lower[c] = ord(ch.lower())
    for c in range(0x80, TABLE):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat == "Cn" or cat == "Co" or cat == "Cs":
            continue
        if cat[0] in "LNM":
            word[c] = True
            letter[c] = cat[0] == "L"
            digit[c] = cat == "Nd"
            upper[c] = cat == "Lu"
        elif cat == "Zs":
            plain[c] = 0x20
        elif cat == "Cf":
            hidden[c] = not 0x600 <= c <= 0x6DD  # number signs of Arabic are drawn
        elif cat in ("So", "Sk"):
            emoji[c] = True
        d = unicodedata.decomposition(ch)
        if d:
            parts = d.split()
            if parts[0] in ("<wide>", "<narrow>"):
                plain[c] = int(parts[1], 16)
            elif parts[0][0] != "<":
                if len(parts) == 1:
                    singles[c] = True
                elif unicodedata.normalize("NFC", ch) == ch:
                    first.append(int(parts[0], 16))
                    second.append(int(parts[1], 16))
                    whole.append(c)
                else:
                    singles[c] = True
        ccc[c] = unicodedata.combining(ch)
        low = ch.lower()
        if len(low) == 1:
            lower[c] = ord(low)
    hidden[0xAD] = hidden[0x034F] = hidden[0x115F] = hidden[0x1160] = True
    for c in (*range(0xFE00, 0xFE10), 0x180B, 0x180C, 0x180D):
        hidden[c] = True
        word[c] = False
    plain[0x2028] = plain[0x2029] = 0x0A
    look = plain.copy()
    for a, b in LOOK_ALIKE.items():
        look[ord(a)] = ord(b)
    lower[0x130] = ord("i")
    fold[:] = lower
    fold[ord("I")] = fold[0x130] = fold[0x131] = ord("i")
    key = np.array(first, np.uint64) << np.uint64(21) | np.array(second, np.uint64)
    order = np.argsort(key)
    return {
        "plain": plain, "look": look, "lower": lower, "fold": fold, "word": word, "letter": letter, "hidden": hidden,
        "ccc": ccc, "singles": singles, "emoji": emoji, "digit": digit, "upper": upper,
        "pair": key[order], "pair_to": np.array(whole, np.uint32)[order],
    }


def gather(table: np.ndarray, cp: np.ndarray) -> np.ndarray:
    """table[cp]; code points beyond the table keep themselves, or False."""
    if not len(cp) or cp.max() < len(table):
        return table[cp]
    over = cp >= len(table)
    out = table[np.where(over, 0, cp)]
    out[over] = cp[over].astype(out.dtype) if out.dtype == np.uint32 else out.dtype.type(0)
    return out


def decode(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows on end, and row offsets; a null row has none."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count or col.offset:
        col = pa.concat_arrays([col.fill_null("")]) if col.null_count else pa.concat_arrays([col, col[:0]])
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(col):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if bufs[2] is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint32), np.zeros(len(col) + 1, np.int64)
    raw = memoryview(bufs[2])[offs[0] : offs[-1]]
    cp = np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    count = np.zeros(len(lead) + 1, np.int64)
    np.cumsum(lead, out=count[1:])
    return cp, count[offs - offs[0]]


def encode(cp: np.ndarray, offs: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """An Arrow string array of the rows."""
    data = cp.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    end = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(width, out=end[1:])
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    out = pa.Array.from_buffers(
        pa.large_string(), len(offs) - 1, [mask, pa.py_buffer(end[offs].astype(np.int64).tobytes()), pa.py_buffer(data)]
    )
    return out.cast(pa.string()) if len(data) < 2**31 else out


def keep_only(cp: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points where keep holds, with offsets to match."""
    if keep.all():
        return cp, offs
    at = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return cp[keep], at[offs]


def row_of(offs: np.ndarray) -> np.ndarray:
    """The row number of every element."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def expand(cp: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Full canonical decomposition by expansion offsets: each code point gives one or more."""
    distinct, at = np.unique(cp, return_inverse=True)
    whole = (distinct >= 0xAC00) & (distinct <= 0xDFFF)  # syllable blocks stay, surrogates too
    parts = [[int(c)] if w else [ord(x) for x in unicodedata.normalize("NFD", chr(int(c)))] for c, w in zip(distinct, whole)]
    size = np.array([len(x) for x in parts], np.int64)
    if (size == 1).all() and all(x[0] == c for x, c in zip(parts, distinct)):
        return cp, offs
    flat = np.array([y for x in parts for y in x], np.uint32)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    n = size[at]
    end = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(n, out=end[1:])
    inner = np.arange(end[-1]) - np.repeat(end[:-1], n)
    return flat[np.repeat(start[at], n) + inner], end[offs]


def compose(cp: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical form (NFC) of all rows: only rows with marks are taken apart and put together."""
    t = tables()
    touchy = (gather(t["ccc"], cp) > 0) | gather(t["singles"], cp) | ((cp >= 0x1161) & (cp < 0x1200))
    if not touchy.any():
        return cp, offs
    row = row_of(offs)
    flagged = np.zeros(len(offs) - 1, bool)
    flagged[row[touchy]] = True
    pick = flagged[row]
    lens = np.diff(offs)
    sub_offs = np.concatenate([[0], np.cumsum(lens[flagged])])
    x, o = expand(cp[pick], sub_offs)
    r = row_of(o)
    while True:  # canonical order of marks
        c = gather(t["ccc"], x)
        swap = np.flatnonzero((c[:-1] > c[1:]) & (c[1:] > 0) & (r[:-1] == r[1:]))
        if not len(swap):
            break
        swap = swap[np.concatenate([[True], np.diff(swap) > 1])]
        x[swap], x[swap + 1] = x[swap + 1].copy(), x[swap].copy()
    alive = np.ones(len(x), bool)
    blocked = np.zeros(len(x), bool)
    while len(t["pair"]):  # each pass tries the first open mark after every starter
        live = np.flatnonzero(alive)
        c = gather(t["ccc"], x[live])
        starter = np.maximum.accumulate(np.where(c == 0, np.arange(len(live)), -1))
        has = (starter >= 0) & (c > 0) & ~blocked[live]
        has &= r[live[np.maximum(starter, 0)]] == r[live]
        before = np.concatenate([[0], c[:-1]])
        has &= (before < c) | (np.arange(len(live)) == starter + 1)
        i = np.flatnonzero(has)
        if not len(i):
            break
        lead = starter[i]
        i = i[np.concatenate([[True], lead[1:] != lead[:-1]])]
        lead = starter[i]
        key = x[live[lead]].astype(np.uint64) << np.uint64(21) | x[live[i]].astype(np.uint64)
        at = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
        hit = t["pair"][at] == key
        x[live[lead[hit]]] = t["pair_to"][at[hit]]
        alive[live[i[hit]]] = False
        blocked[live[i[~hit]]] = True
    x, o = keep_only(x, o, alive)
    x, o = _blocks(x, o)
    out_len = lens.copy()
    out_len[flagged] = np.diff(o)
    new = np.concatenate([[0], np.cumsum(out_len)])
    out = np.empty(new[-1], np.uint32)
    here = flagged[row_of(new)]
    out[here] = x
    out[~here] = cp[~pick]
    return out, new


def _blocks(x: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Conjoining letters of syllable blocks are put together by the arithmetic of the standard."""
    if not ((x >= 0x1100) & (x <= 0x11FF)).any():
        return x, o
    for second, count, lead, step in ((0x1161, 21, 0x1100, 588), (0x11A8, 27, 0xAC00, 1)):
        r = row_of(o)
        a, b = x[:-1].astype(np.int64), x[1:].astype(np.int64)
        hit = (b >= second) & (b < second + count) & (r[:-1] == r[1:])
        if step == 588:
            hit &= (a >= lead) & (a < lead + 19)
            made = 0xAC00 + (a - lead) * 588 + (b - second) * 28
        else:
            hit &= (a >= lead) & (a < 0xD7A4) & ((a - lead) % 28 == 0)
            made = a + (b - second) + 1
        at = np.flatnonzero(hit)
        x = x.copy()
        x[at] = made[at].astype(np.uint32)
        keep = np.ones(len(x), bool)
        keep[at + 1] = False
        x, o = keep_only(x, o, keep)
    return x, o


def canonical(cp: np.ndarray, offs: np.ndarray, look_alikes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """One form for texts that look the same.

    Full-width and half-width forms become ordinary ones, unusual spaces the ordinary space, line
    ends one line feed, characters that are not drawn go (a joiner between two emoji stays, as it
    changes the emoji shown, and so does an emoji's variation sign), accents are composed, and
    letters of other scripts that are drawn like Latin ones become those. Case, accents, the number
    of spaces and the emoji shown are kept.
    """
    t = tables()
    drop = gather(t["hidden"], cp)
    if drop.any():
        if len(cp) and cp.max() >= 0xE0000:
            drop = drop | ((cp >= 0xE0000) & (cp < 0xE0080))
        em = gather(t["emoji"], cp)
        at = np.flatnonzero(drop & ((cp == ZWJ) | (cp == VS16)))
        if len(at):
            prev, nxt = np.maximum(at - 1, 0), np.minimum(at + 1, len(cp) - 1)
            drawn = em | (cp == VS16) | (cp == ZWJ) | ((cp >= 0x1F3FB) & (cp <= 0x1F3FF))
            keep = np.where(cp[at] == ZWJ, drawn[prev] & drawn[nxt], em[prev])
            drop[at[keep]] = False
        cp, offs = keep_only(cp, offs, ~drop)
    cp = gather(t["look" if look_alikes else "plain"], cp)
    cr = cp == 0x0D
    if cr.any():
        nxt = np.concatenate([cp[1:], [0]])
        cp = np.where(cr & (nxt != 0x0A), np.uint32(0x0A), cp)
        cp, offs = keep_only(cp, offs, cp != 0x0D)
    cp, offs = compose(cp, offs)
    if look_alikes:  # a composed letter of another script may be a look-alike too
        cp = gather(t["look"], cp)
    return cp, offs


_RNG = np.random.default_rng(20240229)
_CHAR = _RNG.integers(1, 2**63, TABLE, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of all rows: start and end in the code-point array, hash, row, and row offsets."""

    __slots__ = ("start", "end", "hash", "row", "offs")

    def __init__(self, start: np.ndarray, end: np.ndarray, hash_: np.ndarray, row: np.ndarray, offs: np.ndarray):
        self.start, self.end, self.hash, self.row, self.offs = start, end, hash_, row, offs


def words(cp: np.ndarray, offs: np.ndarray, kind: str = "word") -> Words:
    """Runs of letters, digits and marks (kind "letter": of letters) in folded code points; equal words
    have equal hashes."""
    n = len(offs) - 1
    if not len(cp):
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(0, np.uint64), z, np.zeros(n + 1, np.int64))
    w = gather(tables()[kind], cp)
    first = w.copy()
    first[1:] &= ~w[:-1]
    heads = offs[:-1][np.diff(offs) > 0]
    first[heads] = w[heads]
    start = np.flatnonzero(first)
    last = w.copy()
    last[:-1] &= ~w[1:]
    tails = offs[1:][np.diff(offs) > 0] - 1
    last[tails] = w[tails]
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(offs, start, side="right") - 1
    if not len(start):
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(0, np.uint64), z, np.zeros(n + 1, np.int64))
    size = end - start
    at = np.flatnonzero(w)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(at)) - np.repeat(begin, size)
    c = cp[at]
    r = _CHAR[np.minimum(c, TABLE - 1)]
    if c.max() >= TABLE:
        r = np.where(c >= TABLE, mix(c), r)
    h = np.add.reduceat(r * _PLACE[place & 4095], begin)
    counts = np.bincount(row, minlength=n)
    return Words(start, end, mix(h), row, np.concatenate([[0], np.cumsum(counts)]))


def folded(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical code points with case folded; the dotted and dotless i of both alphabets are one."""
    cp, offs = decode(col)
    cp, offs = canonical(cp, offs)
    return gather(tables()["fold"], cp), offs
