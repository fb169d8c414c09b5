"""p6: personal data in free text, found and replaced by typed placeholders.

What reveals a person is estimated from the corpus, by the co-occurrence of terms with protected entities.
A term's disclosure is the share of its occurrences that stand where an entity is for certain, and the
pointwise mutual information of the two.

Names: the terms are the words. Cue phrases mark places where a person is named; words beyond the
thresholds are given names by the cues, surnames by standing next to given names. A given name with a
surname is a name, unless it is part of a street, school, account or e-mail.

E-mail addresses, phone numbers, identity numbers and street addresses: shapes only generate candidates.
The terms of a candidate are its form (which digits are grouped how, which domain, which kind of street)
and the words around it. Candidates that are written in full or stand beside a cue are certain; any other
is generalised only if what its terms disclose reaches the threshold. Counts of terms are kept in a sketch
of fixed size over all texts.

Detection reads a canonical form (full-width, hidden and look-alike characters resolved) with a map
to the text as written; everything outside an item stays as it is. Defined cases: a null text has no
items and stays null; empty and very long texts are read whole; repeated rows are read each.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm import codepoints as C
from triagelake.store import stage

# Phrases that name a person right after or right before them.
BEFORE_NAME = ("haber veren", "adi", "sorumlu kişi", "ilgilenecek kişi", "sn", "sayin", "abim", "ablam", "kardeşim", "en son", "named")
AFTER_NAME = ("isimli", "adli", "araniyor", "bilgilendirildi", "hâlâ içeride", "ile görüşüldü", "olacak", "den haber", "dan haber")
# What follows a person's name when a place or institution is meant.
PLACE_WORDS = frozenset(
    "sokak sokaği sok sk cadde caddesi cad cd bulvar bulvari blv bulv yolu meydani köprüsü parki durağı duraği mahallesi mah mh mahalle "
    "ilkokulu ortaokulu lisesi okulu anaokulu hastanesi üniversitesi fakültesi camii cami vakfi derneği yurdu kursu stadi stadyumu "
    "kütüphanesi merkezi apartmani apt sitesi konutlari işhani pasaji çarşisi tesisleri salonu street avenue road school hospital primary".split()
)
PLACE_LEADS = frozenset("anadolu fen devlet eğitim spor kültür meslek mesleki kiz erkek imam özel şehir aile sağlik toplum primary high".split())
DIGIT_WORDS = "sıfır bir iki üç dört beş altı yedi sekiz dokuz zero one two three four five six seven eight nine".split()
MIN_GIVEN, MIN_PARTNERS, GIVEN_SHARE, GIVEN_BITS, SURNAME_SHARE = 3, 3, 0.15, 3.0, 0.5
MAX_TERMS = 200_000  # names are broadcast up to this number, joined to their texts by word beyond
EVIDENCE, DISCLOSED, STRONG, STRONG_BITS = 20, 0.1, 0.9, 3.0
SKETCH_BITS = 18  # counters of candidates' terms, of fixed size

_AT = r"(?:@|\s?[\(\[]\s?(?:at|et)\s?[\)\]]\s?|\s@\s)"
_DOT = r"(?:\.|\s?[\(\[]\s?(?:nokta|dot)\s?[\)\]]\s?)"
EMAIL = re.compile(rf"(?<![\w+\-])[\w+\-]++(?:\.[\w+\-]++)*+{_AT}[\w\-]+(?:{_DOT}[\w\-]+)+", re.I)
_GAP = r"[ .\-/]?"
PHONE = re.compile(
    r"(?<![\w#+\d])(?<!\d[.\-/ ])(?:"
    rf"(?:\+|00)90{_GAP}\(?0?\d{{3}}\)?{_GAP}\d{{3}}{_GAP}\d{{2}}{_GAP}\d{{2}}"
    rf"|\(?0{_GAP}\(?\d{{3}}\)?{_GAP}\d{{3}}{_GAP}\d{{2}}{_GAP}\d{{2}}"
    rf"|\(?5\d{{2}}\)?{_GAP}\d{{3}}{_GAP}\d{{2}}{_GAP}\d{{2}}"
    r"|(?:\+|00)[1-9]\d{0,2}[ \-]?\(?\d{2,4}\)?(?:[ \-]?\d{2,4}){2,3}"
    r"|(?:\+|00)[1-9]\d{0,2}[ \-]?\d{2,4}[ \-]?\d{6,8}"
    r")(?!\d)(?![.\-/]\d)"
)
_WORD_DIGIT = "(?:" + "|".join(DIGIT_WORDS) + ")"
SPOKEN = re.compile(rf"(?<!\w){_WORD_DIGIT}(?:[\s,\-]+{_WORD_DIGIT}){{9,12}}(?!\w)", re.I)
NOT_PHONE = re.compile(r"(?:takip|kargo|sipari[şs]|barkod|dosya|plaka|fatura|poliçe|iban|tracking|order|barcode|kimlik|tckn|t\.?c\.?|pasaport|passport)\W*(?:no|numaras[ıi]|number|kodu|#)?\W*$", re.I)
_ELEVEN = r"[1-9]\d{2}(?:[ .\-]?\d){8}"
ID_BEFORE = re.compile(rf"(?:t\.?\s?c\.?(?:\s?k\.?\s?n\.?)?|tckn|kimlik)(?:\s*kimlik)?(?:\s*(?:no|numaras[ıi]|numaram|number|num))?\s*[.:=#]*\s*(?<!\d)({_ELEVEN})(?!\d)", re.I)
ID_AFTER = re.compile(rf"(?<![\d\w])({_ELEVEN})(?!\d)\s*(?:nolu\s*|numaral[ıi]\s*)?(?:kimlik|t\.?c\.?\b|tckn)", re.I)
PASSPORT = re.compile(r"(?:pasaport|passport)(?:u|um)?(?:\s*(?:no|numaras[ıi]|number))?\s*[.:=#]*\s*([A-Z]{1,2}\s?\d{6,9})(?!\d)", re.I)
# The words that name a kind of street, in full and short.
STREET_NAMES = ("sokağı", "sokagi", "sokak", "sok", "sk", "caddesi", "cadde", "cad", "cd", "bulvarı", "bulvari", "bulvar", "blv", "bulv")
_STREET = "(?:" + "|".join(STREET_NAMES) + ")"
_HOUSE = r"(?:(?:(?:kap[ıi]\s*)?(?:no|numara|nu)\s*[.:]*\s*\d+(?:\s*/\s*\d+)?)|\d+\s*/\s*\d+|\d+\.?\s*(?:kap[ıi]|blok|bina|apt|apartman)\b(?:\s*(?:no|numara)?\s*[.:]*\s*\d+)?)"
_DETAIL = r"(?:\s*,?\s*(?:kat|k|daire|d|blok|bina|apt|iç\s*kap[ıi]|kap[ıi]|no)\s*[.:]?\s*(?:no\s*[.:]?\s*)?\d+(?:\s*/\s*\d+)?)*"
_NAMEWORD = r"[^\W\d_]+"
ADDRESS = re.compile(
    rf"(?<!\w)(?:(?!(?:ev|adres|adresi)\s){_NAMEWORD}\s+(?:mahallesi|mahalle|mah|mh)\.?,?\s+)?(?:\d+\.|\d+|(?!(?:ev|adres|adresi)\s){_NAMEWORD}\.?(?:\s{_NAMEWORD}\.?)?)\s+{_STREET}(?!\w)\.?\s*,?\s*{_HOUSE}{_DETAIL}", re.I
)
AT_WORD = re.compile(r"[\(\[]\s?(?:at|et)\s?[\)\]]", re.I)
HANDLE = re.compile(r"[@#][\w.]+|https?://\S+|\w*_\w*")
TOKEN = re.compile(r"[^\W\d_]+")


def canonical_map(text: str) -> tuple[str, list[int] | None]:
    """The canonical form, and where each of its characters begins in the text (null: at the same place)."""
    if text.isascii():
        return text, None
    t = C.tables()
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    look, hidden = C.gather(t["look"], cp), C.gather(t["hidden"], cp)
    marks = C.gather(t["ccc"], cp) > 0
    if not hidden.any() and not marks.any():
        return look.tobytes().decode("utf-32-le"), None
    out: list[str] = []
    at: list[int] = []
    for i, c in enumerate(look.tolist()):
        if hidden[i]:
            continue
        if marks[i] and out and len(two := unicodedata.normalize("NFC", out[-1] + chr(c))) == 1:
            out[-1] = two
            continue
        out.append(chr(c))
        at.append(i)
    at.append(len(text))
    return "".join(out), at


class Canonical:
    """The canonical forms of a batch, all mapped at once; texts with hidden characters or marks are
    mapped on their own when they are asked for."""

    def __init__(self, texts: pa.Array):
        t = C.tables()
        self.texts = texts
        cp, self.offs = C.decode(texts)
        touchy = C.gather(t["hidden"], cp) | (C.gather(t["ccc"], cp) > 0)
        self.touchy = np.bincount(C.row_of(self.offs)[touchy], minlength=len(texts)) > 0
        self.whole = C.gather(t["look"], cp).astype("<u4").tobytes().decode("utf-32-le", "replace")

    def __getitem__(self, i: int) -> tuple[str, list[int] | None]:
        if self.touchy[i]:
            return canonical_map(self.texts[i].as_py())
        return self.whole[self.offs[i] : self.offs[i + 1]], None


def fold(word: str) -> str:
    return word.replace("İ", "i").replace("I", "i").lower().replace("ı", "i").replace("i̇", "i")


def _tokens(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), fold(m[0])) for m in TOKEN.finditer(text)]


_CUE_BEFORE = {tuple(x.split()) for x in BEFORE_NAME}
_CUE_AFTER = {tuple(x.split()) for x in AFTER_NAME}


def _cue_hashes(phrases: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the cues of one word, and of those of two words."""
    w = C.words(*C.folded(pa.array(list(phrases))), "letter")
    n = np.diff(w.offs)
    one, two = w.offs[:-1][n == 1], w.offs[:-1][n == 2]
    return w.hash[one], _two(w.hash[two], w.hash[two + 1])


def _two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return C.mix(a * np.uint64(3) + b)


def _ascii(chars: str) -> np.ndarray:
    out = np.zeros(128, bool)
    out[[ord(x) for x in chars]] = True
    return out


_LOOSE, _SIGN, _BETWEEN = _ascii(" .'-_"), _ascii("@(["), _ascii(" .-/()+")


class Tokens:
    """Words of letters of a batch of texts, in the canonical folded form."""

    def __init__(self, texts: pa.Array):
        self.cp, self.offs = C.folded(texts)
        self.w = C.words(self.cp, self.offs, "letter")
        self.size = self.w.end - self.w.start
        gap = ~_LOOSE[np.minimum(self.cp, 127)]
        self.other = np.concatenate([[0], np.cumsum(gap)])
        self.chars = np.append(self.cp, [0, 0]).astype(np.uint32)

    def space(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether just a space lies between words i and j."""
        return (self.w.start[j] - self.w.end[i] == 1) & (self.chars[self.w.end[i]] == 32)

    def comma(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether just a comma and a space lie between words i and j."""
        return (self.w.start[j] - self.w.end[i] == 2) & (self.chars[self.w.end[i]] == 44) & (self.chars[self.w.end[i] + 1] == 32)

    def loose(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether just spaces, points, hyphens and the like lie between words i and j."""
        return self.other[self.w.start[j]] == self.other[self.w.end[i]]

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether word j, which may be out of range, is in the text of word i."""
        n = len(self.w.row)
        return (j >= 0) & (j < n) & (self.w.row[np.clip(j, 0, max(n - 1, 0))] == self.w.row[i])

    def text(self, i: np.ndarray) -> list[str]:
        s = self.cp.astype("<u4").tobytes().decode("utf-32-le", "replace")
        return [s[a:b] for a, b in zip(self.w.start[i].tolist(), self.w.end[i].tolist())]


def cue_places(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (given, surname) that cue phrases mark as a person's."""
    h, n = t.w.hash, len(t.w.hash)
    at = np.arange(n)
    one, two = _cue_hashes(BEFORE_NAME)
    prev = np.roll(h, 1)
    cue = np.isin(h, one) | (t.same(at, at - 1) & np.isin(_two(prev, h), two))
    i = at[cue]
    i = i[t.same(i, i + 2)]
    comma, space = t.comma(i + 1, i + 2), t.space(i + 1, i + 2)
    k = i + 2
    further = t.same(i, i + 3)
    k = np.where(space & (t.size[k] == 1) & further, k + 1, k)
    pairs = [(i[comma] + 2, i[comma] + 1), (i[space] + 1, k[space])]
    one, two = _cue_hashes(AFTER_NAME)
    nxt = np.roll(h, -1)
    cue = np.isin(h, one) | (t.same(at, at + 1) & np.isin(_two(h, nxt), two))
    i = at[cue]
    i = i[t.same(i, i - 2)]
    k = i - 2
    comma, single, space = t.comma(k, i - 1), t.size[k] == 1, t.space(k, i - 1)
    pairs.append((i[comma] - 1, k[comma]))
    with_initial = ~comma & single & t.same(i, k - 1)
    pairs.append((k[with_initial] - 1, i[with_initial] - 1))
    plain = ~comma & ~with_initial & space
    pairs.append((k[plain], i[plain] - 1))
    return np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])


def given_places(t: Tokens, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (word, given name) of words that stand next to a given name (a mask over the words)."""
    at = np.flatnonzero(~given)
    n = len(given)
    is_given = lambda j: given[np.clip(j, 0, max(n - 1, 0))]
    prev = t.same(at, at - 1)
    p = np.maximum(at - 1, 0)
    near = prev & t.loose(p, at) & (is_given(p) | ((t.size[p] == 1) & t.same(at, at - 2) & is_given(at - 2)))
    q = np.minimum(at + 1, max(n - 1, 0))
    swap = ~near & t.same(at, at + 1) & is_given(q) & t.comma(at, q)
    return np.concatenate([at[near], at[swap]]), np.concatenate([p[near], q[swap]])


def _counted(t: Tokens, word: np.ndarray, partner: np.ndarray) -> dict[str, np.ndarray]:
    """Places by word and partner: hash, text and partner's hash of each, and how often."""
    key, first, slots = np.unique(np.stack([t.w.hash[word], t.w.hash[partner]]), axis=1, return_index=True, return_counts=True)
    return {"hash": key[0].view(np.int64), "word": t.text(word[first]), "partner": key[1].view(np.int64), "slots": slots}


def _overlaps(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    return any(x < b and a < y for x, y in spans)


class Candidate:
    """A span that may be an item of a kind: whether it is certain, whether its shape is complete, its terms."""

    __slots__ = ("a", "e", "kind", "certain", "shaped", "terms")

    def __init__(self, a: int, e: int, kind: str, certain: bool, shaped: bool, terms: list[str]):
        self.a, self.e, self.kind, self.certain, self.shaped, self.terms = a, e, kind, certain, shaped, terms


# Words that say of the number beside them that it is a phone's.
PHONE_CUES = re.compile(r"(?:tel|telefon\w*|gsm|cep|ara\w*|ileti[şs]im|whatsapp|phone|call|numara\w*)\W*$", re.I)
STREET_WORD = re.compile(_STREET, re.I)
HOUSE_WORD = re.compile(r"(?:no|numara|nu|kap[ıi]|blok|bina|apt|apartman|daire|kat)\b", re.I)
BARE_ID = re.compile(rf"(?<![\d\w.\-/+])({_ELEVEN})(?!\d)(?![.\-/]\d)")


def _around(text: str, a: int, e: int) -> list[str]:
    """The word before and the word after a span, as terms."""
    before, after = TOKEN.findall(text[max(0, a - 24) : a]), TOKEN.search(text, e, e + 16)
    return [*(f"<{fold(w)}" for w in before[-1:]), *([f">{fold(after[0])}"] if after else [])]


def _form(text: str) -> str:
    """How digits are grouped, with the leading digit kept."""
    return text[:2] + "".join("d" if x.isdigit() else x for x in text[2:])


def candidates(text: str, at_sign: bool = True, digits: bool = True, spoken: bool = True, street: bool = True) -> list[Candidate]:
    """Spans of structured kinds, none overlapping another; the flags leave out what cannot be there."""
    out: list[Candidate] = []
    left = text

    def take(a: int, b: int, kind: str, certain: bool, shaped: bool, terms: list[str]) -> None:
        nonlocal left
        if not _overlaps([(c.a, c.e) for c in out], a, b):
            out.append(Candidate(a, b, kind, certain, shaped, terms))
            left = left[:a] + "\0" * (b - a) + left[b:]  # so that an item right after another is still seen

    if at_sign and ("@" in text or AT_WORD.search(text)):
        for m in EMAIL.finditer(text):
            domain = fold(re.split(_AT, m[0])[-1])
            take(m.start(), m.end(), "email", re.fullmatch(r"[^\s@()\[\]]+@[^\s@()\[\]]+", m[0]) is not None, True, ["@" + domain, "@" + re.split(_DOT, domain)[-1]])
    if digits:
        for rx in (ID_BEFORE, ID_AFTER, PASSPORT):
            for m in rx.finditer(text):
                take(m.start(1), m.end(1), "id_number", True, True, [_form(m[1]), *_around(text, m.start(1), m.end(1))])
    if street:
        for m in ADDRESS.finditer(left):
            take(m.start(), m.end(), "address", HOUSE_WORD.search(m[0]) is not None, True, [fold(x) for x in STREET_WORD.findall(m[0])[-1:]])
    if digits:
        for m in PHONE.finditer(left):
            if not NOT_PHONE.search(left, max(0, m.start() - 30), m.start()):
                sure = m[0].startswith(("+", "00", "0", "(0")) or PHONE_CUES.search(left, max(0, m.start() - 16), m.start()) is not None
                take(m.start(), m.end(), "phone", sure, True, [_form(m[0]), *_around(text, m.start(), m.end())])
        for m in BARE_ID.finditer(left):
            take(m.start(1), m.end(1), "id_number", False, False, _around(text, m.start(1), m.end(1)))
    if spoken:
        for m in SPOKEN.finditer(text):
            take(m.start(), m.end(), "phone", True, True, _around(text, m.start(), m.end()))
    return out


def term_hashes(terms: list[str]) -> np.ndarray:
    """Hashes of terms, each read whole."""
    cp, offs = C.decode(pa.array(terms, pa.string()))
    place = np.arange(len(cp)) - np.repeat(offs[:-1], np.diff(offs))
    part = C.mix(cp.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(24)))
    out = np.zeros(len(terms), np.uint64)
    full = np.diff(offs) > 0
    if full.any():
        out[full] = np.add.reduceat(part, offs[:-1][full])
    return C.mix(out)


class Disclosure:
    """Counts of the candidates' terms: how often each occurs, and how often at a certain candidate."""

    def __init__(self, at: np.ndarray, n: np.ndarray, certain: np.ndarray):
        self.n, self.certain = np.zeros(1 << SKETCH_BITS, np.int64), np.zeros(1 << SKETCH_BITS, np.int64)
        self.n[at], self.certain[at] = n, certain
        self.base = certain.sum() / max(1, n.sum())

    def accepts(self, certain: bool, shaped: bool, terms: np.ndarray) -> bool:
        """Whether a candidate is generalised. A candidate whose shape is complete is, unless terms seen
        often enough disclose next to nothing; a bare one needs a term that discloses strongly."""
        if certain:
            return True
        n = self.n[terms]
        known = n >= EVIDENCE
        share = self.certain[terms][known] / n[known]
        if shaped:
            return not len(share) or share.max() >= DISCLOSED
        return bool(len(share)) and share.max() >= STRONG and np.log2(max(share.max(), 1e-9) / max(self.base, 1e-9)) >= STRONG_BITS


def find_items(text: str, given: frozenset[str], surnames: frozenset[str], taken: list[tuple[int, int, str]] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in text, in order; no two overlap. `taken` are the structured items; if they are
    not given, every candidate of a complete shape is one."""
    if taken is None:
        taken = [(c.a, c.e, c.kind) for c in candidates(text) if c.shaped]
    out = list(taken)
    spans = [(a, b) for a, b, _ in out]
    if not given:
        return sorted(out)

    def take(a: int, b: int, kind: str) -> None:
        if not _overlaps(spans, a, b):
            spans.append((a, b))
            out.append((a, b, kind))

    handles = [m.span() for m in HANDLE.finditer(text)]
    toks = _tokens(text)
    i = 0
    while i < len(toks):
        a, e, w = toks[i]
        if w in given:
            j = i + 1
            while j < len(toks) and _joins(text, toks, j) and (toks[j][2] in given or len(toks[j][2]) == 1):
                j += 1
            if j < len(toks) and _joins(text, toks, j) and (toks[j][2] in surnames or _cued(text, toks, i, j)):
                if not _place_follows(toks, j, text) and not _overlaps(handles, a, toks[j][1]):
                    take(a, toks[j][1], "name")
                i = j + 1
                continue
        elif w in surnames and i + 1 < len(toks) and toks[i + 1][2] in given and text[e : toks[i + 1][0]] == ", ":
            # "Surname, Given", unless the given name opens a name of its own
            own = i + 2 < len(toks) and toks[i + 2][2] in surnames and _joins(text, toks, i + 2)
            if not own and not _overlaps(handles, a, toks[i + 1][1]):
                take(a, toks[i + 1][1], "name")
                i += 2
                continue
        i += 1
    return sorted(out)


def _cued(text: str, toks: list[tuple[int, int, str]], i: int, j: int) -> bool:
    """Whether cue phrases stand before word i or right after word j: then a rare surname is one, too."""
    words = [w for _, _, w in toks[max(0, i - 2) : j + 3]]
    k, n = i - max(0, i - 2), j - max(0, i - 2) + 1
    before = k and ((words[k - 1],) in _CUE_BEFORE or (k > 1 and (words[k - 2], words[k - 1]) in _CUE_BEFORE))
    after = n < len(words) and ((words[n],) in _CUE_AFTER or (n + 1 < len(words) and (words[n], words[n + 1]) in _CUE_AFTER))
    return len(toks[j][2]) > 2 and bool(before or after)


def _joins(text: str, toks: list[tuple[int, int, str]], j: int) -> bool:
    gap = text[toks[j - 1][1] : toks[j][0]]
    return gap.strip() == "" and 0 < len(gap) < 4 and "\n" not in gap or (gap.strip() == "." and len(toks[j - 1][2]) == 1)


def _place_follows(toks: list[tuple[int, int, str]], j: int, text: str) -> bool:
    for k in (1, 2, 3):
        if j + k >= len(toks) or text[toks[j + k - 1][1] : toks[j + k][0]].strip() not in ("",):
            return False
        w = toks[j + k][2]
        if w in PLACE_WORDS:
            return True
        if w not in PLACE_LEADS:
            return False
    return False


def mask(text: str, items: list[tuple[int, int, str]], at: list[int] | None) -> str:
    """The text with each item replaced by its placeholder; items are placed in the canonical form."""
    out, done = [], 0
    for a, b, kind in items:
        x, y = (a, b) if at is None else (at[a], at[b])
        out += [text[done:x], f"<{kind.upper()}>"]
        done = y
    return "".join(out) + text[done:]


READ = (
    "ord bigint, field_name string, text string, cands array<struct<a:int,e:int,kind:string,certain:boolean,shaped:boolean,terms:array<int>>>, "
    "hash bigint, word string, partner bigint, n bigint, slots bigint"
)
_TERMS = pa.list_(pa.int32())
_CAND = pa.list_(pa.struct([("a", pa.int32()), ("e", pa.int32()), ("kind", pa.string()), ("certain", pa.bool_()), ("shaped", pa.bool_()), ("terms", _TERMS)]))
_READ = pa.schema([
    ("ord", pa.int64()), ("field_name", pa.string()), ("text", pa.string()), ("cands", _CAND),
    ("hash", pa.int64()), ("word", pa.string()), ("partner", pa.int64()), ("n", pa.int64()), ("slots", pa.int64()),
])


def _rows(n: int, cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _READ], schema=_READ)


# How the word for a passport may be written, with what may follow it without a space.
PASSPORT_WORDS = [a + b + c for a in ("pasaport", "passport") for b in ("", "u", "um") for c in ("", "no", "numarası", "numarasi", "number")]


def _hashes(words: list[str]) -> np.ndarray:
    return C.words(*C.folded(pa.array(words)), "letter").hash


def _flags(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text, what it may hold: an e-mail (an @ or a bracket), a number of ten digits or a passport's, ten
    spoken digits, a street with a number."""
    row = C.row_of(t.offs)
    has = lambda r: np.bincount(r, minlength=n) > 0
    signs = has(row[_SIGN[np.minimum(t.cp, 127)]])
    digit = C.gather(C.tables()["digit"], t.cp)
    between = _BETWEEN[np.minimum(t.cp, 127)]
    at = np.flatnonzero(digit)
    run = (np.cumsum(~digit & ~between) + row)[at]  # broken by what separates no digits, and by a text's end
    ends = np.flatnonzero(np.append(run[1:] != run[:-1], True)) if len(at) else at
    numbers = has(row[at[ends[np.diff(ends, prepend=-1) >= 10]]])
    digits = has(row[at])
    names = lambda words: has(t.w.row[np.isin(t.w.hash, _hashes(words))])
    said = np.bincount(t.w.row[np.isin(t.w.hash, _hashes(DIGIT_WORDS))], minlength=n) >= 10
    return signs, numbers | (digits & names(PASSPORT_WORDS)), said, digits & names(list(STREET_NAMES))


def _summed(word: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Each word once, with the sum of its counts."""
    key, at = np.unique(word, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, at, n)
    return [key, total]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text with its candidates, and the counts of words and of the places where cues name a person."""
    words = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    for b in batches:
        for at in range(0, b.num_rows, 4000):
            part = b.slice(at, 4000)
            t = Tokens(part.column(2))
            signs, digits, spoken, street = _flags(t, part.num_rows)
            texts = part.column(2)
            canon = Canonical(texts)
            found: list[list[Candidate]] = [[] for _ in range(part.num_rows)]
            for i in np.flatnonzero(signs | digits | spoken | street).tolist():
                found[i] = candidates(canon[i][0], bool(signs[i]), bool(digits[i]), bool(spoken[i]), bool(street[i]))
            flat = [c for x in found for c in x]
            hashes = (term_hashes([c.kind + y for c in flat for y in c.terms]) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int32)
            offs = np.concatenate([[0], np.cumsum([len(c.terms) for c in flat])]).astype(np.int32)
            struct = pa.StructArray.from_arrays(
                [
                    pa.array([c.a for c in flat], pa.int32()), pa.array([c.e for c in flat], pa.int32()), pa.array([c.kind for c in flat], pa.string()),
                    pa.array([c.certain for c in flat], pa.bool_()), pa.array([c.shaped for c in flat], pa.bool_()), pa.ListArray.from_arrays(pa.array(offs), pa.array(hashes)),
                ],
                fields=list(_CAND.value_type),
            )
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            cands = pa.ListArray.from_arrays(pa.array(ends), struct).cast(_CAND)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts, cands, *(pa.nulls(part.num_rows, f.type) for f in list(_READ)[4:])], schema=_READ)
            if len(t.w.hash):
                word, n = np.unique(t.w.hash, return_counts=True)
                words = [np.concatenate([words[0], word]), np.concatenate([words[1], n])]
                if len(words[0]) > 1 << 20:
                    words = _summed(*words)
                if len(words[0]) > 1 << 19:
                    yield _rows(len(words[0]), {"hash": words[0].view(np.int64), "n": words[1]})
                    words = [words[0][:0], words[1][:0]]
                places = _counted(t, *cue_places(t))
                if len(places["hash"]):
                    yield _rows(len(places["hash"]), places)
    word, n = _summed(*words)
    yield _rows(len(word), {"hash": word.view(np.int64), "n": n})


def _disclosed(counts: DataFrame, places: DataFrame) -> DataFrame:
    """(hash, word, n, slots, partners, share, bits): how strongly each word reveals a named person.

    share is the part of its occurrences that stand where a person is named, bits the pointwise mutual
    information of the word with those places, partners the number of different words it stands beside
    there: a given name has many surnames, a stock phrase one continuation.
    """
    by = places.groupBy("hash", "partner").agg(F.min("word").alias("word"), F.sum("slots").alias("slots"))
    by = by.groupBy("hash").agg(F.min("word").alias("word"), F.sum("slots").alias("slots"), F.count("partner").alias("partners"))
    both = stage(by.join(counts, "hash"), "disclosure")
    n, slots = counts.agg(F.sum("n")).first()[0], both.agg(F.sum("slots")).first()[0]
    return both.withColumn("share", F.col("slots") / F.col("n")).withColumn("bits", F.log2(F.col("slots") / (slots or 1) / (F.col("n") / (n or 1))))


class Terms:
    """Given names and surnames: broadcast while they are at most MAX_TERMS, else joined to their texts."""

    def __init__(self, terms: DataFrame):
        self.terms = stage(terms.select("hash", "word"), "terms")
        self.held = None
        if self.terms.limit(MAX_TERMS + 1).count() <= MAX_TERMS:
            got = self.terms.toArrow()
            self.held = terms.sparkSession.sparkContext.broadcast((np.sort(got.column("hash").to_numpy().view(np.uint64)), frozenset(got.column("word").to_pylist())))

    def of_texts(self, texts: DataFrame, name: str) -> DataFrame:
        """texts with the terms each holds, as array<struct<hash, word>>; null where they are broadcast.
        Texts are known by their digest, so equal texts are looked up once."""
        if self.held is not None:
            return texts.withColumn(name, F.lit(None).cast("array<struct<hash:bigint,word:string>>"))

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t = Tokens(b.column(1))
                pair = np.unique(np.stack([t.w.row.astype(np.uint64), t.w.hash]), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pair[0].astype(np.int64))), pa.array(pair[1].view(np.int64))], ["key", "hash"])

        keyed = texts.withColumn("key", F.md5("text"))
        words = keyed.select("key", "text").distinct().mapInArrow(split, "key string, hash bigint")
        mine = words.join(self.terms, "hash").groupBy("key").agg(F.collect_set(F.struct("hash", "word")).alias(name))
        return keyed.join(mine, "key", "left").withColumn(name, F.coalesce(name, F.array().cast("array<struct<hash:bigint,word:string>>"))).drop("key")

    @staticmethod
    def of_batch(held, lists: pa.Array, t: Tokens) -> tuple[np.ndarray, list[frozenset[str]] | frozenset[str]]:
        """(mask over the words, the terms as text): those broadcast, or those of each text."""
        if held is not None:
            return np.isin(t.w.hash, held.value[0]), held.value[1]
        rows = lists.to_pylist()
        own = [np.array([x["hash"] for x in r or []], np.int64).view(np.uint64) for r in rows]
        key = C.mix(np.concatenate([C.mix(h) + np.uint64(i) for i, h in enumerate(own)])) if own else np.zeros(0, np.uint64)
        return np.isin(C.mix(C.mix(t.w.hash) + t.w.row.astype(np.uint64)), key), [frozenset(x["word"] for x in r or []) for r in rows]


def name_terms(read: DataFrame) -> tuple[Terms, Terms]:
    """(given names, surnames): words whose disclosure exceeds the thresholds."""
    counts = stage(read.filter("n IS NOT NULL").groupBy("hash").agg(F.sum("n").alias("n")), "words")
    cued = _disclosed(counts, read.filter("slots IS NOT NULL").select("hash", "word", "partner", "slots"))
    given = Terms(cued.filter((F.col("slots") >= MIN_GIVEN) & (F.col("partners") >= MIN_PARTNERS) & (F.col("share") >= GIVEN_SHARE) & (F.col("bits") >= GIVEN_BITS) & (F.length("word") > 1)))
    held = given.held

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                part = b.slice(at, 4000)
                t = Tokens(part.column(0))
                if len(t.w.hash):
                    got = _counted(t, *given_places(t, Terms.of_batch(held, part.column(1), t)[0]))
                    yield pa.RecordBatch.from_arrays([pa.array(got["hash"]), pa.array(got["word"], pa.string()), pa.array(got["partner"]), pa.array(got["slots"])], ["hash", "word", "partner", "slots"])

    texts = given.of_texts(read.filter("text IS NOT NULL").select("text"), "given")
    places = texts.mapInArrow(near, "hash bigint, word string, partner bigint, slots bigint")
    return given, Terms(_disclosed(counts, places).filter((F.col("share") >= SURNAME_SHARE) & (F.length("word") > 2)))


def term_disclosure(read: DataFrame) -> Disclosure:
    """The sketch of the candidates' terms, summed over all texts; its size is fixed."""
    one = read.filter(F.size("cands") > 0).select(F.explode("cands").alias("c")).select("c.certain", F.explode("c.terms").alias("at"))
    got = one.groupBy("at").agg(F.count("*").alias("n"), F.count_if("certain").alias("certain")).toArrow()
    return Disclosure(got.column("at").to_numpy(), got.column("n").to_numpy(), got.column("certain").to_numpy())


def personal_data(rows: DataFrame, ord_: str, fields: list[str], texts_too: bool = True) -> DataFrame:
    """(ord, field_name, text, masked, items array<struct<kind, nth, item>>) for every row and field; without
    `texts_too` the texts and masked texts are left out."""
    parts = [rows.select(F.col(ord_).cast("bigint").alias("ord"), F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text")) for f in fields]
    texts = parts[0]
    for p in parts[1:]:
        texts = texts.unionByName(p)
    read = stage(texts.mapInArrow(_read, READ), "read")
    given, surnames = name_terms(read)
    kinds = "array<struct<kind:string,nth:bigint,item:string>>"
    held = rows.sparkSession.sparkContext.broadcast(term_disclosure(read))
    first, second = given.held, surnames.held

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                yield _masked(b.slice(at, 4000), held.value, first, second, texts_too)

    read = read.filter("field_name IS NOT NULL").select("ord", "field_name", "text", "cands")
    read = surnames.of_texts(given.of_texts(read, "given"), "surnames")
    shown = "text string, masked string, " if texts_too else ""
    return read.mapInArrow(scan, f"ord bigint, field_name string, {shown}items {kinds}")


_KIND = pa.list_(pa.struct([("kind", pa.string()), ("nth", pa.int64()), ("item", pa.string())]))


def _masked(b: pa.RecordBatch, told: Disclosure, first, second, texts_too: bool) -> pa.RecordBatch:
    """The texts of a batch with their items; only texts with a candidate or a given name are looked into."""
    texts = b.column(2)
    t = Tokens(texts)
    is_given, given = Terms.of_batch(first, b.column(4), t)
    surnames = second.value[1] if second is not None else [frozenset(x["word"] for x in r or []) for r in b.column(5).to_pylist()]
    named = np.bincount(t.w.row[is_given], minlength=b.num_rows) > 0
    cands = b.column(3)
    some = np.diff(np.asarray(cands.offsets)) > 0
    items: list[list[dict]] = [[] for _ in range(b.num_rows)]
    masked = texts.to_pylist()
    forms, told_of = Canonical(texts), cands.to_pylist()
    for i in np.flatnonzero(named | some).tolist():
        text = masked[i]
        canon, at = forms[i]
        got = told_of[i]
        taken = [(c["a"], c["e"], c["kind"]) for c in got if told.accepts(c["certain"], c["shaped"], np.array(c["terms"], np.int64))]
        mine = (given if isinstance(given, frozenset) else given[i]) if named[i] else frozenset()
        found = find_items(canon, mine, surnames if isinstance(surnames, frozenset) else surnames[i], taken)
        seen: dict[str, int] = defaultdict(int)
        for a, e, kind in found:
            seen[kind] += 1
            items[i].append({"kind": kind, "nth": seen[kind], "item": canon[a:e]})
        if texts_too:
            masked[i] = mask(text, found, at)
    if not texts_too:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(items, _KIND)], ["ord", "field_name", "items"])
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts, pa.array(masked, pa.string()), pa.array(items, _KIND)], ["ord", "field_name", "text", "masked", "items"])
