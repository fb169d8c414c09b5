"""p10: the reading level of documents, by gradient-boosted regression trees.

Every document gives distributions of its text: lengths of words and sentences, richness and rarity
of its vocabulary, marks of syntax, and cohesion from sentence to sentence. Rarity is measured
against counts over all documents. Grades of a bounded sample of labelled documents (MAX_TRAINING)
train the trees; words also carry the mean grade of the labelled documents they occur in, computed out of fold for
the training rows. Predictions are cross-validated with whole sources held out and calibrated on
those held-out predictions; what is reported for a fold is calibrated on the other folds. The folds
and the final trees are trained in parallel tasks on features binned once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm import codepoints as C

MAX_TRAINING = 20_000  # labelled documents in the training sample; the bound of what the driver holds
SKETCH_BITS = 18  # counters of the corpus frequency sketch, of fixed size
FOLDS = 5
PRIOR = 3.0  # pseudo-count of the overall mean in a word's grade


def _quantiles(row: np.ndarray, value: np.ndarray, n: int, qs: tuple[float, ...]) -> list[np.ndarray]:
    """Quantiles of the values of each row; values are not negative, so their bits sort as they do."""
    bits = value.astype(np.float32).view(np.uint32).astype(np.uint64)
    v = (np.sort(row.astype(np.uint64) << np.uint64(32) | bits) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.float32)
    size = np.bincount(row, minlength=n)
    begin = np.cumsum(size) - size
    out = []
    for q in qs:
        at = begin + np.maximum(0, np.ceil(q * size).astype(np.int64) - 1)
        out.append(np.where(size > 0, v[np.minimum(at, len(v) - 1)] if len(v) else 0.0, 0.0))
    return out


# The marks whose frequency is a feature, class by class, and those that end a sentence.
MARKS = (",", ";:", "()[]", "!?", ".", "\n", "<>", "-–—")
STOPS = ".!?…;\n"


def _mark_classes() -> np.ndarray:
    out = np.zeros(C.TABLE, np.uint8)
    for k, marks in enumerate(MARKS):
        for x in marks:
            out[ord(x)] = k + 1
    return out


_CLASS = _mark_classes()
_STOP = np.zeros(C.TABLE, bool)
_STOP[[ord(x) for x in STOPS]] = True


class Text:
    """Words of a batch of texts with what the features need."""

    def __init__(self, col: pa.Array):
        raw, offs = C.decode(col)
        cp, offs = C.canonical(raw, offs)
        low = C.gather(C.tables()["fold"], cp)
        self.n = len(offs) - 1
        self.w = C.words(low, offs)
        self.cp, self.offs = cp, offs
        size = (self.w.end - self.w.start).astype(np.float64)
        stop = C.gather(_STOP, cp)
        self.sentence = np.concatenate([[0], np.cumsum(stop)])[self.w.start] if len(cp) else np.zeros(0, np.int64)
        self.size = size


def features(t: Text, sketch: np.ndarray, total: float) -> np.ndarray:
    """One row of distributions per text; texts without words have zeros."""
    w, n, row = t.w, t.n, t.w.row
    count = np.maximum(1, np.diff(w.offs)).astype(np.float64)
    mean = lambda v: np.bincount(row, weights=v, minlength=n) / count
    cols: list[np.ndarray] = [np.log1p(np.diff(w.offs)), np.log1p(np.diff(t.offs))]
    m = mean(t.size)
    cols += [m, np.sqrt(np.maximum(0, mean(t.size**2) - m**2)), mean(t.size >= 7), mean(t.size >= 10), mean(t.size >= 13), mean(t.size <= 3)]
    cols += _quantiles(row, t.size, n, (0.25, 0.5, 0.75, 0.9, 1.0))
    # sentences
    sid = t.sentence
    new = np.ones(len(row), bool)
    if len(row) > 1:
        new[1:] = (sid[1:] != sid[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    srow = row[at]
    ssize = np.diff(np.append(at, len(row))).astype(np.float64)
    snum = np.maximum(1, np.bincount(srow, minlength=n)).astype(np.float64)
    smean = np.bincount(srow, weights=ssize, minlength=n) / snum
    cols += [np.log1p(snum), smean, np.sqrt(np.maximum(0, np.bincount(srow, weights=ssize**2, minlength=n) / snum - smean**2))]
    cols += _quantiles(srow, ssize, n, (0.25, 0.5, 0.75, 1.0))
    # vocabulary: one order of (row, word), in which a word's occurrences keep their order
    key = row.astype(np.uint64) << np.uint64(44) | w.hash >> np.uint64(20)
    order = np.argsort(key, kind="stable")
    k, rr = key[order], row[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    kinds = np.bincount(rr[first], minlength=n)
    cols += [kinds / count, kinds / np.sqrt(count)]
    df = sketch[(w.hash & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
    rare = -np.log((df + 1.0) / (total + 1.0))
    cols += [mean(rare), *_quantiles(row, rare, n, (0.5, 0.75, 0.9))]
    # syntax and cohesion
    chars = np.maximum(1, np.diff(t.offs)).astype(np.float64)
    crow = C.row_of(t.offs)
    marked = C.gather(_CLASS, t.cp)
    at = np.flatnonzero(marked)
    per = np.bincount(crow[at] * (len(MARKS) + 1) + marked[at], minlength=n * (len(MARKS) + 1)).reshape(n, -1)
    cols += [per[:, i + 1] / count for i in range(len(MARKS))]
    cols.append(np.bincount(crow[C.gather(C.tables()["digit"], t.cp)], minlength=n) / chars)
    cols.append(np.bincount(crow[C.gather(C.tables()["upper"], t.cp)], minlength=n) / chars)
    sk = t.sentence[order]  # a word seen before, in the sentence before its own or the same
    again = np.zeros(len(k), np.float64)
    again[1:] = ~first[1:] & (sk[1:] - sk[:-1] <= 1)
    cols.append(np.bincount(rr, weights=again, minlength=n) / count)
    return np.stack(cols, axis=1).astype(np.float32)


def grade_features(row: np.ndarray, grade: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Mean, spread and quantiles of the words' grades of each text; words without one (nan) are left out."""
    n = len(words)
    ok = ~np.isnan(grade)
    row, g = row[ok], grade[ok]
    count = np.bincount(row, minlength=n).astype(np.float64)
    safe = np.maximum(1, count)
    m = np.bincount(row, weights=g, minlength=n) / safe
    spread = np.sqrt(np.maximum(0, np.bincount(row, weights=g * g, minlength=n) / safe - m**2))
    known = count / np.maximum(1, words)
    return np.stack([m, spread, known, *_quantiles(row, g, n, (0.1, 0.5, 0.8, 0.95))], axis=1).astype(np.float32)


class Sample:
    """The training documents: features, grades, folds, and every word occurrence by its number."""

    def __init__(self, x: np.ndarray, y: np.ndarray, source: np.ndarray, row: np.ndarray, hashes: np.ndarray):
        self.x, self.y, self.source, self.row = x, y, source, row
        self.words, self.word = np.unique(hashes, return_inverse=True)
        self.size = np.bincount(row, minlength=len(y))
        pair = np.unique(self.word * max(1, len(y)) + row)
        self.pair_word, self.pair_row = pair // max(1, len(y)), pair % max(1, len(y))
        rows = np.arange(len(y))
        self.fold = np.unique(source, return_inverse=True)[1] % FOLDS if len(set(source)) >= FOLDS else rows % FOLDS
        self.inner = (C.mix(rows.astype(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
        self.edges = Boosted.edges_of(x)
        self.binned = Boosted.binned(x, self.edges)

    def word_grades(self, train: np.ndarray) -> np.ndarray:
        """Smoothed mean grade of the documents of `train` (a mask) each word occurs in; nan below two of them."""
        use = train[self.pair_row]
        w = self.pair_word[use]
        n = np.bincount(w, minlength=len(self.words))
        total = np.bincount(w, weights=self.y[self.pair_row[use]], minlength=len(self.words))
        mean = self.y[train].mean() if train.any() else 0.0
        return np.where(n >= 2, (total + PRIOR * mean) / (n + PRIOR), np.nan)

    def graded(self, rows: np.ndarray, grades: np.ndarray) -> np.ndarray:
        """Grade features of the documents of `rows` (a mask)."""
        use = rows[self.row]
        place = np.cumsum(rows) - 1
        return grade_features(place[self.row[use]], grades[self.word[use]], self.size[rows])

    def fit(self, train: np.ndarray) -> Boosted:
        """Trees for the documents of `train`, whose word grades come from the other inner folds."""
        coded = np.zeros((len(self.y), 7), np.float32)
        for k in range(FOLDS):
            mine = train & (self.inner == k)
            coded[mine] = self.graded(mine, self.word_grades(train & (self.inner != k)))
        edges = self.edges + Boosted.edges_of(coded[train])
        binned = np.hstack([self.binned[train], Boosted.binned(coded[train], edges[self.x.shape[1] :])])
        return Boosted(edges).fit(binned, self.y[train])

    def held_out(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, predictions) of fold k by trees of the other folds."""
        train, test = self.fold != k, self.fold == k
        if train.sum() < 20 or not test.any():
            return np.flatnonzero(test), np.full(test.sum(), self.y.mean())
        x = np.hstack([self.x[test], self.graded(test, self.word_grades(train))])
        return np.flatnonzero(test), self.fit(train).predict(x)


class Boosted:
    """Gradient-boosted regression trees on binned features, squared error."""

    bins = 64

    def __init__(self, edges: list[np.ndarray], trees: int = 120, depth: int = 4, rate: float = 0.1, leaf: int = 5):
        self.edges, self.trees, self.depth, self.rate, self.leaf = edges, trees, depth, rate, leaf

    @staticmethod
    def edges_of(x: np.ndarray) -> list[np.ndarray]:
        if not len(x):
            return [np.zeros(0)] * x.shape[1]
        return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, Boosted.bins + 1)[1:-1])) for j in range(x.shape[1])]

    @staticmethod
    def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)

    def fit(self, b: np.ndarray, y: np.ndarray) -> Boosted:
        """Trees on features already binned by the edges."""
        n, m = b.shape
        self.base = float(y.mean()) if n else 0.0
        self.model = []
        pred = np.full(n, self.base)
        flat = b + np.arange(m) * self.bins
        for _ in range(self.trees):
            res = y - pred
            node = np.zeros(n, np.int64)
            split = []
            for level in range(self.depth):
                width = 1 << level
                idx = (node[:, None] * (m * self.bins) + flat).ravel()
                s = np.bincount(idx, weights=np.repeat(res, m), minlength=width * m * self.bins).reshape(width, m, self.bins).cumsum(axis=2)
                c = np.bincount(idx, minlength=width * m * self.bins).reshape(width, m, self.bins).cumsum(axis=2)
                st, ct = s[:, :, -1:], c[:, :, -1:]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = s**2 / c + (st - s) ** 2 / (ct - c) - st**2 / np.maximum(ct, 1)
                gain = np.where((c >= self.leaf) & (ct - c >= self.leaf), gain, -1.0).reshape(width, -1)
                best = gain.argmax(axis=1)
                ok = gain[np.arange(width), best] > 1e-9
                f, cut = np.where(ok, best // self.bins, 0), np.where(ok, best % self.bins, self.bins)
                split.append((f, cut))
                node = node * 2 + (b[np.arange(n), f[node]] > cut[node])
            total = np.bincount(node, weights=res, minlength=1 << self.depth)
            count = np.bincount(node, minlength=1 << self.depth)
            value = self.rate * total / (count + 1.0)
            self.model.append((split, value))
            pred += value[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x, self.edges)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for split, value in self.model:
            node = np.zeros(len(x), np.int64)
            for f, cut in split:
                node = node * 2 + (b[rows, f[node]] > cut[node])
            out += value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares nondecreasing fit of y on x, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n, _, hi = blocks.pop()
            u = blocks[-1]
            u[0], u[1], u[3] = (u[0] * u[1] + v * n) / (u[1] + n), u[1] + n, hi
    return np.array([(b[2] + b[3]) / 2 for b in blocks]), np.array([b[0] for b in blocks])


class Grader:
    """The trained model: corpus sketch, word grades, trees and calibration."""

    def __init__(self, sketch: np.ndarray, total: float):
        self.sketch, self.total = sketch, total
        self.words, self.grades = np.zeros(0, np.uint64), np.zeros(0)
        self.trees: Boosted | None = None
        self.knots = (np.array([1.0, 5.0]), np.array([1.0, 5.0]))

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(grade, number of letters and digits) of each text."""
        t = Text(texts)
        letters = np.bincount(t.w.row, weights=t.size, minlength=t.n)
        if self.trees is None:
            return np.full(t.n, np.nan), letters
        grade = np.full(len(t.w.hash), np.nan)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, t.w.hash), len(self.words) - 1)
            grade = np.where(self.words[at] == t.w.hash, self.grades[at], np.nan)
        x = np.hstack([features(t, self.sketch, self.total), grade_features(t.w.row, grade, np.diff(t.w.offs))])
        return np.clip(np.interp(self.trees.predict(x), *self.knots), 1, 5), letters


def corpus_sketch(texts: DataFrame) -> tuple[np.ndarray, float]:
    """In how many documents words occur, by the low bits of their hash, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        docs = 0
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                cp, offs = C.folded(b.column(0).slice(at, 1000))
                w = C.words(cp, offs)
                docs += len(offs) - 1
                bucket = w.hash & np.uint64((1 << SKETCH_BITS) - 1)
                pair = np.unique(w.row.astype(np.uint64) << np.uint64(SKETCH_BITS) | bucket)
                total += np.bincount((pair & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=1 << SKETCH_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs))], ["at", "n"])

    got = texts.mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = got.column("at").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(1 << SKETCH_BITS)
    out[at[at >= 0]] = n[at >= 0]
    return out, float(n[at < 0].sum())


SAMPLE = "grade double, source string, x array<float>, words array<bigint>"


def training_sample(documents: DataFrame, graded: DataFrame, sketch: np.ndarray, total: float) -> Sample | None:
    """At most MAX_TRAINING graded documents, their features computed where the texts are; None if nothing is graded."""
    grades = graded.filter("grade_level BETWEEN 1 AND 5 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("grade_level").alias("grade"))
    picked = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAINING)  # 16 bytes a row: bounded for the broadcast
    texts = documents.select("doc_id", "text", "source").filter("text IS NOT NULL")  # further columns may clash
    held = documents.sparkSession.sparkContext.broadcast((sketch, total))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                t = Text(part.column(0))
                x = features(t, *held.value)
                lists = [pa.ListArray.from_arrays(pa.array((np.arange(t.n + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel())), pa.ListArray.from_arrays(pa.array(t.w.offs.astype(np.int32)), pa.array(t.w.hash.view(np.int64)))]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *lists], ["grade", "source", "x", "words"])

    joined = texts.join(F.broadcast(picked), "doc_id").select("text", "grade", F.coalesce("source", F.lit("")).alias("source"))
    got = joined.mapInArrow(compute, SAMPLE).toArrow().combine_chunks()
    y = got.column("grade").to_numpy()
    if not len(y):
        return None
    lists = pa.concat_arrays(got.column("words").chunks)
    x = pa.concat_arrays(got.column("x").chunks).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
    row = np.repeat(np.arange(len(y)), np.diff(np.asarray(lists.offsets)))
    return Sample(x, y, np.array(got.column("source").to_pylist(), object), row, lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))


def train(documents: DataFrame, graded: DataFrame) -> tuple[Grader, dict[str, np.ndarray]]:
    """The grader, and source, grade and held-out prediction of the training documents.

    A fold's predictions come from trees and a calibration that saw none of its sources.
    """
    spark = documents.sparkSession
    sketch, total = corpus_sketch(documents.filter("text IS NOT NULL").select("text"))
    sample = training_sample(documents, graded, sketch, total)
    g = Grader(sketch, total)
    if sample is None:
        return g, {k: np.zeros(0) for k in ("source", "grade", "held_out")}
    y = sample.y
    held = spark.sparkContext.broadcast(sample)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                everything = np.ones(len(held.value.y), bool)
                made = held.value.held_out(k) if k < FOLDS else held.value.fit(everything)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps(made)], pa.binary())], ["k", "made"])

    tasks = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(fit, "k bigint, made binary")
    made = {r.k: pickle.loads(r.made) for r in tasks.collect()}  # the trees, and one number a training document
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        raw[made[k][0]] = made[k][1]
    g.knots = isotonic(raw, y)
    g.trees = made[FOLDS]
    grades = sample.word_grades(np.ones(len(y), bool))
    known = ~np.isnan(grades)
    g.words, g.grades = sample.words[known], grades[known]
    out = raw.copy()
    for k in range(FOLDS):
        rest = sample.fold != k
        if rest.any():
            out[~rest] = np.interp(raw[~rest], *isotonic(raw[rest], y[rest]))
    return g, {"source": sample.source, "grade": y, "held_out": out}


def reading_levels(documents: DataFrame, graded: DataFrame) -> DataFrame:
    """(doc_id, grade) of every document on the scale of the grades, 1 to 5.

    documents has doc_id, text and source, graded has doc_id and grade_level. Null and blank texts and
    texts without at least two letters or digits have a null grade, and so has every text when nothing is graded.
    Grades outside 1 to 5 are ignored, several grades of one document are averaged.
    """
    g, _ = train(documents, graded)
    held = documents.sparkSession.sparkContext.broadcast(g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                grade, letters = held.value.predict(part.column(1))
                ok = (letters >= 2) & np.isfinite(grade)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(grade, mask=~ok)], ["doc_id", "grade"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, grade double")
