"""Document quality by co-training of two views.

One classifier sees the text's content (its words and how they are written), the other the page's metadata (source,
language, recorded size) and nothing of the text. Over rounds each tells the other the class of the unlabelled rows
that it is sure of. Both are then calibrated, and a logistic combination of the calibrated views scores all documents;
each of these steps has labelled rows of its own.

The labelled rows are a bounded sample, fitted on the driver. The unlabelled rows are all there are: every round is a
pass over a table of features, in which tasks add up gradients and curvatures for one Newton step of each view.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forget, keep_rows, labels, map_batches, of_worker, stored
from .quality_rules import repeated_words
from .toxicity import held_out

#: At most so many labelled rows of each class are fitted on.
LABELLED = 3000
ROUNDS, SURE = 4, 0.97
SOURCES, LANGS, WORDS = 32, 8, 32
CACHE_WORDS = 200_000
_UPPER, _SIGNS, _BARS = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile(r"[#*$%&<>!@^~_=+{}\[\]\\]"), re.compile(r"(?:^|\s)[|»›•·/\\–—-]+(?=\s|$)")


class _Slots(dict):
    """Word -> its slot by a hash of the word in lower case, found when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = out = zlib.crc32(word.lower()) % WORDS
        return out


def content_view(text: str) -> list[float]:
    """Of a whole text: share of different words, of words in repeated windows, of capitals, of signs, of
    separators standing alone, of digits; word length and number of words; the share of its words in each of WORDS
    hashed slots."""
    words = text.encode("utf-8", "surrogatepass").split()
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * (8 + WORDS)
    slots = of_worker(("slots",), _Slots)
    bag = np.bincount(np.fromiter(map(slots.__getitem__, words), dtype=np.int64, count=n), minlength=WORDS) / n
    return [
        len(set(words)) / n, repeated_words(words) / n, len(_UPPER.findall(text)) / size, len(_SIGNS.findall(text)) / size,
        len(_BARS.findall(text)) / n, sum(map(text.count, "0123456789")) / size, len(text) / n / 10, math.log1p(n) / 10, *bag.tolist(),
    ]


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Source and language in hashed slots, and the recorded size; what is missing is 0."""
    slots = [0.0] * (SOURCES + LANGS)
    if source is not None:
        slots[zlib.crc32(source.encode("utf-8", "surrogatepass")) % SOURCES] = 1.0
    if lang is not None:
        slots[SOURCES + zlib.crc32(lang.encode("utf-8", "surrogatepass")) % LANGS] = 1.0
    return [*slots, math.log1p(max(0, n_chars or 0)) / 10]


@dataclass
class Logistic:
    """A ridge logistic classifier over standardized features."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias

    def parts(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each class: number of rows, gradient and curvature of the loss, as one row of sums."""
        z = np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])
        p = 1 / (1 + np.exp(-np.clip(z @ np.append(self.weight, self.bias), -30, 30)))
        out = []
        for c in (0, 1):
            own = z[y == c]
            q = p[y == c]
            out.append(np.concatenate([[len(own)], own.T @ (q - c), ((own * (q * (1 - q) + 1e-6)[:, None]).T @ own).ravel()]))
        return np.stack(out)

    def step(self, known: np.ndarray, told: np.ndarray, ridge: float = 1e-3) -> "Logistic":
        """After a Newton step on labelled rows and on rows told by the other view, given as parts. The classes weigh alike,
        and those told of a class no more than the labelled ones."""
        d = len(self.weight) + 1
        w = np.append(self.weight, self.bias)
        g, h = ridge * w, ridge * np.eye(d)
        for k, t in zip(known, told):
            less = min(1.0, k[0] / t[0]) if t[0] else 0.0
            both = (k + less * t) * 0.5 / max(1.0, k[0] + less * t[0])
            g, h = g + both[1 : d + 1], h + both[d + 1 :].reshape(d, d)
        w = np.round(w - np.linalg.solve(h, g), 9)
        return Logistic(self.mean, self.scale, w[:-1], float(w[-1]))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, steps: int = 25) -> "Logistic":
        """By Newton steps, classes weighted alike."""
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        out = cls(mean, scale, np.zeros(x.shape[1]), 0.0)
        for _ in range(steps):
            known = out.parts(x, y)
            out = out.step(known, np.zeros_like(known))
        return out


@dataclass
class Model:
    views: tuple[Logistic, Logistic]
    calibrated: tuple[Logistic, Logistic]
    combined: Logistic

    def scores(self, xs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        each = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibrated, xs)]
        return 1 / (1 + np.exp(-np.clip(self.combined.logit(np.stack(each, axis=1)), -30, 30)))


def folds(y: np.ndarray) -> list[np.ndarray] | None:
    """Rows to learn from, to calibrate within the rounds, to calibrate at the end and to combine on. With too few labelled
    rows the last three are the same rows; None if a class is missing even so."""
    at = np.arange(len(y)) % 8
    both = lambda rows: len(np.unique(y[rows])) == 2
    apart = [at < 5, at == 5, at == 6, at == 7]
    if all(map(both, apart)):
        return apart
    return [at < 5, at >= 5, at >= 5, at >= 5] if both(at < 5) and both(at >= 5) else None


def fit(xs: tuple[np.ndarray, np.ndarray], y: np.ndarray, told: Callable[[list, list], list], rounds: int = ROUNDS) -> Model | None:
    """Co-train on labelled rows (two views, classes) and on what told(views, calibrated) says of all unlabelled rows: for
    each view the parts of the rows that the other one is sure of. None if a class is missing."""
    own = folds(y)
    if own is None:
        return None
    learn, during, after, last = own
    views = [Logistic.fit(x[learn], y[learn]) for x in xs]
    calibrate = lambda rows: [Logistic.fit(v.logit(x[rows])[:, None], y[rows]) for v, x in zip(views, xs)]
    for _ in range(rounds):
        parts = told(views, calibrate(during))
        views = [v.step(v.parts(x[learn], y[learn]), t) for v, x, t in zip(views, xs, parts)]
    calibrated = calibrate(after)
    both = np.stack([c.logit(v.logit(x[last])[:, None]) for v, c, x in zip(views, calibrated, xs)], axis=1)
    for k in (0, 1):  # a view that would count against itself says nothing
        if Logistic.fit(both, y[last]).weight[k] < 0:
            both[:, k] = 0
    return Model(tuple(views), tuple(calibrated), Logistic.fit(both, y[last]))


def sure_parts(views: list[Logistic], calibrated: list[Logistic], xs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """For each view the parts of the rows whose class the other view is sure of."""
    p = [1 / (1 + np.exp(-np.clip(c.logit(v.logit(x)[:, None]), -30, 30))) for v, c, x in zip(views, calibrated, xs)]
    out = []
    for k in (0, 1):
        sure = np.maximum(p[1 - k], 1 - p[1 - k]) >= SURE
        out.append(views[k].parts(xs[k][sure], (p[1 - k][sure] > 0.5).astype(int)))
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, a, b: the two views of each document; columns that docs lacks count as null."""
    column = lambda c, kind: F.col(c).cast(kind).alias(c) if c in docs.columns else F.lit(None).cast(kind).alias(c)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"), column("lang", "string"), column("source", "string"), column("n_chars", "long"))

    def make(ids: list, out: list, texts: list, *page: list) -> dict:
        return {"doc_id": ids, "held_out": out, "a": [content_view(t) for t in texts], "b": [metadata_view(*r) for r in zip(*page)]}

    return map_batches(rows, make, "doc_id long, held_out boolean, a array<float>, b array<float>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _summed(pool: DataFrame, views: list[Logistic], calibrated: list[Logistic]) -> list[np.ndarray]:
    """sure_parts over all rows of pool (a, b). Each task hands on one row of sums, a second step adds those of many tasks,
    so the driver gets a few rows at any size."""
    widths = [len(v.weight) for v in views]
    shared = pool.sparkSession.sparkContext.broadcast((views, calibrated))
    shapes = [(2, 1 + (w + 1) + (w + 1) ** 2) for w in widths]

    def flat(parts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate([p.ravel() for p in parts]).tobytes()], pa.binary())], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(s) for s in shapes]
        for b in batches:
            if b.num_rows:
                own = sure_parts(*shared.value, tuple(_matrix(b.column(k), w) for k, w in enumerate(widths)))
                total = [t + o for t, o in zip(total, own)]
        yield flat(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(a * b for a, b in shapes))
        for b in batches:
            for sums in b.column(0).to_pylist():
                total = total + np.frombuffer(sums)
        yield flat([total])

    rows = pool.select("a", "b").mapInArrow(add, "sums binary").repartition(8).mapInArrow(merge, "sums binary").collect()
    total, out = sum(np.frombuffer(r.sums) for r in rows), []
    for s in shapes:
        out.append(total[: s[0] * s[1]].reshape(s))
        total = total[s[0] * s[1] :]
    return out


def train_on(made: DataFrame, marks: DataFrame) -> Model | None:
    """Fit on a stored table of features: on at most LABELLED rows of each class that aren't held out, the first by a hash
    of doc_id, and on all rows without a label."""
    known = marks.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("class"))
    both = stored(made.join(known, "doc_id", "left"), "marked-features")
    learn = both.where(F.col("class").isNotNull() & ~F.col("held_out"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("a"), F.col("b")]
    some = [learn.where(F.col("class") == c).orderBy(*order).limit(LABELLED) for c in (0, 1)]
    rows = [(zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.a, r.b, r["class"]) for r in some[0].union(some[1]).collect()]
    rows.sort()
    if not rows:
        return None
    xs = tuple(np.array([r[k] for r in rows], dtype=float) for k in (2, 3))
    pool = both.where(F.col("class").isNull())
    model = fit(xs, np.array([r[4] for r in rows]), lambda views, calibrated: _summed(pool, views, calibrated))
    forget(both)
    return model


def train(docs: DataFrame, marks: DataFrame) -> Model | None:
    made = features(docs)
    return train_on(made, marks)


def _scores(model: Model | None, xs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.full(len(xs[0]), 0.5) if model is None else model.scores(xs)


def kept(docs: DataFrame, model: Model | None, threshold: float = 0.25) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns, repeated rows each. Null and empty texts
    are scored like any other; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(texts: list, *page: list) -> np.ndarray:
        xs = np.array([content_view(t) for t in texts], dtype=np.float32), np.array([metadata_view(*r) for r in zip(*page)], dtype=np.float32)
        return _scores(shared.value, tuple(x.astype(float) for x in xs)) >= threshold

    return keep_rows(docs, ["text", "lang", "source", "n_chars"], decide)


def score_features(made: DataFrame, model: Model | None, threshold: float = 0.25) -> DataFrame:
    """doc_id, held_out, score, kept of rows of features."""
    shared = made.sparkSession.sparkContext.broadcast(model)
    widths = 8 + WORDS, SOURCES + LANGS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _scores(shared.value, tuple(_matrix(b.column(k + 2), w) for k, w in enumerate(widths)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(s, 6)), pa.array(s >= threshold)], names=["doc_id", "held_out", "score", "kept"])

    return made.select("doc_id", "held_out", "a", "b").mapInArrow(run, "doc_id long, held_out boolean, score double, kept boolean")


def score(docs: DataFrame, model: Model | None, threshold: float = 0.25) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), kept for each document. The threshold is low, so that a document
    goes only if junk is three times as likely.

    Null and empty texts are scored like any other, their content being 0. Without a model (no labelled rows of
    both classes) the score is 0.5 and all are kept. Repeated rows get a row each; other columns are ignored; an
    empty table gives an empty one."""
    return score_features(features(docs), model, threshold)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stored(features(documents(spark, sf_dir)), "features")
    return score_features(made, train_on(made, labels(spark, sf_dir)))
