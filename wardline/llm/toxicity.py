"""Toxicity of whole texts: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams, so an unseen misspelling shares most of them
with the word it comes from. A passage of WINDOW words averages its words, and a linear softmax gives its class. A
document is judged by its most toxic passage and its most toxic words: few words decide, whatever the text's length.
Training alternates between choosing each toxic document's leading passages and gradient steps on those.

With two classes, the softmax of an average is a logistic function of the average of one number for each n-gram, so
scoring needs a table of numbers alone, and each worker remembers the number of each word it has met.
"""

from __future__ import annotations

import math
import pickle
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep_rows, labels, map_batches, of_worker, release, slices, text_rows

BUCKETS, WIDTH, SIZES, WINDOW = 1 << 19, 4, (3, 4, 5, 6), 3
#: The labelled rows that training takes at most, of each class; all their passages count.
TRAIN_ROWS = {0: 2500, 1: 1200}
#: Passages of class 0 that a gradient step averages over: half at random, a quarter those that seem most toxic.
NEGATIVES = 80_000
#: Passages of a toxic document that a training round takes.
LEADS = 3
#: A document's features are its leading passage and the means of its so many most toxic different words.
TOPS = (1, 3, 6, 10)
#: Of so many training rows one is for calibration.
FOLD = 3
#: Documents that an n-gram's first vector is tempered by.
PRIOR = 3.0
CACHE_WORDS = 250_000
_EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "“”‘’«»…–—¡¿"


def held_out(doc_id):
    """Rows that nothing is learnt from: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def n_grams(token: str) -> list[int]:
    """Buckets of the n-grams of a token without the signs around it, and of the word itself."""
    word = f"<{token.strip(_EDGES)}>"
    if len(word) == 2:
        return []
    data = [word[i : i + n].encode("utf-8", "surrogatepass") for n in SIZES for i in range(max(1, len(word) - n + 1)) if n == SIZES[0] or len(word) >= n]
    return [zlib.crc32(d) & (BUCKETS - 1) for d in data] + [zlib.crc32(b"=" + word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)]


@dataclass
class Model:
    """weight of each n-gram, slopes and bias; a score is a logistic function of a document's features."""

    weight: np.ndarray
    bias: float
    empty: float
    slope: np.ndarray

    def scores(self, texts: list[str], numbers: Numbers) -> list[float]:
        """The score of each text; numbers is the worker's Numbers of this model."""
        if len(numbers) > CACHE_WORDS:
            numbers.clear()
        out = []
        for text in texts:
            words = text.lower().split()
            n = len(words)
            if not n:
                out.append(self.empty)
                continue
            logit = float(self.slope @ features(words, numbers)) + self.bias
            out.append(round(1 / (1 + math.exp(-min(max(logit, -30.0), 30.0))), 6))
        return out


def leading(words: list[str], numbers: dict[str, float]) -> float:
    """The highest mean of WINDOW neighbouring words; of all words if they are fewer."""
    each = np.fromiter(map(numbers.__getitem__, words), dtype=np.float64, count=len(words))
    if len(words) <= WINDOW:
        return float(each.mean())
    total = np.concatenate([[0.0], np.cumsum(each)])
    return float((total[WINDOW:] - total[:-WINDOW]).max() / WINDOW)


def features(words: list[str], numbers: Numbers) -> np.ndarray:
    """What the score of a text with words depends on. Where there are fewer different words than asked for, the rest
    count as 0."""
    different = set(words)
    numbers.learn(different)
    top = -np.sort(-np.fromiter(map(numbers.__getitem__, different), dtype=np.float64))[: TOPS[-1]]
    return np.array([leading(words, numbers), *(top[:k].sum() / k for k in TOPS)])


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, without the inversions."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def buckets(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n_grams() of many tokens at once: the number of the token in the list and the bucket, for each n-gram. The CRCs of all
    n-grams that start at a character grow together, by one character at a time."""
    words = [f"<{t.strip(_EDGES)}>".encode("utf-8", "surrogatepass") for t in tokens]
    full = [i for i, w in enumerate(words) if len(w) > 2]
    if not full:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    own = [words[i] for i in full]
    data = np.frombuffer(b"".join(own), dtype=np.uint8)
    first = np.flatnonzero(data & 0xC0 != 0x80)  # the first byte of each character
    size = np.diff(np.append(first, len(data)))
    ends = np.cumsum([len(w) for w in own])
    end = np.searchsorted(first, ends)  # the character behind each word's last one
    word = np.repeat(np.arange(len(own)), np.diff(end, prepend=0))
    start, behind, crc = np.arange(len(first)), end[word], np.full(len(first), 0xFFFFFFFF, dtype=np.uint32)
    of, found = [], []
    for k in range(SIZES[-1]):
        inside = start + k < behind
        start, behind, crc = start[inside], behind[inside], crc[inside]
        at, long = first[start + k], size[start + k]
        crc = _CRC[(crc ^ data[at]) & 255] ^ crc >> np.uint32(8)
        for more in range(1, int(long.max(initial=1))):
            some = np.flatnonzero(long > more)
            crc[some] = _CRC[(crc[some] ^ data[at[some] + more]) & 255] ^ crc[some] >> np.uint32(8)
        if k + 1 in SIZES:
            of.append(word[start])
            found.append(~crc & np.uint32(BUCKETS - 1))
    of.append(np.arange(len(own)))
    found.append(np.array([zlib.crc32(b"=" + w) & (BUCKETS - 1) for w in own], dtype=np.uint32))
    return np.array(full)[np.concatenate(of)], np.concatenate(found).astype(np.int64)


class Numbers(dict):
    """Token -> the mean weight of its n-grams, found when first asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self.weight = model.weight

    def learn(self, tokens: Iterable[str]) -> None:
        """Find the numbers of those tokens that are new, together."""
        new = [t for t in tokens if t not in self]
        if new:
            of, found = buckets(new)
            total = np.bincount(of, weights=self.weight[found], minlength=len(new))
            self.update(zip(new, (total / np.maximum(np.bincount(of, minlength=len(new)), 1)).tolist()))

    def __missing__(self, token: str) -> float:
        self.learn([token])
        return self[token]


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive runs of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _mean(columns: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Means of consecutive runs of columns; no run is empty."""
    starts = np.concatenate([[0], ends[:-1]])
    return np.add.reduceat(columns, starts, axis=1) / (ends - starts).astype(np.float32)


def fit(docs: Iterable[tuple[str, int]], seed: int = 0, rounds: int = 6, steps: int = 20, rate: float = 0.05, least: int = 4) -> Model:
    """Train on documents given as their joined words, with their classes. Embeddings and softmax learn together, by Adam.

    Each WINDOW words are a passage. Passages of documents of class 0 are all of class 0; a round's steps average over
    some of them, taken anew at random, and over those that seem most toxic. Of a document of class 1 a round takes the
    LEADS passages that the model so far finds most toxic. The first vectors lean along one axis by the log odds of an
    n-gram's documents, so that the first choice of passages is a sound one. N-grams that fewer than least documents
    hold have no vector."""
    vocab: dict[str, int] = {}
    parts, classes = [], []
    for text, c in docs:
        own = [vocab.setdefault(w, len(vocab)) for w in text.split(" ") if w]
        if own:
            parts.append(np.array(own, dtype=np.int32))
            classes.append(c)
    y_all = np.array(classes, dtype=np.int64)
    share = float(np.clip(y_all.mean(), 0.01, 0.5)) if len(y_all) else 0.01
    nothing = Model(np.zeros(BUCKETS, dtype=np.float32), float(np.log(share / (1 - share))), round(share, 6), np.zeros(1 + len(TOPS)))
    if not len(y_all) or y_all.min() == y_all.max():
        return nothing
    rng = np.random.default_rng(seed)
    words = np.concatenate(parts)
    n_words = np.array([len(p) for p in parts])
    n_passages = -(-n_words // WINDOW)
    size = np.minimum(WINDOW, np.repeat(n_words, n_passages) - WINDOW * _within(n_passages)).astype(np.int32)
    end = np.cumsum(size)
    doc_of = np.repeat(np.arange(len(parts)), n_passages)

    packed, gram_size = array("i"), np.zeros(len(vocab), dtype=np.int64)  # as lists of numbers these would be the most by far
    for k, w in enumerate(vocab):
        own = n_grams(w) or [0]
        packed.extend(own)
        gram_size[k] = len(own)
    gram, gram_end = np.frombuffer(packed, dtype=np.int32), np.cumsum(gram_size)
    held = np.zeros((2, BUCKETS), dtype=np.int32)  # documents of each class with each n-gram
    for own, c in zip(parts, y_all):
        at = np.unique(own)
        held[c, np.unique(gram[np.repeat(gram_end[at] - gram_size[at], gram_size[at]) + _within(gram_size[at])])] += 1
    del parts
    used = np.flatnonzero(held.sum(axis=0) >= least)
    if not len(used):
        return nothing
    place = np.full(BUCKETS, len(used), dtype=np.int32)  # the last column stands for all others and stays 0
    place[used] = np.arange(len(used), dtype=np.int32)
    gram = place[gram]

    table = rng.normal(0, 0.05, (WIDTH, len(used) + 1)).astype(np.float32)
    ratio = y_all.mean()
    odds = np.log((held[1, used] + PRIOR * ratio) / (held[0, used] + PRIOR * (1 - ratio)) * (1 - ratio) / ratio)
    table[0, :-1] += odds
    table[:, -1] = 0
    soft = rng.normal(0, 0.1, (2, WIDTH)).astype(np.float32)
    soft[:, 0] = -0.5, 0.5
    bias = np.zeros((2, 1), dtype=np.float32)
    params = [table, soft, bias]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    clean = np.flatnonzero(y_all[doc_of] == 0)
    for r in range(rounds):
        some = rng.choice(clean, min(NEGATIVES, len(clean)), replace=False)
        number = _mean(((soft[1] - soft[0]) @ table)[None, gram], gram_end)[0]
        logit = np.add.reduceat(number[words], end - size) / size
        lead = np.flatnonzero(y_all[doc_of] == 1)
        lead = lead[np.lexsort((-logit[lead], doc_of[lead]))]
        many = np.unique(doc_of[lead], return_counts=True)[1]
        toxic = lead[_within(many) < LEADS]
        many = np.minimum(many, LEADS)
        hard = clean[np.argsort(-logit[clean], kind="stable")[: NEGATIVES // 4]]
        some = np.unique(np.concatenate([some[: NEGATIVES // 2], hard]))
        chosen = np.concatenate([some, toxic])
        y = np.concatenate([np.zeros(len(some), dtype=np.int64), np.ones(len(toxic), dtype=np.int64)])
        weight = np.concatenate([np.full(len(some), 0.7 / len(some)), np.repeat(0.3 / len(many) / many, many)]).astype(np.float32)

        own_size = size[chosen]
        own = words[np.repeat(end[chosen] - own_size, own_size) + _within(own_size)]
        own_end = np.cumsum(own_size)
        present, own = np.unique(own, return_inverse=True)
        by_word = np.argsort(own, kind="stable")
        word_cut = np.flatnonzero(np.diff(own[by_word], prepend=-1))
        passage_of = np.repeat(np.arange(len(chosen)), own_size)[by_word]
        here_size = gram_size[present]
        here = gram[np.repeat(gram_end[present] - here_size, here_size) + _within(here_size)]
        here_end = np.cumsum(here_size)
        by_gram = np.argsort(here, kind="stable")
        gram_cut = np.flatnonzero(np.diff(here[by_gram], prepend=-1))
        columns = here[by_gram][gram_cut]
        owner = np.repeat(np.arange(len(present)), here_size)[by_gram]
        per_word, per_passage = (1.0 / here_size).astype(np.float32), (1.0 / own_size).astype(np.float32)
        for _ in range(steps):
            t += 1
            vectors = _mean(_mean(table[:, here], here_end)[:, own], own_end)
            z = soft @ vectors + bias
            p = np.exp(z - z.max(axis=0))
            p /= p.sum(axis=0)
            p[y, np.arange(len(y))] -= 1
            p *= weight
            d_word = np.add.reduceat(((soft.T @ p) * per_passage)[:, passage_of], word_cut, axis=1) * per_word
            d_table = 1e-6 * table
            d_table[:, columns] += np.add.reduceat(d_word[:, owner], gram_cut, axis=1)
            d_table[:, -1] = 0
            grads = [d_table, p @ vectors.T + 1e-6 * soft, p.sum(axis=1, keepdims=True)]
            for k, (param, g) in enumerate(zip(params, grads)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                param -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)
    numbers = np.zeros(BUCKETS, dtype=np.float32)
    numbers[used] = (soft[1] - soft[0]) @ table[:, :-1]
    return Model(numbers, float(bias[1, 0] - bias[0, 0]), round(share, 6), np.array([1.0] + [0.0] * len(TOPS)))


def calibrated(model: Model, docs: list[tuple[str, int]], ridge: float = 0.3) -> Model:
    """The model with slopes and bias from whole documents that it hasn't learnt from, by logistic regression on their
    features, toxic ones counted twice."""
    numbers = Numbers(model)
    x = np.array([features(t.split(" "), numbers) for t, _ in docs if t])
    y = np.array([c for t, c in docs if t], dtype=float)
    if not len(y) or y.min() == y.max():
        return model
    mean, scale, each = x.mean(axis=0), x.std(axis=0) + 1e-6, 1 + y
    z, w = np.hstack([(x - mean) / scale, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (each * (p * (1 - p) + 1e-6))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (each * (p - y)) + ridge * w)
    return Model(model.weight, float(w[-1] - w[:-1] @ (mean / scale)), model.empty, w[:-1] / scale)


def training_rows(docs: DataFrame, marks: DataFrame, column: str = "toxic") -> DataFrame:
    """doc_id, class of the labelled rows among docs to learn from: not held out, of each class the TRAIN_ROWS first by a
    hash of doc_id. A doc_id labelled twice counts once, with its larger label."""
    rows = marks.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(column).alias("class")).join(docs.select("doc_id"), "doc_id", "left_semi")
    some = [rows.where(F.col("class") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in TRAIN_ROWS.items()]
    return some[0].union(some[1])


def train(docs: DataFrame, marks: DataFrame) -> Model:
    """Fit on a bounded sample of labelled documents among docs, whole texts each. At most TRAIN_ROWS texts reach one task, which
    fits the model and hands the driver its weights; the task is run again where its executor is lost."""
    known = text_rows(docs).join(F.broadcast(training_rows(docs, marks)), "doc_id").select("doc_id", "class", "text")

    def cut(ids: list, classes: list, texts: list) -> dict:
        return {"doc_id": ids, "class": classes, "words": [" ".join(t.lower().split()) for t in texts]}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_worker(("toxicity",), dict)  # the last operator's cache goes
        rows = []
        for part in chain.from_iterable(map(slices, batches)):
            rows += [(zlib.crc32(str(doc).encode()), doc, words, c) for doc, c, words in zip(*[x.to_pylist() for x in part.columns])]
        rows.sort()
        model = pickle.dumps(trained([(words, c) for _, _, words, c in rows]))
        rows.clear()
        release()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    words = map_batches(known, cut, "doc_id long, class int, words string")
    learnt = words.repartition(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(learnt.model) if learnt else trained([])


def trained(rows: list[tuple[str, int]]) -> Model:
    """Fit on all rows but one of FOLD, and calibrate on the others."""
    return calibrated(fit(r for i, r in enumerate(rows) if i % FOLD), rows[::FOLD])


def _numbers(shared) -> Numbers:
    """One table for each worker process and model."""
    kept = of_worker(("toxicity",), dict)
    if kept.get("of") is not shared.value:
        kept.update(of=shared.value, numbers=Numbers(shared.value))
    return kept["numbers"]


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each document. Null and empty texts get the training share of toxic
    rows, at most a half. Repeated rows get a row each; other columns are ignored; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(ids: list, out: list, texts: list) -> dict:
        s = shared.value.scores(texts, _numbers(shared))
        return {"doc_id": ids, "held_out": out, "score": s, "predicted": [int(x >= threshold) for x in s]}

    rows = text_rows(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, ["text"], lambda texts: [s < threshold for s in shared.value.scores(texts, _numbers(shared))])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, labels(spark, sf_dir)))
