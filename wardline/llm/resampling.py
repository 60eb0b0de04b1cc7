"""Importance resampling towards a target distribution, by hashed n-grams of words.

Words come with their offsets from an untrained pre-tokenizer. A feature is a window from one word's begin to a later
one's end over the words put together by single spaces; the CRC of its bytes names its bucket. The histograms of the raw
documents and of the target texts give each bucket a gain, the log of how much likelier the target has it, and a
document's weight is the sum of its features' gains. Gumbel noise on the weights draws documents without replacement.

The words of the corpus are read once: a document's sorted buckets are stored as their differences, about a byte each,
for the two steps that need them, the histogram and the sums.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, of_worker, slices, stored, text_rows

BUCKETS, LONGEST, PER_CENT, LEAST_WORDS, SEED = 10_000, 3, 5, 20, 42
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Characters of a text that are split at a time: a longer text is cut between words, so that its words don't all stand in
#: memory as objects.
STRETCH = 1 << 16
#: Tasks that add up the histograms of all tasks; each hands the driver one.
ADDERS = 8


class Words:
    """The words of a text, with offsets, by a tokenizer library's pre-tokenizer."""

    def __init__(self):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True).pre_tokenize_str

    def stretches(self, text: str) -> Iterator[list[tuple[str, tuple[int, int]]]]:
        """Words and offsets of consecutive stretches of the text, which is lowered in A-Z alone."""
        low, at = text.encode().lower().decode(), 0
        while at < len(low):
            cut = _BETWEEN.search(low, at + STRETCH)
            end = cut.start() if cut else len(low)
            yield self.split(low[at:end] if at or cut else low)
            at = end

    def buckets(self, text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[int, np.ndarray]:
        """The number of words, and the bucket of each window of 1 to longest words. A window's CRC goes on from that of the
        window which ends a word before."""
        n, before, out = 0, [], [np.zeros(0, dtype=np.int64)]
        for found in self.stretches(text):
            words = before + [w.encode() for w, _ in found]
            spaced, sums = [b" " + w for w in words], list(map(crc32, words))
            out.append(np.array(sums[len(before) :], dtype=np.int64) % buckets)
            for k in range(1, longest):
                sums = list(map(crc32, spaced[k:], sums))
                out.append(np.array(sums[max(0, len(before) - k) :], dtype=np.int64) % buckets)
            n += len(found)
            before = words[-(longest - 1) :] if longest > 1 else []
        return n, np.concatenate(out)


def features(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, gaps: gaps are the differences of the document's sorted buckets, the first one from 0. One
    narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = of_worker(("words with offsets",), Words)
        for part in chain.from_iterable(map(slices, batches)):
            each = [words.buckets(t, buckets, longest) for t in part.column(1).to_pylist()]
            sizes = np.array([len(b) for _, b in each], dtype=np.int64)
            gaps = [np.diff(np.sort(b), prepend=0) for _, b in each]
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(gaps), pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in each], pa.int64()), pa.array(sizes), lists], names=["doc_id", "n_words", "n_features", "gaps"])

    return text_rows(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, gaps array<int>")


def _unpacked(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all rows one after the other, and where each row begins (and the last one ends)."""
    cuts = lists.offsets.to_numpy().astype(np.int64)
    sums = np.cumsum(np.concatenate([[0], lists.values.to_numpy()[cuts[0] : cuts[-1]]]), dtype=np.int64)
    cuts = cuts - cuts[0]
    return sums[1:] - np.repeat(sums[cuts[:-1]], np.diff(cuts)), cuts


def histogram(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all documents each bucket has. Each task hands on one histogram, ADDERS tasks add them up, so
    the driver gets that many at any size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for part in chain.from_iterable(map(slices, batches)):
            total += np.bincount(_unpacked(part.column(0))[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for part in chain.from_iterable(map(slices, batches)):
            for counts in part.column(0).to_pylist():
                total += np.frombuffer(counts, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    rows = found.select("gaps").mapInArrow(count, "counts binary").repartition(ADDERS).mapInArrow(add, "counts binary").collect()
    return sum((np.frombuffer(r.counts, dtype=np.int64) for r in rows), np.zeros(buckets, dtype=np.int64))


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """For each bucket floor(1000 ln of the target's share over the raw share), each count raised by one."""
    whole_t, whole_s = float(target.sum()) + len(target), float(raw.sum()) + len(raw)
    return np.array([math.floor(1000 * math.log((t + 1) * whole_s / ((s + 1) * whole_t))) for t, s in zip(target.tolist(), raw.tolist())], dtype=np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the sum of the gains of a document's features."""
    shared = found.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chain.from_iterable(map(slices, batches)):
            at, cuts = _unpacked(part.column(3))
            sums = np.concatenate([[0], np.cumsum(shared.value[at])])
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.diff(sums[cuts]), pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return found.select("doc_id", "n_words", "n_features", "gaps").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list, most: int) -> DataFrame:
    """rows (a stored table) with rank, from 1 by order, null beyond most. Rows are dealt by ranges of the order and of their
    place, so that equal ones can lie in many ranges; each range numbers its own, and the sizes of those before it are added."""
    names = rows.columns
    dealt = rows.withColumn("_at", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*order, "_at").sortWithinPartitions(*order, "_at").drop("_at").withColumn("_range", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(n + 1, n + 1 + b.num_rows), pa.int64())], names=[*names, "_range", "_nth"])
            n += b.num_rows

    dealt = stored(dealt.mapInArrow(number, ", ".join(f"`{c}` {t}" for c, t in [*dealt.dtypes, ("_nth", "bigint")])), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"))
    rank = F.col("_earlier") + F.col("_nth")
    return dealt.join(F.broadcast(sizes), "_range").select(*names, F.when(rank <= most, rank).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each document of docs: those drawn towards the texts of target have a rank.

    Null and empty texts have no feature and weight 0, and with fewer than least_words words no rank. The noise comes from
    seed and doc_id alone (a null doc_id as an empty one). Equal scores go by doc_id, null first; repeated rows are ranked each,
    side by side. Other columns are ignored; an empty table gives an empty one, and without target texts all gains come
    from the raw counts."""
    found = stored(features(docs, buckets, longest), "features")
    wanted = stored(features(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), buckets, longest), "target-features")
    gain = gains(histogram(wanted, buckets), histogram(found, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    rows = stored(weighed(found, gain).withColumn("score", score), "weights")
    able = rows.where(F.col("n_words") >= least_words)
    out = ranked(able, [F.desc("score"), F.asc("doc_id")], able.count() * per_cent // 100)
    return out.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))).drop("n_words")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
