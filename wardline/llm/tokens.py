"""Byte-level BPE over whole texts through caches of pre-tokens, token counts and best-fit packing.

A byte-level BPE never merges across pre-tokens, so a text's ids are its pre-tokens' ids put together. Workers
split a text by the tokenizer's own pattern and look each pre-token up; only unseen ones reach the tokenizer.
Texts for which the pattern's classes could differ between libraries (rare scripts, odd controls) or that hold a
special token's string go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_batches, of_worker, slices, stored, text_rows

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens that a worker remembers beside the pinned ones, then it starts anew; longer ones aren't remembered.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 64
#: Rows of the broadcast table of frequent pre-tokens, at most 64 characters each: below 4 MB at any input size.
FREQUENT = 32_768
PINNED_CHARS = 64
#: Letters, digits and spaces here are the same in every Unicode version of the last ten years.
_ODD = regex.compile("[^\\x00-\\x1b\\x20-\\x7e\\xa0-\\u0377\\u0400-\\u0481\\u048a-\\u0513\\u2010-\\u205e\\u20a0-\\u20bf\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3\\U0001f300-\\U0001f64f]")
#: Up to U+024F, and signs beyond, the standard library splits alike and twice as fast.
_BEYOND_LATIN = re.compile("[^\\x00-\\x1b\\x20-\\x7e\\xa0-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf\\U0001f300-\\U0001f64f]")


def _class(kind: str, below: int = 0x250) -> str:
    """The characters of a general category, for a pattern of the standard library."""
    return "".join(re.escape(chr(i)) for i in range(below) if unicodedata.category(chr(i))[0] == kind)


def _latin_split():
    letter, digit, space = _class("L"), _class("N"), "\\t-\\r\\x20\\xa0"
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+").findall


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 as is, the others from U+0100 on."""
    others = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: 256 + i for i, b in enumerate(others)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PreTokenCache:
    """Pre-token -> value, by a tokenizer file. As a worker keeps it from batch to batch, it is bounded.

    value(ids) makes what is kept of a pre-token's ids; pinned entries stay when the rest is dropped."""

    def __init__(self, path: str, value, pinned: dict | None = None, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split_any, self.split_latin, self.letters = regex.compile(public_tokenizers.PATTERN).findall, _latin_split(), _byte_letters()
        self.value, self.pinned, self.entries = value, pinned or {}, entries
        self.known = dict(self.pinned)

    def split(self, text: str) -> list[str] | None:
        """The pre-tokens, or None for a text that the tokenizer itself must take whole."""
        if any(s in text for s in self.special):
            return None
        if not _BEYOND_LATIN.search(text):
            return self.split_latin(text)
        return None if _ODD.search(text) else self.split_any(text)

    def pre_token(self, word: str) -> list[int]:
        """The ids of one pre-token, by the tokenizer's merges."""
        return [t.id for t in self.merges(word.encode().decode("latin-1").translate(self.letters))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def values(self, texts: list[str]) -> Iterator[list]:
        """For each text the values of its pre-tokens, in order."""
        if len(self.known) > self.entries + len(self.pinned):
            self.known = dict(self.pinned)
        parts = [self.split(t) for t in texts]
        known = self.known
        new = set().union(*(p for p in parts if p)).difference(known)
        fresh = {w: self.value(self.pre_token(w)) for w in new}
        long = {w: v for w, v in fresh.items() if len(w) > CACHE_CHARS}
        known.update((w, v) for w, v in fresh.items() if len(w) <= CACHE_CHARS)
        look = known.__getitem__ if not long else lambda w: known[w] if w in known else long[w]
        for text, part in zip(texts, parts):
            yield [self.value(self.encode([text])[0])] if part is None else list(map(look, part))


# --- counts -------------------------------------------------------------------------------------------------


def frequent_words(docs: DataFrame, rows: int = FREQUENT, per_task: int = 4096) -> list[str]:
    """The most frequent space-marked words over all documents, for the broadcast table. Each task keeps a
    summary of bounded size (rare words are dropped whenever it is full) and hands on per_task words, so what is
    shuffled is a few thousand rows a task. The table saves work only; no count depends on what is in it."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in chain.from_iterable(map(slices, batches)):
            seen.update(chain.from_iterable(t.split(" ") for t in part.column(0).to_pylist()))
            if len(seen) > 32 * per_task:
                seen = Counter(dict(seen.most_common(8 * per_task)))
        top = [(w, n) for w, n in seen.most_common(per_task) if 0 < len(w) < PINNED_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    parts = text_rows(docs).select("text").mapInArrow(summary, "word string, n long")
    top = parts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(rows)
    return [r.word for r in top.collect()]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document.

    Null and empty texts count 0. Repeated rows get a row each; other columns are ignored; an empty table gives
    an empty one. No pre-token is shuffled: tasks look lengths up in a broadcast table of frequent pre-tokens,
    then in their worker's cache."""
    path = path or vocabulary_path()
    spark = docs.sparkSession
    base = PreTokenCache(path, len)
    table = {}
    for word in frequent_words(docs, frequent):
        for piece in (base.split(" " + word) or [])[:1]:
            table[piece] = len(base.pre_token(piece))
    shared = spark.sparkContext.broadcast(table)

    def count(ids: list, texts: list) -> dict:
        cache = of_worker((path, "count", shared.id if hasattr(shared, "id") else id(shared)), lambda: PreTokenCache(path, len, shared.value))
        n = [sum(v) for v in cache.values(texts)]
        return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_batches(text_rows(docs), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


# --- packing ------------------------------------------------------------------------------------------------


class OpenBins:
    """Bins by remaining capacity, as runs of bin numbers, with a segment tree over the capacities that finds the
    tightest open bin for a length in logarithmic time."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.tree = np.zeros(2 * self.leaves, dtype=bool)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _mark(self, capacity: int) -> None:
        i = capacity + self.leaves
        self.tree[i] = bool(self.runs[capacity])
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def add(self, capacity: int, first: int, n: int) -> None:
        if capacity and n:
            self.runs[capacity].append((first, n))
            self._mark(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        run = self.runs[capacity].pop()
        self._mark(capacity)
        return run

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least length that an open bin has."""
        i = length + self.leaves
        if self.tree[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                break
            i //= 2
        if i <= 1:
            return None
        while i < self.leaves:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for counts[length] pieces of each length: rows (length, first_rank, n, each, first_bin,
    offset): the n pieces of that length from first_rank on go to bins from first_bin on, each to a bin, from
    offset on. Pieces of one length are alike, so whole runs of equal bins are filled in a step and the plan's size
    depends on the number of lengths, not on the number of pieces."""
    open_bins, rows, made = OpenBins(size), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = open_bins.tightest(length)
            if capacity is None:
                capacity, first, n = size, made, -(-left // (size // length))
                made += n
            else:
                first, n = open_bins.take(capacity)
            each, offset = capacity // length, size - capacity
            full = min(n, left // each)
            if full:
                rows.append((length, rank, full * each, each, first, offset))
                open_bins.add(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                rows.append((length, rank, left, left, first + full, offset))
                open_bins.add(capacity - left * length, first + full, 1)
                full, left = full + 1, 0
            open_bins.add(capacity, first + full, n - full)
    return rows


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()


def token_pieces(docs: DataFrame, path: str, size: int, end_id: int | None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, and its number among the task's pieces of that
    length. A document's first piece takes what is left over; the others are full."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = of_worker((path, "ids"), lambda: PreTokenCache(path, _bytes))
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        for part in chain.from_iterable(map(slices, batches)):
            out: list[list] = [[] for _ in range(6)]
            for doc, values in zip(part.column(0).to_pylist(), cache.values(part.column(1).to_pylist())):
                ids = b"".join(values) + end
                n = len(ids) // 4
                start, length = 0, n % size or size
                for k in range(-(-n // size)):
                    row = (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), seen[length])
                    for col, x in zip(out, row):
                        col.append(x)
                    seen[length] += 1
                    start, length = start + length, size
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            cols = [pa.array(c, t) for c, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([task] * len(out[0]), pa.int32())], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"])

    return text_rows(docs).mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, task int")


def pack(docs: DataFrame, path: str | None = None, size: int = 1024, end_id: int | None = 2) -> DataFrame:
    """Best-fit decreasing of all documents' token pieces into sequences of at most size tokens: doc_id, piece,
    start, length, ids_crc32, sequence_id, offset.

    The whole corpus is packed as one: the driver plans on the counts of the size possible lengths alone, and each
    piece finds its place by its rank among the pieces of its length. Null and empty texts hold the end id only
    (without one they have no piece). Repeated rows are packed each; ties in length go by task and place in it;
    other columns are ignored; an empty table gives an empty one."""
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, path or vocabulary_path(), size, end_id), "pieces")
    dealt = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = stored(dealt.select("length", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")), "ranks")
    counts = {r.length: r.n for r in ranks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(
        best_fit_plan(counts, size), "length long, first_rank long, plan_n long, each long, first_bin long, base long"
    )
    ranked = pieces.join(ranks.select("length", "task", "earlier"), ["length", "task"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    # the plan has at most a few rows for each pair of a length and a capacity, whatever the input
    placed = ranked.join(F.broadcast(plan), "length").where("rank >= first_rank and rank < first_rank + plan_n")
    at = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("first_bin + (rank - first_rank) div each").alias("sequence_id"),
        (F.col("base") + at % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
