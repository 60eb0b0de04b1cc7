"""Spelling variants: words that one edit parts, grouped under their frequent form.

Letters are hashed to a few symbols, so a word becomes a reduced word over a small alphabet. One edit of a word is one
edit of its reduced word, or none, so two near words meet when the full one-edit neighbourhood of each reduced word is
joined with the reduced vocabulary; the words themselves decide. A reduced word travels as the 64-bit hash of its symbols.
Different ones may share a hash, which only adds pairs to be verified. The alphabet grows with the seventh root of the
vocabulary (the shortest words have seven letters), so that a reduced word stands for few words at any size.

Few of a word's hundred or two hundred neighbours are in the reduced vocabulary. A bit map of its hashes, of bounded size,
goes to all tasks and lets only those pass that may be: the neighbours of a vocabulary that the map can tell apart are
dropped before the shuffle. For a vocabulary beyond its bound it tells less apart and drops fewer, never a true one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forget, of_worker, slices, stored, text_rows

SHORTEST, LEAST, RATIO, DAMAGED = 7, 2, 10, 31
#: Words of one batch of neighbourhoods, each of about 2 * length * symbols rows, and of one task.
WORDS, TASK_WORDS = 2000, 20_000
#: Bits of the map of hashes: 16 for each word, within these bounds (16 MB at most).
FEWEST_BITS, MOST_BITS = 1 << 16, 1 << 27
_LOWER = {c: c + 32 for c in range(65, 91)}
_BASE = 0x9E3779B97F4A7C15


def _seen(doc: int | None, text: str, runs, shortest: int) -> Counter:
    """The words of a text: its runs, lower-cased, some of them without one letter."""
    out: Counter = Counter()
    for run, n in Counter(runs(text.translate(_LOWER))).items():
        h = crc32(f"{'' if doc is None else doc}:{run}".encode())
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= shortest:
            out[run] += n
    return out


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, n: the words of at least shortest letters that occur least times or more. Tasks count the words of a slice of
    texts first, and their slices, before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_worker(("spelling",), dict)  # nothing is kept here: the last operator's cache goes
        runs = re.compile(f"[A-Za-z\\u00C0-\\u00FF]{{{shortest},}}").findall
        for part in chain.from_iterable(map(slices, batches)):
            seen: Counter = Counter()
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                seen.update(_seen(doc, text, runs, shortest))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return text_rows(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def symbols(words: int) -> int:
    """Symbols of the reduced alphabet for a vocabulary of that many words."""
    return max(4, round(words ** (1 / SHORTEST)) + 3)


def reduced(words: list[str], r: int) -> np.ndarray:
    """The symbols of words of one length, a row each."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(np.uint64)
    return ((letters * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) >> np.uint64(7)) % np.uint64(r) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.array([1] + [_BASE] * (n - 1), dtype=np.uint64))


def _hashes(s: np.ndarray, power: np.ndarray) -> np.ndarray:
    return (s * power[: s.shape[1]]).sum(axis=1, dtype=np.uint64)


def neighbourhood(s: np.ndarray, r: int) -> Iterator[np.ndarray]:
    """Hashes of the reduced words themselves and of all words one edit from them, a column of them at a time; rows as in s.
    The hash is the sum of symbol times a power by place, so that an edit changes two sums of it."""
    n, length = s.shape
    power = _powers(length + 2)
    upto = np.concatenate([np.zeros((n, 1), dtype=np.uint64), np.cumsum(s * power[:length], axis=1, dtype=np.uint64)], axis=1)
    down = np.concatenate([np.zeros((n, 1), dtype=np.uint64), np.cumsum(s[:, 1:] * power[: length - 1], axis=1, dtype=np.uint64)], axis=1)
    right = np.concatenate([np.zeros((n, 1), dtype=np.uint64), np.cumsum(s * power[1 : length + 1], axis=1, dtype=np.uint64)], axis=1)
    whole = upto[:, -1]
    yield whole
    for i in range(length):  # one symbol less; of equal neighbours one stands for all
        without = upto[:, i] + down[:, -1] - down[:, i]
        yield without if i == 0 else np.where(s[:, i] == s[:, i - 1], whole, without)
    for i in range(length):  # one symbol replaced
        for c in range(1, r):
            yield whole + ((s[:, i] - np.uint64(1) + np.uint64(c)) % np.uint64(r) - (s[:, i] - np.uint64(1))) * power[i]
    for i in range(length + 1):  # one symbol more, before place i; not one equal to that before it, which gives the same word
        for c in range(1, r + 1):
            more = upto[:, i] + power[i : i + 1] * np.uint64(c) + right[:, -1] - right[:, i]
            yield more if i == 0 else np.where(s[:, i - 1] == c, whole, more)


def _spots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in a map of bits."""
    mixed = keys * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(36)) & np.uint64(bits - 1), (mixed >> np.uint64(8)) & np.uint64(bits - 1)


def _by_length(batches: Iterator[pa.RecordBatch], r: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Words of one length, their row numbers in their batch, and their symbols."""
    for batch in batches:
        for at in range(0, batch.num_rows, WORDS):
            part = batch.slice(at, WORDS)
            names = part.column(0).to_pylist()
            size = np.array([len(w) for w in names])
            for length in np.unique(size):
                rows = np.flatnonzero(size == length)
                yield part, rows, reduced([names[i] for i in rows], r)


def hash_map(words: DataFrame, r: int, bits: int) -> np.ndarray:
    """A map of bits with those of the hashes of all reduced words set. Each task hands on its own; a few tasks put them
    together, and one of them what those made, so the driver gets one."""

    def joined(maps: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bits // 8, dtype=np.uint8)
        for m in maps:
            total |= m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["bits"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits, dtype=bool)
        for _, _, s in _by_length(batches, r):
            for spot in _spots(_hashes(s, _powers(s.shape[1])), bits):
                flags[spot] = True
        yield from joined(iter([np.packbits(flags, bitorder="little")]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from joined(np.frombuffer(b.column(0)[i].as_py(), dtype=np.uint8) for b in batches for i in range(b.num_rows))

    maps = words.select("word").mapInArrow(own, "bits binary")
    for tasks in (8, 1):
        maps = maps.repartition(tasks).mapInArrow(merge, "bits binary")
    return np.frombuffer(maps.first().bits, dtype=np.uint8)


def _keys(words: DataFrame, r: int) -> DataFrame:
    """key, word, n: the hash of each reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, s in _by_length(batches, r):
            key = _hashes(s, _powers(s.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *part.take(pa.array(rows)).columns], names=["key", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long")


def _keys_around(words: DataFrame, r: int, bits: int) -> DataFrame:
    """key, word, n: each hash of the neighbourhood of each reduced word that the map of hashes lets pass, once."""
    known = words.sparkSession.sparkContext.broadcast(hash_map(words, r, bits))  # MOST_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = known.value
        for part, rows, s in _by_length(batches, r):
            found = [(np.flatnonzero(_pass(flags, k, bits)), k) for k in neighbourhood(s, r)]
            own, key = np.concatenate([i for i, _ in found]), np.concatenate([k[i] for i, k in found])
            order = np.lexsort((key, own))
            own, key = own[order], key[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
            taken = part.take(pa.array(rows[own[new]]))
            yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), *taken.columns], names=["key", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long")


def _pass(flags: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(keys), dtype=bool)
    for spot in _spots(keys, bits):
        out &= (flags[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def one_edit(a: Column, b: Column) -> Column:
    """Whether exactly one inserted, deleted or replaced code point makes a of b."""
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b) == 1)


def near_words(words: DataFrame, r: int | None = None, bits: int | None = None) -> DataFrame:
    """word, n, other, other_n for each two near words of a stored vocabulary, both ways. The neighbourhoods can be many times
    the vocabulary, which Spark doesn't foresee: both are dealt by key, and the vocabulary's part is the one hashed."""
    size = words.count()
    r, bits = r or symbols(size), bits or min(max(1 << (16 * size).bit_length(), FEWEST_BITS), MOST_BITS)
    there = _keys(words, r).select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    spread = words.repartition(max(1, -(-size // TASK_WORDS)))  # few files hold many words
    return _keys_around(spread, r, bits).join(there.hint("shuffle_hash"), "key").where(one_edit(F.col("word"), F.col("other"))).drop("key")


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form), a stored table of the words that have a form -> word, root: the end of each chain. A form has at
    least RATIO times its word's count, so chains are short; each round halves what is left of them."""
    now, left = forms.select("word", F.col("form").alias("root")), 1
    while left:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        new = stored(now.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        left = new.where("moved").count()
        forget(now)
        now = new.select("word", "root")
        now._stored_at = new._stored_at
    return now


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, r: int | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of the vocabulary.

    Null and empty texts have no words; a null doc_id counts as an empty one; repeated rows count each. Of near words with
    equal counts the smallest by code points is the form. Other columns are ignored; an empty table gives an empty one."""
    words = stored(vocabulary(docs, shortest, least), "vocabulary")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    near = near_words(words, r).groupBy("word").agg(F.count("*").alias("n_near"), best)
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    large = F.col("form_n") >= ratio * F.col("n")
    known = stored(known.select("word", "n", "n_near", F.when(large, F.col("form")).alias("form"), F.when(large, F.col("form_n")).alias("form_n")), "forms")
    ends = roots(stored(known.where("form is not null").select("word", "form"), "chains"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))
