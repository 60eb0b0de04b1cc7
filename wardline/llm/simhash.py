"""Near-duplicates by SimHash: pigeonhole blocks propose pairs of fingerprints, the Hamming distance decides.

A fingerprint of 64 bits is cut into k blocks. Two fingerprints with at most d differing bits agree on at least
k - d whole blocks, so a table of keys for every choice of k - d blocks brings each such pair together under some
key. k grows with the number of different fingerprints, so that a key stays about as selective at any size; every
k finds the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored, text_rows
from .graph import assigned, connected_components, spread_join

BITS = 64
#: Fingerprints under one key that one task compares at a time. Larger groups are dealt out in pairs of parts.
PART = 1024
#: Keys with more fingerprints than that are first refined by blocks of the bits that the key leaves open.
REFINE = 16 * PART


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """SimHash over all width-word shingles, repeats included; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined, ends, at = b" ".join(words), [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends[:-1])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :])]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp as a signed long. One narrow pass over the texts."""

    def make(ids: list, texts: list) -> dict:
        fps = np.array([fingerprint(t, width, seed) for t in texts], dtype=np.uint64).view(np.int64)
        return {"doc_id": ids, "fp": fps}

    return map_batches(text_rows(docs), make, "doc_id long, fp long")


def _blocks(n: int, distance: int) -> int:
    """The least number of blocks for which a fingerprint has about two unrelated partners or fewer."""
    for k in range(distance + 1, 13):
        keys = comb(k, k - distance)
        if keys * n / 2 ** (BITS * (k - distance) / k) <= 2:
            return k
    return 12


def _masks(k: int, distance: int) -> list[int]:
    edges = [round(i * BITS / k) for i in range(k + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(k)]
    masks = [sum(c) for c in combinations(blocks, k - distance)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def _links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one key: at most one edge for each of them."""
    free, edges = np.ones(len(fps), dtype=bool), []
    for first in range(len(fps)):
        if not free[first]:
            continue
        free[first] = False
        front = [first]
        while front and free.any():
            i = front.pop()
            near = np.flatnonzero(free & (np.bitwise_count(fps ^ fps[i]) <= distance))
            free[near] = False
            front.extend(near.tolist())
            edges += [(i, j) for j in near.tolist()]
    return edges


def _runs(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (mask, key, p, q): compare the fingerprints of each run of equal keys."""

    def compare(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        n = len(cols[0])
        if n < 2:
            return None
        new = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)]))
        size = np.diff(np.append(new, n))
        fps = cols[4].view(np.uint64)
        us, vs = [], []
        short = np.repeat(size, size) <= 16
        run = np.repeat(np.arange(len(new)), size)
        for lag in range(1, min(16, int(size.max()))):
            at = np.flatnonzero((run[lag:] == run[:-lag]) & short[lag:])
            at = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= distance]
            us.append(fps[at])
            vs.append(fps[at + lag])
        for start, m in zip(new[size > 16], size[size > 16]):
            part = fps[start : start + m]
            if links := _links(part, distance):
                a, b = np.array(links).T
                us.append(part[a])
                vs.append(part[b])
        if not us:
            return None
        u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)]
        if not len(cols[0]):
            continue
        last = np.flatnonzero(np.any([c != c[-1] for c in cols[:4]], axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0  # the last run may go on in the next batch
        made = compare([c[:cut] for c in cols])
        rest = [c[cut:] for c in cols]
        if made is not None:
            yield made
    if rest is not None and (made := compare(rest)) is not None:
        yield made


def _finer(mask: int, distance: int) -> list[int]:
    """Masks of the bits outside mask: they are cut into distance + 2 blocks, and two fingerprints at most distance bits
    apart agree on two of those blocks at least."""
    left = [b for b in range(BITS) if not mask >> b & 1]
    cut = [round(i * len(left) / (distance + 2)) for i in range(distance + 3)]
    blocks = [sum(1 << b for b in left[x:y]) for x, y in zip(cut, cut[1:])]
    masks = [a | b for a, b in combinations(blocks, 2)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def _shared(keys: DataFrame, total: int) -> DataFrame:
    """keys (mask, key, fp) whose key another fingerprint has too, with n of them."""
    sizes = stored(keys.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "key-sizes")
    return spread_join(keys, sizes, ["mask", "key"], total)


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """fps (fp), all different -> edges (u, v) between fingerprints at most distance bits apart, enough of them
    to connect all that such links connect, and no more than a small multiple of the rows.

    Keys that only one fingerprint has go at once. A key with more than REFINE of them gives way to finer keys, which
    every pair of it that may link shares too. A key with more than PART is split: its fingerprints are dealt into
    parts by hash and each pair of parts is a group of its own, so no task gets an unbounded group and every pair
    still meets."""
    n = fps.count()
    masks = _masks(_blocks(n, distance), distance)
    choice = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.lit(m).alias("bits")) for i, m in enumerate(masks)]))
    keys = fps.select("fp", choice.alias("c")).select("c.mask", F.col("fp").bitwiseAND(F.col("c.bits")).alias("key"), "fp")
    shared = stored(_shared(keys, n * len(masks)), "shared-keys")
    large = shared.where(F.col("n") > REFINE)
    if (rows := large.count()) > 0:
        finer = F.array(*[F.array(*map(F.lit, _finer(m & (1 << BITS) - 1, distance))) for m in masks])
        own = large.select("mask", "key", "fp", F.posexplode(F.element_at(finer, F.col("mask") + 1)).alias("i", "bits"))
        own = own.select(((F.col("mask") + 1) * 1000 + F.col("i")).alias("mask"), F.xxhash64("key", F.col("fp").bitwiseAND(F.col("bits"))).alias("key"), "fp")
        shared = shared.where(F.col("n") <= REFINE).unionByName(_shared(stored(own, "finer-keys"), 15 * rows))
    parts = F.ceil(F.col("n") / PART).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("p"), F.greatest(o, F.col("mine")).alias("q")))
    dealt = shared.withColumn("mine", mine).select("mask", "key", F.explode(pairs).alias("g"), "fp").select("mask", "key", "g.p", "g.q", "fp")
    dealt = dealt.repartition("mask", "key", "p", "q").sortWithinPartitions("mask", "key", "p", "q")
    return dealt.mapInArrow(lambda it: _runs(it, distance), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that links of at most distance
    differing bits reach).

    Null and empty texts have fingerprint 0 and link like any other. Ties can't arise: the component is a set.
    Repeated rows each get a row. A component whose doc_ids are all null has component_id null. An empty table
    gives an empty one; other columns are ignored."""
    marks = stored(fingerprints(docs, width), "fingerprints")
    firsts = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    groups = connected_components(links(firsts.select("fp"), distance))
    return assigned(marks, firsts, groups).select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
