"""Near copies by Jaccard similarity: SimHash and MinHash bands propose pairs, the whole sets of 5-word shingles decide.

Each set has a SimHash fingerprint. Its blocks propose, as in simhash.py, the pairs that differ in at most 4 bits. At
similarity 0.8 fingerprints differ in about 10 bits of 64, and up to 18: blocks that find those pairs are too short to
select anything. So bands of minima propose the others: a band of 5 agrees for similarity s with probability s^5, so of
24 bands one or more agree for 0.99993 of the pairs at 0.8 and for more above. No pair links on its fingerprints or its
bands alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, map_batches, of_worker, release, slices, stored, text_rows
from .graph import assigned, connected_components, spread_join
from .simhash import links, majority

WIDTH, BANDS, ROWS = 5, 24, 5
#: Texts of one group that one task compares at a time. Larger groups are dealt out in parts.
PART = 128
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The set of width-word shingles as sorted hashes; a shorter text is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    hashes = [digest(joined[s:e]) for s, e in zip(starts, ends[width - 1 :])] or [digest(joined)]
    return np.unique(np.array(hashes, dtype=np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """The key of each band of minima, signed; none for the empty set."""
    if not len(found):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(found), 2048):
        low = np.minimum(low, (found[k : k + 2048, None] * _TIMES + _PLUS).min(axis=0))
    keys = [xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of at least 0.8."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 5 * shared >= 4 * (len(both) - shared)


def _marks(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fp, sim, keys): fp is equal for equal sets of shingles, sim is the set's SimHash fingerprint."""

    def make(ids: list, texts: list) -> dict:
        of_worker(("near copies",), dict)  # nothing is kept here: the last operator's cache goes
        sets = [shingles(t) for t in texts]
        fps = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
        sims = np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)
        return {"doc_id": ids, "text": texts, "fp": fps, "sim": sims, "keys": [bands(s) for s in sets]}

    return map_batches(text_rows(docs), make, "doc_id long, text string, fp long, sim long, keys array<long>")


def _grouped(rows: DataFrame, compare: Callable[[list, list, list], list]) -> DataFrame:
    """rows (g, p, q, fp, tag, text): compare gets the fps, tags and sets of each group and returns its edges (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, ([], [], [])

        def batch(edges: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for part in chain.from_iterable(map(slices, batches)):
            edges = []
            for g, p, q, fp, tag, text in zip(*[c.to_pylist() for c in part.columns]):
                if (g, p, q) != group:
                    edges += compare(*held)
                    group, held = (g, p, q), ([], [], [])
                for column, value in zip(held, (fp, tag, shingles(text))):
                    column.append(value)
            yield batch(edges)
        yield batch(compare(*held))
        release()

    dealt = rows.select("g", "p", "q", "fp", "tag", "text").repartition("g", "p", "q").sortWithinPartitions("g", "p", "q", F.desc("tag"))
    return dealt.mapInArrow(run, "u long, v long")


def _to_first(fps: list, tags: list, sets: list) -> list:
    return [(fps[0], fp) for fp, s in zip(fps[1:], sets[1:]) if similar(sets[0], s)]


def _across(fps: list, tags: list, sets: list) -> list:
    """Edges that join members with different tags, no more than connect them."""
    tags, sizes, edges = np.array(tags), np.array([len(s) for s in sets]), []
    for i in range(len(fps)):
        for j in np.flatnonzero((tags != tags[i]) & (5 * sizes >= 4 * sizes[i]) & (4 * sizes <= 5 * sizes[i])):
            if j > i and tags[j] != tags[i] and similar(sets[i], sets[j]):
                edges.append((fps[i], fps[j]))
                tags[tags == tags[j]] = tags[i]
    return edges


def _dealt(n: Column) -> tuple[Column, Column]:
    """Number of parts of a group of n, and the part of this row's fp."""
    parts = F.ceil(n / PART).cast("int")
    return parts, F.pmod(F.xxhash64("fp"), parts).cast("int")


def _close(firsts: DataFrame) -> DataFrame:
    """(low, fp): sets with one fingerprint, each with the smallest of them, and the smallest of each two fingerprints that SimHash
    links."""
    sims = stored(firsts.groupBy("sim").agg(F.min("fp").alias("low"), F.count("*").alias("n")), "fingerprints")
    same = spread_join(firsts.select("fp", "sim"), sims, ["sim"], firsts.count()).where("fp != low").select("low", "fp")
    ends = stored(links(sims.select(F.col("sim").alias("fp"))).distinct(), "fingerprint-links")
    low = lambda end, name: sims.select(F.col("sim").alias(end), F.col("low").alias(name))
    return same.union(ends.join(low("u", "a"), "u").join(low("v", "b"), "v").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("fp")))


def _hub_edges(shared: DataFrame, close: DataFrame, texts: DataFrame) -> DataFrame:
    """Each member of a band's group is compared to the group's smallest, and the two of each close pair, once for each such pair."""
    pairs = shared.where("fp != low").select(F.col("low").alias("g"), "fp").union(close.select("low", "fp"))
    pairs = stored(pairs.distinct(), "pairs")
    sizes = stored(pairs.groupBy("g").agg(F.count("*").alias("n")), "pair-sizes")
    parts, mine = _dealt(F.col("n"))
    others = spread_join(pairs, sizes, ["g"], pairs.count()).select("g", mine.alias("p"), "fp", F.lit(0).cast("long").alias("tag"))
    leads = sizes.select("g", F.explode(F.sequence(F.lit(0), parts - 1)).alias("p"), F.col("g").alias("fp"), F.lit(1).cast("long").alias("tag"))
    return _grouped(others.union(leads).withColumn("q", F.lit(0)).join(texts, "fp"), _to_first)


def _rest_edges(shared: DataFrame, texts: DataFrame, roots: DataFrame, total: int) -> DataFrame:
    """All other pairs of the groups that the first comparison left in more than one component; pairs of one component
    are passed over, and of groups with the same members one is taken."""
    rooted = shared.where("n > 2").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    mixed = rooted.groupBy("g").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("same"), F.bit_xor("fp").alias("x"))
    mixed = stored(mixed.where("a != b").groupBy("n", "same", "x").agg(F.min("g").alias("g")).select("g", "n"), "mixed")
    parts, mine = _dealt(F.col("n"))
    members = spread_join(rooted.drop("n"), mixed, ["g"], total).withColumns({"parts": parts, "mine": mine})
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("p"), F.greatest(o, F.col("mine")).alias("q")))
    rows = members.select("g", F.explode(pairs).alias("o"), "fp", F.col("root").alias("tag")).select("g", "o.p", "o.q", "fp", "tag")
    return _grouped(rows.join(texts, "fp"), _across)


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, component_id (the smallest doc_id that links of similarity 0.8 or more reach).

    Texts with equal shingles are one component, those without words another. Repeated rows each get a row. A component
    whose doc_ids are all null has component_id null. An empty table gives an empty one."""
    marks = stored(_marks(docs), "marks")
    firsts = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("sim").alias("sim"), F.first("keys").alias("keys")), "distinct-sets")
    keys = firsts.select("fp", F.explode("keys").alias("g"))
    sizes = stored(keys.groupBy("g").agg(F.count("*").alias("n"), F.min("fp").alias("low")).where("n > 1"), "band-sizes")
    different, rows = firsts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total = BANDS * different
    shared = stored(spread_join(keys, sizes, ["g"], total).select("g", "fp", "n", "low"), "shared-bands")
    close = stored(_close(firsts), "close")
    compared = shared.select("fp").union(close.select("fp")).union(close.select("low")).distinct()
    wanted = stored(firsts.select("fp", "n").join(compared, "fp", "left_semi"), "wanted")
    texts = stored(spread_join(marks.select("fp", "text"), wanted, ["fp"], rows).select("fp", "text").dropDuplicates(["fp"]), "texts")
    roots = stored(connected_components(stored(_hub_edges(shared, close, texts), "hub-edges")), "roots")
    rest = stored(_rest_edges(shared, texts, roots, total), "rest-edges")
    groups = stored(connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(rest)), "groups")
    forget(sizes, shared, close, wanted, texts, roots, rest)
    return assigned(marks.select("doc_id", "fp"), firsts.select("fp", "first", "n"), groups).select("doc_id", "component_id")
