"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014), and joins
with keys that a large share of the rows may have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

#: Keys that a spread join may broadcast, at most: those with more than that fraction of the rows, and LIGHT at least.
HEAVY_KEYS, LIGHT = 1000, 64


def spread_join(rows: DataFrame, by_key: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows (total of them at most) joined with by_key, a stored table of different keys with n, the number of rows of each.

    Keys with more than total / HEAVY_KEYS rows are fewer than HEAVY_KEYS at any size: they are broadcast, so that a
    key's rows stay where they are, in many tasks. All other keys meet by a shuffle, a small share of the rows each. Which
    keys are broadcast is told by their hashes, which the driver gets: a key of the same hash goes with them."""
    own = F.xxhash64(*keys)
    hot = [r[0] for r in by_key.where(F.col("n") > max(LIGHT, total // HEAVY_KEYS)).select(own).collect()]
    if not hot:
        return rows.join(by_key, keys)
    with_hot, others = rows.where(own.isin(hot)), rows.where(~own.isin(hot))
    return with_hot.join(F.broadcast(by_key.where(own.isin(hot))), keys).unionByName(others.join(by_key.where(~own.isin(hot)), keys))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node hands its larger neighbours its smallest neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), "low")
    moved = spread_join(both.where("v > u"), low, ["u"], 2 * total)
    out = stored(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "edges")
    forget(low)
    return out


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of them. Edges come as u > v."""
    low = stored(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
    moved = spread_join(edges, low, ["u"], total).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = stored(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    forget(low, edges)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs, any direction, loops and repeats allowed -> (node, root), root the smallest node of
    its component. Nodes without an edge don't appear. Each round writes its edges to the shared folder, so
    lineage stays short; rounds grow with the logarithm of the longest chain. No task gets all edges of a hub."""
    now = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    total, state = now.count(), None
    while total:
        new = _small_star(_large_star(now, total), total)
        row = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(now)
        now, total = new, row[0]
        if tuple(row) == state:
            break
        state = tuple(row)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def assigned(marks: DataFrame, firsts: DataFrame, groups: DataFrame) -> DataFrame:
    """marks (fp, ...) with component_id, the smallest doc_id of their component. firsts: a stored row for each fp with its
    smallest doc_id (first) and rows (n); groups: (node, root) of the fps that have links. Neither a text with many
    copies nor a component with many texts is one task's."""
    different, total = firsts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    grouped = stored(firsts.select("fp", "first").join(groups.select(F.col("node").alias("fp"), "root"), "fp"), "grouped")
    lowest = stored(grouped.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "lowest")
    placed = spread_join(grouped.select("fp", "root"), lowest, ["root"], different).select("fp", "component_id")
    known = stored(firsts.join(placed, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id")), "components")
    forget(grouped, lowest)
    return spread_join(marks, known, ["fp"], total).drop("n")
