"""A cache of answers as a table: keys, exact and semantic lookup, storing, expiry, caps, replay, statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.policy import RECORD, UNIT
from ..streaming.state import HOT_ROWS, by_parts
from .similar import best_of_cell
from .storage import latest_before, numbered, one_before, stored

KEY = ["partition", "model", "prompt", "temperature", "max_tokens"]
TTL, PER_PARTITION, TOTAL, SIMILAR = 3600, 200, 1000, 0.95
#: Words that say nothing of what a prompt is about.
FUNCTION_WORDS = (
    "was wie warum wieso weshalb wer wen wem wann wo woher wohin welche welcher welches welchen welchem bitte erklaere erkläre erklaer erklär "
    "nenne nenn zeige zeig gib sage sag schreibe schreib fasse fass liste beschreibe beschreib vergleiche vergleich kann kannst koennen können "
    "koennte könnte soll sollst ist sind war waren hat haben gibt der die das den dem des ein eine einer eines einem einen und oder aber auch "
    "nicht kein keine ich du er sie es wir ihr mir mich dir dich uns euch man in an auf fuer für mit von zu bei aus ueber über unter nach vor "
    "ohne durch what how why who whom when where which please explain tell show give describe list write summarize summarise compare can could "
    "would should do does did have has is are were be the a and or but not no i you he she it we they me us them on at for with from to by about of"
).split()
TERMS = r"\[[A-Za-z]+-\d+\]|\p{L}*\d[\p{L}\d]*|\p{Lu}\p{L}+"


def prompt(messages: Column) -> Column:
    """The key's text of an array of (role, content)."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(UNIT), m["content"])), RECORD)


def signature(text: Column) -> Column:
    """What a prompt is about: its placeholders, terms with a digit and capitalized words, as a sorted set."""
    terms = F.transform(F.regexp_extract_all(text, F.lit(TERMS), F.lit(0)), F.lower)
    return F.array_sort(F.array_distinct(F.filter(terms, lambda t: ~t.isin(*FUNCTION_WORDS))))


def alive(stored_at: Column, now: Column, ttl: int = TTL) -> Column:
    """An entry lives while its age is at most ttl; ttl 0 is for ever."""
    return F.lit(True) if ttl == 0 else (F.unix_micros(now) - F.unix_micros(stored_at)) <= ttl * 1_000_000


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of different or no length, or of norm 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms)


def _same_key(a: str, b: str) -> Column:
    plain = [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in ("partition", "model", "prompt")]
    return plain[0] & plain[1] & plain[2] & F.col(f"{a}.temperature").eqNullSafe(F.col(f"{b}.temperature")) & F.col(f"{a}.max_tokens").eqNullSafe(F.col(f"{b}.max_tokens"))


def _whole_key(rows: DataFrame) -> DataFrame:
    """rows with _key, the five parts as one text: two keys are equal exactly if their texts are."""
    return rows.withColumn("_key", F.to_json(F.array(*[F.col(c).cast("string") for c in KEY]), {"ignoreNullFields": "false"}))


def exact(lookups: DataFrame, entries: DataFrame, ttl: int = TTL) -> DataFrame:
    """lookups with response and kind 'exact' where the cache holds a living entry of the whole key at that time; else null.

    A key's last entry before or at the lookup is the one that the cache holds; it must not be older than ttl. Entries
    and lookups pass together in the order of time, so no pair of them is made, and a key that is asked very often is
    spread over many tasks. Of entries of one time the larger response stands."""
    none = F.lit(None).cast("struct<stored_at:timestamp,response:string>")
    e = _whole_key(entries).select("_key", F.col("stored_at").alias("_at"), F.lit(0).alias("_turn"), F.col("response").alias("_tie"), F.struct("stored_at", "response").alias("_held"), F.lit(None).cast("long").alias("lookup_id"))
    q = _whole_key(lookups).select("_key", F.col("ts").alias("_at"), F.lit(1).alias("_turn"), F.lit("").alias("_tie"), none.alias("_held"), F.col("lookup_id").cast("long").alias("lookup_id"))
    held = latest_before(e.unionByName(q), ["_key"], ["_at", "_turn", "_tie", "lookup_id"], "_held").where("_turn = 1")
    found = held.where(alive(F.col("_held.stored_at"), F.col("_at"), ttl)).select("lookup_id", F.col("_held.response").alias("response"))
    return lookups.drop("response", "kind").join(found, "lookup_id", "left").withColumn("kind", F.when(F.col("response").isNotNull(), "exact"))


def versions(entries: DataFrame) -> DataFrame:
    """entries with until: when the next one of the same key was stored, null for a key's last. Of entries of one time the
    one with the larger id is the later."""
    n = Window.partitionBy("_key").orderBy("stored_at", "entry_id")
    return _whole_key(entries).withColumn("until", F.lead("stored_at").over(n)).drop("_key")


#: Rows of a block's lookups or entries in one cell, and pairs of a block up to which they meet in a plain join.
CHUNK, FEW = 8192, 1 << 16


def semantic(misses: DataFrame, entries: DataFrame, threshold: float = SIMILAR, ttl: int = TTL, chunk: int = CHUNK, itself: bool = True, few: int = FEW) -> DataFrame:
    """(lookup_id, response, score, entry_id) of the best entry of the same partition, model and signature that the cache
    holds at that time and whose vector is similar enough: the highest score, then the newest, then the smallest
    entry_id. entries with until (as of versions()) count until then; without it each is its own key's only one.

    Signatures are compared whole. Blocks with the same signature (the empty one above all) can be large: those of more than few
    pairs are cut into cells, chunk lookups by chunk entries each, whose vectors meet as matrices, and only the best of each
    cell goes on; the others meet in a join. Vectors are brought to length 1 before they meet. Without itself, the entry whose
    id is the lookup's is passed over."""
    block = ["partition", "model", "signature"]
    rows = lambda t: t.where(F.forall("embedding", lambda x: x.isNotNull())).withColumn("_b", F.xxhash64(*block))
    until = F.coalesce(F.unix_micros("until"), F.lit((1 << 63) - 1)) if "until" in entries.columns else F.lit((1 << 63) - 1)
    q = rows(misses).select("lookup_id", *block, "_b", "embedding", F.unix_micros("ts").alias("_t")).where("_t is not null")
    fresh = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  lookups and entries may be one table
    e = rows(entries).select(*fresh("entry_id", *block, "_b", "embedding", "response"), F.unix_micros("stored_at").alias("_at"), until.alias("_until")).where("_at is not null")
    count = lambda t, name: t.groupBy("_b").agg(F.count("*").alias(name))
    # a row for each large block, of which there are at most a few hundredths as many as rows
    large = F.broadcast(stored(count(q, "_i").join(count(e, "_j"), "_b").where(F.col("_i") * F.col("_j") > few).select("_b", F.ceil(F.col("_i") / chunk).alias("_i"), F.ceil(F.col("_j") / chunk).alias("_j")), "blocks"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda key, c: F.pmod(F.xxhash64(key), F.col(c))
    cell = [*block, "_i", "_j"]
    in_cells = q.join(large, "_b").withColumn("_i", own("lookup_id", "_i")).withColumn("_j", every("_j")).drop("_b").groupBy(*cell)
    out = misses.select("lookup_id").schema.fields + entries.select("response").schema.fields + [T.StructField("score", T.DoubleType())] + entries.select("entry_id").schema.fields + [T.StructField("_at", T.LongType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out])
    of_cells = in_cells.cogroup(e.join(large, "_b").withColumn("_j", own("entry_id", "_j")).withColumn("_i", every("_i")).drop("_b").groupBy(*cell))
    met = of_cells.applyInArrow(best_of_cell(threshold, ttl, itself, to_arrow_schema(schema)), schema)

    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = lambda t: t.join(large, "_b", "left_anti").withColumn("_n", norm).where("_n > 0").withColumn("_v", F.transform("embedding", lambda x: x.cast("double") / F.col("_n")))
    side = lambda t, p: t.select(*[F.col(c).alias(p + c) for c in t.columns])
    same = (F.col("q_b") == F.col("e_b")) & (F.col("qpartition") == F.col("epartition")) & (F.col("qmodel") == F.col("emodel")) & (F.col("qsignature") == F.col("esignature"))
    if not itself:
        same = same & (F.col("qlookup_id") != F.col("eentry_id"))
    held = (F.col("e_at") <= F.col("q_t")) & (F.col("e_until") > F.col("q_t")) & (F.lit(ttl == 0) | (F.col("q_t") - F.col("e_at") <= ttl * 1_000_000))
    score = F.when(F.size("q_v") == F.size("e_v"), F.aggregate(F.zip_with("q_v", "e_v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x))
    pairs = side(unit(q), "q").join(side(unit(e), "e"), same & held).withColumn("score", score).where((F.col("score") >= threshold) & ~F.isnan("score"))
    met = met.unionByName(pairs.select(F.col("qlookup_id").alias("lookup_id"), F.col("eresponse").alias("response"), "score", F.col("eentry_id").alias("entry_id"), F.col("e_at").alias("_at")))
    rank = F.struct("score", "_at", (-F.col("entry_id")).alias("back"))
    return met.groupBy("lookup_id").agg(F.max_by(F.struct("response", "score", "entry_id"), rank).alias("b")).select("lookup_id", "b.*")


def looked_up(lookups: DataFrame, entries: DataFrame, threshold: float = SIMILAR, ttl: int = TTL, itself: bool = True) -> DataFrame:
    """lookups with kind exact, semantic or miss, and the masked response."""
    first = stored(exact(lookups, entries, ttl), "exact")
    close = semantic(first.where("kind is null").drop("response", "kind"), stored(versions(entries), "versions"), threshold, ttl, itself=itself).select("lookup_id", F.col("response").alias("_near"))
    out = first.join(close, "lookup_id", "left")
    return out.withColumn("kind", F.coalesce("kind", F.when(F.col("_near").isNotNull(), "semantic"), F.lit("miss"))).withColumn("response", F.coalesce("response", "_near")).drop("_near")


def stores(results: DataFrame, enabled: bool = True) -> DataFrame:
    """New entries of lookups that missed, may be cached, succeeded and have an answer."""
    return results.where(F.lit(enabled) & (F.col("kind") == "miss") & F.col("cacheable") & F.col("ok") & (F.col("answer") != ""))


def appended(entries: DataFrame, fresh: DataFrame) -> DataFrame:
    """entries with fresh ones; an entry with the same key is replaced."""
    f, e = fresh.select(*KEY).distinct().alias("f"), entries.alias("e")
    return e.join(f, _same_key("e", "f"), "left_anti").unionByName(fresh.select(*entries.columns))


def expired(entries: DataFrame, now: Column, ttl: int = TTL) -> DataFrame:
    return entries.where(alive(F.col("stored_at"), now, ttl))


def capped(entries: DataFrame, per_partition: int = PER_PARTITION, total: int = TOTAL) -> DataFrame:
    """The most recently used entries of each partition (0: no cap), then of all (0: none at all)."""
    out = entries
    if per_partition:
        n = F.row_number().over(Window.partitionBy("partition").orderBy(F.desc("last_used"), "entry_id"))
        out = out.withColumn("_n", n).where(F.col("_n") <= per_partition).drop("_n")
    return out.orderBy(F.desc("last_used"), "entry_id").limit(total)


def restored(snapshot: DataFrame, now: Column, ttl: int = TTL, total: int = TOTAL) -> DataFrame:
    """A snapshot's living entries under the cap of the whole; the cap of partitions isn't applied on restore."""
    return capped(expired(snapshot, now, ttl), 0, total)


def without(entries: DataFrame, left: DataFrame) -> DataFrame:
    """The entries that aren't left, by entry_id."""
    return entries.join(left.select("entry_id"), "entry_id", "left_anti")


def invalidated(entries: DataFrame, partition: str | None = None, model: str | None = None) -> DataFrame:
    """entries without those of a partition, a model, or both together."""
    gone = F.lit(partition is not None or model is not None)
    if partition is not None:
        gone = gone & (F.col("partition") == partition)
    if model is not None:
        gone = gone & (F.col("model") == model)
    return entries.where(~gone)


def replayed(log: DataFrame, ttl: int = TTL, hot_rows: int = HOT_ROWS) -> DataFrame:
    """log (key, ts, event_id) -> key, event_id, kind: a request is a hit while the entry lives that the last miss
    stored; a hit doesn't lengthen its life, the first request after it stores anew. Each key's times pass one after
    the other; only the time of the last store is held. A hot key's log is cut where nothing was asked for longer than an
    entry lives (with ttl 0 nothing ends, and nothing is cut)."""

    def fold(at, row):
        if at is not None and (ttl == 0 or row[1] - at <= ttl * 1_000_000):
            return at, (row[0], row[2], "exact")
        return row[1], (row[0], row[2], "miss")

    rows = log.select("key", F.unix_micros("ts").alias("at"), "event_id")
    fresh = lambda before: F.lit(ttl != 0) & (F.col("at") - before > ttl * 1_000_000)
    return by_parts(rows, "key", ["at", "event_id"], fold, "key string, event_id long, kind string", fresh, "at", hot_rows)


#: Uses of one task in counting reuse distances.
BLOCK = 1 << 16


def _earlier(values: list[int], groups: list[int]) -> list[int]:
    """For each place how many places of smaller groups have a value that isn't larger; groups don't decrease. By a tree of
    counts over the values."""
    rank = {v: k for k, v in enumerate(sorted(set(values)), 1)}
    at, tree, out, waiting, now = [rank[v] for v in values], [0] * (len(rank) + 1), [], [], None
    for k, g in zip(at, groups):
        if g != now:
            for w in waiting:
                while w < len(tree):
                    tree[w] += 1
                    w += w & -w
            waiting, now = [], g
        waiting.append(k)
        n = 0
        while k:
            n += tree[k]
            k -= k & -k
        out.append(n)
    return out


def reuse_distances(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """log (partition, key, ts, event_id) -> partition, key, event_id, distance: how many other keys of the partition were used since
    the key's last use; null for its first.

    With uses numbered by time and p the number of a use's last one, the other keys since then are the earlier uses whose
    own p isn't larger, less p. Numbers are cut into blocks, and so are the values of p, which differ but for first uses. A task
    counts within a block of uses, another within a block of values; between other blocks their sizes say it. So no task
    holds more than a block, however many uses a partition has."""
    uses = numbered(log.select("partition", "key", "ts", "event_id"), ["partition"], ["ts", "event_id"], "i")
    uses = one_before(uses, ["partition", "key"], ["i"], "i", "p").withColumn("first", F.col("p").isNull()).withColumn("p", F.coalesce("p", F.lit(0)))
    cut = lambda c: F.floor((F.col(c) - 1) / block).cast("long")  # noqa: E731  first uses are block -1 of the values
    uses = stored(uses.select("partition", "key", "event_id", "first", "i", "p", cut("i").alias("b"), cut("p").alias("c")), "uses")

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        return pd.DataFrame({"partition": rows["partition"], "i": rows["i"], "n": _earlier(rows["p"].tolist(), rows["i"].tolist())})

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        return pd.DataFrame({"partition": rows["partition"], "i": rows["i"], "n": _earlier(rows["p"].tolist(), rows["b"].tolist())})

    place = uses.select("partition", "i", "p", "b", "c")
    near = place.groupBy("partition", "b").applyInPandas(within, "partition string, i long, n long")
    same = place.where("c >= 0").groupBy("partition", "c").applyInPandas(across, "partition string, i long, n long")
    counted = near.unionByName(same).groupBy("partition", "i").agg(F.sum("n").alias("n"))
    blocks = uses.groupBy("partition").agg(F.max("b").alias("last")).select("partition", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("b"))
    cells = blocks.select("partition", "b", F.explode(F.sequence(F.lit(-1).cast("long"), "last")).alias("c"))
    sizes = cells.join(uses.groupBy("partition", "b", "c").agg(F.count("*").alias("n")), ["partition", "b", "c"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = lambda by, over: Window.partitionBy("partition", by).orderBy(over).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("n", F.coalesce(F.sum("n").over(before("c", "b")), F.lit(0))).withColumn("coarse", F.coalesce(F.sum("n").over(before("b", "c")), F.lit(0))).drop("n")
    rows = uses.join(counted, ["partition", "i"]).join(sizes, ["partition", "b", "c"])
    return rows.select("partition", "key", "event_id", F.when(~F.col("first"), F.col("n") + F.col("coarse") - F.col("p")).alias("distance"))


def capped_replay(log: DataFrame, per_partition: int = PER_PARTITION, block: int = BLOCK) -> DataFrame:
    """log (partition, key, ts, event_id) through a cache that keeps each partition's per_partition most recently used keys (0: all)
    -> partition, key, event_id, kind. A request is a hit if fewer other keys were used since the key's last use; a miss stores."""
    hit = F.col("distance").isNotNull() & (F.lit(per_partition == 0) | (F.col("distance") < per_partition))
    return reuse_distances(log, block).select("partition", "key", "event_id", F.when(hit, "exact").otherwise("miss").alias("kind"))


def replay_statistics(replay: DataFrame, per_partition: int = PER_PARTITION) -> DataFrame:
    """partition, lookups, exact_hits, misses, stores, evictions, entries, hit_rate of a replay under a cap: every miss stores, and what
    was stored and isn't there at the end was evicted."""
    keys = replay.select("partition", "key").distinct().groupBy("partition").agg(F.count("*").alias("keys"))
    entries = F.col("keys") if per_partition == 0 else F.least("keys", F.lit(per_partition).cast("long"))
    by = replay.groupBy("partition").agg(F.count("*").alias("lookups"), F.count_if(F.col("kind") == "exact").alias("exact_hits"), F.count_if(F.col("kind") == "miss").alias("misses")).join(keys, "partition")
    return by.select("partition", "lookups", "exact_hits", "misses", F.col("misses").alias("stores"), (F.col("misses") - entries).alias("evictions"), entries.alias("entries"), (F.col("exact_hits") / F.col("lookups")).alias("hit_rate"))


def statistics(results: DataFrame, stored_: DataFrame | None = None, expired_: DataFrame | None = None, evicted: DataFrame | None = None, invalidated_: DataFrame | None = None) -> DataFrame:
    """One row of counts: lookups by kind, and the entries that were stored, expired, evicted and invalidated, from tables of
    them; the rate is null without lookups. All are counted in one aggregate."""
    tagged = lambda rows, tag: rows.select(F.lit(tag).alias("kind"))
    all_ = results.select("kind")
    for rows, tag in ((stored_, "store"), (expired_, "expiration"), (evicted, "eviction"), (invalidated_, "invalidation")):
        if rows is not None:
            all_ = all_.unionByName(tagged(rows, tag))
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    lookups, hits = count("exact", "semantic", "miss"), count("exact", "semantic")
    return all_.agg(
        lookups.alias("lookups"), count("exact").alias("exact_hits"), count("semantic").alias("semantic_hits"), count("miss").alias("misses"), count("store").alias("stores"),
        count("eviction").alias("evictions"), count("expiration").alias("expirations"), count("invalidation").alias("invalidations"), F.when(lookups > 0, hits / lookups).alias("hit_rate"),
    )


def per_partition(entries: DataFrame) -> DataFrame:
    return entries.groupBy("partition").agg(F.count("*").alias("entries"))
