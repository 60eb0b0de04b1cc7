"""State kept by key: token buckets, masking sessions, chunked answers. The folds are plain Python on sorted rows; batch
jobs walk a key's rows with them in batches, streams (keyed.py) keep what they carry as state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import stored
from ..functions.forms import Forms

RATE, INTERVAL, BURST = 60, 60.0, 10
PARK_TTL, EXTENDED_TTL = 900.0, 14_400.0


def admit(state: tuple[float, float] | None, now: float, requests: int = RATE, interval: float = INTERVAL, burst: int = BURST) -> tuple[tuple[float, float], bool, float]:
    """One request on a bucket (tokens, updated): the new bucket, whether it passes, and how long to wait if not.
    Tokens flow back by elapsed time up to the burst (1 at least); a refusal costs nothing; a clock that runs
    backwards brings none."""
    size = float(max(1, burst))
    rate = requests / interval if interval > 0 else 0.0
    tokens, at = state if state is not None else (size, now)
    tokens = min(size, tokens + max(0.0, now - at) * rate)
    if tokens >= 1:
        return (tokens - 1, now), True, 0.0
    return (tokens, now), False, max(1.0, math.ceil((1 - tokens) / rate)) if rate > 0 else interval


def retry_after(tokens: Column, requests: int = RATE, interval: float = INTERVAL) -> Column:
    """Whole seconds until a bucket has a token again, 1 at least; the interval where nothing flows back."""
    if requests <= 0:
        return F.lit(float(interval))
    return F.greatest(F.lit(1.0), F.ceil((1 - tokens) * (interval / requests)).cast("double"))


def by_key(df: DataFrame, key: str | list[str], order: list[str], fold, schema: str) -> DataFrame:
    """Walk each key's rows in order with fold(state, row) -> (state, row out or None). Rows are dealt by key and sorted;
    Arrow batches pass one after the other and only the state of the key at hand is held, so a key's rows never
    stand in memory together."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    keys = [key] if isinstance(key, str) else key
    at = [df.columns.index(k) for k in keys]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            out: list[list] = [[] for _ in arrow]
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                own = [row[i] for i in at]
                if own != last:
                    last, state = own, None
                state, made = fold(state, row)
                if made is not None:
                    for column, value in zip(out, made):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(walk, schema)


#: Keys with more rows than that, and with more than a thousandth of all rows, are walked in parts.
HOT_ROWS = 10_000


def parted(df: DataFrame, key: str, order: list[str], fresh, previous: str) -> DataFrame:
    """df with _first, the place in order of the first row of the part that a row lies in. A part begins where fresh(what
    previous was in the key's row before) is true: where a walk's state doesn't depend on what went before.

    A key's rows are dealt by ranges of their order. Each range looks among its own rows; what the ranges before it end
    with, a row for each key and range, is carried on."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(ranges, key, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    own, before = Window.partitionBy(key, "_range").orderBy(*order), Window.partitionBy(key).orderBy("_range")
    place = F.struct(*order)
    ends = dealt.groupBy(key, "_range").agg(F.max_by(previous, place).alias("_end")).withColumn("_end", F.lag("_end").over(before))
    rows = dealt.join(ends, [key, "_range"]).withColumn("_before", F.coalesce(F.lag(previous).over(own), "_end"))
    rows = stored(rows.withColumn("_first", F.when(F.col("_before").isNull() | fresh(F.col("_before")), place)).drop("_before", "_end"), "firsts")
    firsts = rows.groupBy(key, "_range").agg(F.max("_first").alias("_carried"))
    firsts = firsts.withColumn("_carried", F.last("_carried", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    within = F.last("_first", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_first", within).join(firsts, [key, "_range"]).withColumn("_first", F.coalesce("_first", "_carried")).drop("_range", "_carried")


def by_parts(df: DataFrame, key: str, order: list[str], fold, schema: str, fresh, previous: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """As by_key, with the rows of hot keys walked part by part (see parted), each part by whichever task gets it. There are
    fewer than a thousand hot keys, so they can be broadcast."""
    sizes = stored(df.groupBy(key).agg(F.count("*").alias("n")), "key-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = sizes.where(F.col("n") > max(hot_rows, total // 1000)).select(key)
    if not hot.take(1):
        return by_key(df, key, order, fold, schema)
    some = parted(df.join(F.broadcast(hot), key, "left_semi"), key, order, fresh, previous)
    names = [f"_first{i}" for i in range(len(order))]
    some = some.select(*df.columns, *[F.col("_first")[c].alias(n) for c, n in zip(order, names)])
    rest = df.join(F.broadcast(hot), key, "left_anti")
    return by_key(some, [key, *names], order, fold, schema).unionByName(by_key(rest, key, order, fold, schema))


def _full_again(requests: int, interval: float, burst: int):
    """Whether a bucket is full at a time, whatever it held at the one before: not less than a burst has flown back."""
    rate = requests / interval if interval > 0 else 0.0
    return lambda before: (F.col("at") - before) * rate >= float(max(1, burst))


def _judged(log: DataFrame) -> DataFrame:
    return log.select("caller", (F.unix_micros("ts") / 1e6).alias("at"), "event_id")


def rate_limited(log: DataFrame, requests: int = RATE, interval: float = INTERVAL, burst: int = BURST, hot_rows: int = HOT_ROWS) -> DataFrame:
    """log (caller, ts, event_id) -> event_id, caller, allowed, retry_after, in the order of (ts, event_id) of each
    caller. A hot caller's log is cut where its bucket is surely full again; between two such times it is one pass in one
    task, with a state of two numbers (limit_parts says how long those are)."""

    def fold(state, row):
        state, ok, wait = admit(state, row[1], requests, interval, burst)
        return state, (row[2], row[0], ok, wait)

    schema = "event_id long, caller string, allowed boolean, retry_after double"
    return by_parts(_judged(log), "caller", ["at", "event_id"], fold, schema, _full_again(requests, interval, burst), "at", hot_rows)


def limit_parts(log: DataFrame, requests: int = RATE, interval: float = INTERVAL, burst: int = BURST) -> DataFrame:
    """caller, parts, rows, longest: in how many parts each caller's log can be walked apart, and the rows of the longest."""
    each = parted(_judged(log), "caller", ["at", "event_id"], _full_again(requests, interval, burst), "at").groupBy("caller", "_first").agg(F.count("*").alias("n"))
    return each.groupBy("caller").agg(F.count("*").alias("parts"), F.sum("n").alias("rows"), F.max("n").alias("longest"))


def session_step(state: dict | None, op: str, partition: str, size: int, now: float) -> tuple[dict | None, bool | None]:
    """One operation on the session of a correlation id: the new state and what it finds (None for those that don't
    look). Empty maps aren't parked; a fetch needs the partition and a living session and uses nothing up; a
    session is extended only while it lives."""
    living = state is not None and state["expires"] > now
    if op == "park":
        return ({"partition": partition, "expires": now + PARK_TTL} if size else state), None
    if op == "fetch":
        return state, bool(living and state["partition"] == partition)
    if op == "extend":
        return ({**state, "expires": now + EXTENDED_TTL} if living else state), None
    if op == "close":
        return None, None
    return state, None


def sessions(ops: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """ops (correlation, ts, event_id, partition, op, size) -> event_id, correlation, op, found. A hot id's log is cut where a
    session is parked or closed, which leaves nothing of what was there."""
    rows = ops.select("correlation", (F.unix_micros("ts") / 1e6).alias("at"), "event_id", "partition", "op", "size")

    def fold(state, row):
        state, found = session_step(state, row[4], row[3], row[5], row[1])
        return state, (row[2], row[0], row[4], found)

    fresh = lambda before: (F.col("op") == "close") | (F.col("op") == "park") & (F.col("size") > 0)
    return by_parts(rows, "correlation", ["at", "event_id"], fold, "event_id long, correlation string, op string, found boolean", fresh, "at", hot_rows)


def parked_lookups(parks: DataFrame, fetches: DataFrame, ttl: float = PARK_TTL) -> DataFrame:
    """Fetches that meet a session which nobody extended or closed: an equi-join on id and partition with a range of
    time. (correlation, partition, ts) and (event_id, correlation, partition, ts) -> event_id, found."""
    p, f = parks.alias("p"), fetches.alias("f")
    age = (F.unix_micros("f.ts") - F.unix_micros("p.ts")) / 1e6
    met = f.join(p, (F.col("f.correlation") == F.col("p.correlation")) & (F.col("f.partition") == F.col("p.partition")) & (age >= 0) & (age < ttl), "left_semi")
    return fetches.select("event_id").join(met.select("event_id", F.lit(True).alias("hit")), "event_id", "left").select("event_id", F.coalesce("hit", F.lit(False)).alias("found"))


def capped_sessions(live: DataFrame, most: int = 10_000) -> DataFrame:
    """The sessions that expire last."""
    return live.orderBy(F.desc("expires_at"), "correlation").limit(most)


def unmasked_stream(chunks: DataFrame, sessions: DataFrame) -> DataFrame:
    """chunks (stream_id, seq, chunk) and sessions (stream_id, session) -> stream_id, seq, text: each chunk's clear part
    as it can go out; the last one's row has what was held back, too. A session travels with its stream's first chunk alone."""
    ends = chunks.groupBy("stream_id").agg(F.max("seq").alias("last"), F.min("seq").alias("first"))
    rows = chunks.join(ends, "stream_id").join(sessions, "stream_id", "left")
    rows = rows.select("stream_id", "seq", "chunk", (F.col("seq") == F.col("last")).alias("last"), F.when(F.col("seq") == F.col("first"), F.map_entries("session")).alias("session"))

    def fold(state, row):
        forms, tail = state or (Forms({e["key"]: e["value"] for e in row[4] or []}), "")
        out, tail = forms.push(tail, row[2] or "")
        return (forms, tail), (row[0], row[1], out + forms.clear(tail) if row[3] else out)

    return by_key(rows, "stream_id", ["seq"], fold, "stream_id long, seq long, text string")
