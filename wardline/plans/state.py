"""Queries: rate limits, sessions, and their streaming twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scan import disposition, role_trust, scan
from ..operators import decide
from ..operators.storage import shared_path
from ..sources import logs
from ..streaming import keyed, state
from .fixtures import FIRST_SQL, MESSAGES, MESSAGES_SQL, RANK_SQL, SAID_DLP, TRUST_SQL, WEIGHT_SQL, bucket_sql, derived, hits, query, replayed, rules_sql, said_sql, table, weight_sql


def _log(events: DataFrame) -> DataFrame:
    return events.select(F.concat_ws("|", (F.col("user_id") % 3).cast("string"), F.col("user_id").cast("string")).alias("caller"), "ts", "event_id")


_CALLER = "concat(cast(user_id % 3 as string), '|', cast(user_id as string))"
_T01 = f"WITH RECURSIVE {bucket_sql(_CALLER, 4, 3600.0, 2)} SELECT event_id, caller, ok AS allowed, CASE WHEN ok THEN 0.0 ELSE greatest(1.0, ceil((1 - f) / {4 / 3600.0!r}::DOUBLE)) END::DOUBLE AS retry_after FROM t"


@query("T01_rate_limit", _T01)
def t01(spark, d):
    return state.rate_limited(_log(table(spark, d, "events")), 4, 3600.0, 2)


#: Nine of ten events are one caller's.
_HOT = "CASE WHEN event_id % 10 < 9 THEN 'one' ELSE cast(user_id as string) END"


def _hot_log(events: DataFrame) -> DataFrame:
    return events.select(F.expr(_HOT).alias("caller"), "ts", "event_id")


@query("T01_hot_caller", f"WITH RECURSIVE {bucket_sql(_HOT, 20, 3600.0, 2)} SELECT event_id, caller, ok AS allowed, CASE WHEN ok THEN 0.0 ELSE greatest(1.0, ceil((1 - f) / {20 / 3600.0!r}::DOUBLE)) END::DOUBLE AS retry_after FROM t")
def t01_hot(spark, d):
    return state.rate_limited(_hot_log(table(spark, d, "events")), 20, 3600.0, 2, hot_rows=100)


@query("T01_limit_parts", f"""WITH o AS (SELECT {_HOT} AS caller, event_id, epoch_us(ts) / 1e6 AS sec FROM events), b AS (SELECT *, lag(sec) OVER (PARTITION BY caller ORDER BY sec, event_id) AS before FROM o),
 p AS (SELECT *, count(*) FILTER (before IS NULL OR (sec - before) * {20 / 3600.0!r}::DOUBLE >= 2) OVER (PARTITION BY caller ORDER BY sec, event_id) AS part FROM b)
 SELECT caller, count(*) AS parts, sum(n)::BIGINT AS rows, max(n) AS longest FROM (SELECT caller, part, count(*) AS n FROM p GROUP BY caller, part) GROUP BY caller""")
def t01_parts(spark, d):
    return state.limit_parts(_hot_log(table(spark, d, "events")), 20, 3600.0, 2)


@query("T02_retry_after", "SELECT event_id, greatest(1.0, ceil((1 - (value % 1)) * 15.0)) AS wait FROM events")
def t02(spark, d):
    return table(spark, d, "events").select("event_id", state.retry_after(F.col("value") % 1, 4, 60.0).alias("wait"))


def _ops(events: DataFrame, correlation: str = "cast(user_id as string)") -> DataFrame:
    kind = F.col("event_id") % 8
    op = F.when(kind < 2, "park").when(kind < 6, "fetch").when(kind == 6, "extend").otherwise("close")
    part = F.concat(F.lit("t"), (F.floor(F.col("event_id") / 3) % 2).cast("string"))
    return events.select(F.expr(correlation).alias("correlation"), "ts", "event_id", part.alias("partition"), op.alias("op"), (F.col("event_id") % 5).cast("int").alias("size"))


#: Each step in turn: sp and se are the session's partition and expiry after it, null without one.
_T04 = """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY correlation ORDER BY sec, event_id) AS i FROM (SELECT cast(user_id as string) AS correlation, epoch_us(ts) / 1e6 AS sec, event_id, (event_id // 3) % 2 AS part,
  CASE WHEN event_id % 8 < 2 THEN 'park' WHEN event_id % 8 < 6 THEN 'fetch' WHEN event_id % 8 = 6 THEN 'extend' ELSE 'close' END AS op, event_id % 5 AS size FROM events)),
 t AS (SELECT correlation, event_id, i, op, CASE WHEN op = 'fetch' THEN false END AS found, CASE WHEN op = 'park' AND size > 0 THEN part END AS sp, CASE WHEN op = 'park' AND size > 0 THEN sec + 900 END AS se FROM o WHERE i = 1 UNION ALL
  SELECT o.correlation, o.event_id, o.i, o.op, CASE WHEN o.op = 'fetch' THEN coalesce(t.se > o.sec AND t.sp = o.part, false) END, CASE WHEN o.op = 'close' THEN NULL WHEN o.op = 'park' AND o.size > 0 THEN o.part ELSE t.sp END,
   CASE WHEN o.op = 'close' THEN NULL WHEN o.op = 'park' AND o.size > 0 THEN o.sec + 900 WHEN o.op = 'extend' AND t.se > o.sec THEN o.sec + 14400 ELSE t.se END FROM t JOIN o ON o.correlation = t.correlation AND o.i = t.i + 1)
 SELECT event_id, correlation, op, found FROM t"""


@query("T04_sessions", _T04)
def t04(spark, d):
    return state.sessions(_ops(table(spark, d, "events")))


@query("T04_hot_session", _T04.replace("SELECT cast(user_id as string) AS correlation", f"SELECT {_HOT} AS correlation"))
def t04_hot(spark, d):
    events = table(spark, d, "events")
    return state.sessions(_ops(events, _HOT), hot_rows=100)


@query("T04_parked_lookups", """SELECT f.event_id, EXISTS (SELECT 1 FROM events p WHERE p.event_id % 2 = 0 AND p.user_id = f.user_id AND p.event_type = f.event_type AND epoch_us(f.ts) >= epoch_us(p.ts) AND epoch_us(f.ts) - epoch_us(p.ts) < 90000000000) AS found FROM events f WHERE f.event_id % 2 = 1""")
def t04_parked(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("correlation"), F.col("event_type").alias("partition"), "ts")
    return state.parked_lookups(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), 90_000.0)


@query("T06_session_cap", "SELECT correlation, expires_at FROM (SELECT cast(user_id as string) AS correlation, max(ts) AS expires_at FROM events GROUP BY user_id) ORDER BY expires_at DESC, correlation LIMIT 50")
def t06(spark, d):
    live = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("correlation")).agg(F.max("ts").alias("expires_at"))
    return state.capped_sessions(live, 50)


@query("T03_streaming_rate_limit", _T01)
def t03(spark, d):
    return replayed(spark, table(spark, d, "events"), lambda s: keyed.rate_limited_stream(_log(s), 4, 3600.0, 2, late="1 hour"))


@query("T05_streaming_sessions", _T04)
def t05(spark, d):
    return replayed(spark, table(spark, d, "events"), lambda s: keyed.session_stream(_ops(s)))


_T07 = f"""WITH m AS ({MESSAGES_SQL}), t AS (SELECT *, {TRUST_SQL} AS trust FROM m), s AS (SELECT *, {said_sql('request + idx')} AS hits, least(1.0, ({weight_sql('request + idx')}) * {WEIGHT_SQL}) AS risk FROM t)
 SELECT request, idx, trust, CASE WHEN risk >= 0.7 THEN 'block' ELSE 'allow' END AS disposition, risk AS risk_score, hits FROM s"""


@query("T07_streaming_screening", _T07)
def t07(spark, d):
    """Each message scanned with its detection surface and decided on arrival."""
    rows = table(spark, d, "conversations").withColumn("ts", F.timestamp_seconds(F.col("conv_id") * 60 + F.col("turn")))

    def screened(s: DataFrame) -> DataFrame:
        out = scan(derived(s, MESSAGES).withColumn("trust", role_trust(F.col("role"))))
        v = disposition(F.col("findings"), F.col("raw_score"), F.col("trust"), F.col("was_modified"))
        return out.select("request", "idx", "trust", v["disposition"].alias("disposition"), v["risk_score"].alias("risk_score"), hits(F.col("findings")).alias("hits"))

    return replayed(spark, rows, screened)


_T07_AUDIT = f"""WITH m AS ({MESSAGES_SQL}), t AS (SELECT *, {TRUST_SQL} AS trust FROM m),
 r AS (SELECT *, replace(text, 'http://wiki.corp/page', '[INTERNAL-URL]') AS sent, {rules_sql(said_sql('request + idx'))} AS inj, {rules_sql(said_sql('request + idx', SAID_DLP))} AS dlp, least(1.0, ({weight_sql('request + idx')}) * {WEIGHT_SQL}) AS risk FROM t),
 z AS (SELECT *, CASE WHEN risk >= 0.7 THEN inj ELSE inj || dlp END AS rules, CASE WHEN risk >= 0.7 THEN 'block' WHEN sent <> text THEN 'allow_modified' ELSE 'allow' END AS disposition FROM r)
 SELECT request, idx, tenant, model, disposition, round(risk, 6) AS risk_score, array_to_string(rules, ',') AS rule_ids, coalesce({FIRST_SQL}, '') AS categories, CASE {RANK_SQL} END AS max_severity, octet_length(encode(CASE WHEN risk >= 0.7 THEN text ELSE sent END)) AS content_bytes FROM z"""


@query("T07_streaming_audit", _T07_AUDIT)
def t07_audit(spark, d):
    """Each message guarded, scanned and redacted on arrival, its audit row appended to a log that is then read back."""
    rows = derived(table(spark, d, "conversations"), MESSAGES).repartition(4, "request")
    base = shared_path(spark, f"firewall-{uuid.uuid4().hex}")
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    logs.append_audit(decide.audited(decide.arrived(stream), ("request", "idx")), f"{base}/log", f"{base}/state", availableNow=True).awaitTermination()
    a = logs.read_audit(spark, f"{base}/log", "idx int")
    return a.select(
        F.col("request").cast(dict(rows.dtypes)["request"]).alias("request"), F.col("idx").cast(dict(rows.dtypes)["idx"]).alias("idx"), "tenant", "model", "disposition", F.round("risk_score", 6).alias("risk_score"),
        F.array_join("rule_ids", ",").alias("rule_ids"), F.array_join("categories", ",").alias("categories"), "max_severity", "content_bytes",
    )
