"""Queries: the cache of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache
from ..operators.storage import stored
from .fixtures import MESSAGES_SQL, derived, messages, query, table

M = f"WITH m AS ({MESSAGES_SQL})"
#: A prompt is one of few, so that lookups meet entries.
ENTRY = {
    "entry_id": "event_id", "lookup_id": "event_id", "partition": "concat('t', cast(user_id % 4 as string))", "model": "concat('m', cast(user_id % 3 as string))", "prompt": "concat(event_type, ' ', cast(user_id % 20 as string))",
    "temperature": "CASE WHEN user_id % 2 = 0 THEN 0.2 END", "max_tokens": "CASE WHEN user_id % 5 = 0 THEN 100 END", "stored_at": "ts", "ts": "ts", "response": "concat('answer ', cast(event_id as string))", "last_used": "event_id",
}
_E = "SELECT " + ", ".join(f"{'cast(' + e + ' as double)' if c == 'temperature' else e} AS {c}" for c, e in ENTRY.items())
E = f"WITH e AS ({_E} FROM events WHERE event_id % 2 = 0), q AS ({_E} FROM events WHERE event_id % 2 = 1)"
A = f"WITH e AS ({_E} FROM events)"
TTL = 86_400
NOW = "timestamp '2024-01-20 00:00:00'"


def _all_entries(spark, d):
    return derived(table(spark, d, "events"), ENTRY).withColumn("temperature", F.col("temperature").cast("double"))


def _entries(spark, d, parity=0):
    return derived(table(spark, d, "events").where(f"event_id % 2 = {parity}"), ENTRY).withColumn("temperature", F.col("temperature").cast("double"))


@query("C01_cache_key", f"{M} SELECT request, sha256(string_agg(role || chr(31) || text, chr(30) ORDER BY idx)) AS prompt_sha256 FROM m GROUP BY request")
def c01(spark, d):
    by = messages(spark, d).groupBy("request").agg(F.array_sort(F.collect_list(F.struct("idx", "role", F.col("text").alias("content")))).alias("m"))
    return by.select("request", F.sha2(cache.prompt(F.col("m")), 256).alias("prompt_sha256"))


_WORDS = ", ".join(f"'{w}'" for w in cache.FUNCTION_WORDS)


_C02 = f"""{M} SELECT request, idx, sha256(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\\[[A-Za-z]+-\\d+\\]|\\p{{L}}*\\d[\\p{{L}}\\d]*|\\p{{Lu}}\\p{{L}}+'), lambda x: lower(x)), lambda x: x NOT IN ({_WORDS})))), ',')) AS signature_sha256 FROM m"""


@query("C02_entity_signature", _C02)
def c02(spark, d):
    return messages(spark, d).select("request", "idx", F.sha2(F.array_join(cache.signature(F.col("text")), ","), 256).alias("signature_sha256"))


_C03 = f"""{{e}}, b AS (SELECT q.lookup_id, arg_max(e.response, (epoch_us(e.stored_at), e.response)) AS response, max(e.stored_at) AS stored_at, any_value(q.ts) AS ts FROM q JOIN e ON q.partition = e.partition AND q.model = e.model AND q.prompt = e.prompt
 AND q.temperature IS NOT DISTINCT FROM e.temperature AND q.max_tokens IS NOT DISTINCT FROM e.max_tokens AND e.stored_at <= q.ts GROUP BY 1)
 SELECT q.lookup_id, CASE WHEN epoch_us(b.ts) - epoch_us(b.stored_at) <= {TTL}000000 THEN b.response END AS response, coalesce(epoch_us(b.ts) - epoch_us(b.stored_at) <= {TTL}000000, false) AS hit FROM q LEFT JOIN b ON q.lookup_id = b.lookup_id"""


def _exact(lookups, entries):
    return cache.exact(lookups, entries, TTL).select("lookup_id", "response", F.col("response").isNotNull().alias("hit"))


@query("C03_exact_lookup", _C03.replace("{e}", f"WITH q AS ({_E} FROM events), e AS (SELECT * REPLACE (stored_at + INTERVAL 1 SECOND AS stored_at) FROM q)"))
def c03(spark, d):
    """Each event asks for an answer of its prompt, and stores one a second later."""
    return _exact(_all_entries(spark, d), _all_entries(spark, d).withColumn("stored_at", F.expr("stored_at + interval 1 second")))


VECTORS = {"lookup_id": "vec_id", "entry_id": "vec_id", "partition": "'p'", "model": "'m'", "embedding": "embedding", "response": "cast(vec_id as string)"}


def _all_vectors(spark, d):
    rows = derived(table(spark, d, "embeddings").withColumn("l", F.col("label")), VECTORS | {"signature": "array(cast(label as string))"})
    return rows.withColumn("stored_at", F.timestamp_seconds(F.lit(0))).withColumn("ts", F.timestamp_seconds(F.lit(60)))


@query("C04_semantic_lookup", """WITH s AS (SELECT q.vec_id AS lookup_id, e.vec_id AS entry_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id)
 SELECT lookup_id, arg_max(entry_id, score) AS entry_id, round(max(score), 6) AS score FROM s WHERE score >= 0.3 GROUP BY lookup_id""")
def c04(spark, d):
    rows = _all_vectors(spark, d)
    return cache.semantic(rows, rows, 0.3, itself=False).select("lookup_id", "entry_id", F.round("score", 6).alias("score"))


@query("C05_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id")
def c05(spark, d):
    a = table(spark, d, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(cache.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


def _looked_up(spark, d):
    """Every vector is a lookup and an entry. One lookup of four asks the next one's prompt; the others' prompts are in no
    entry, and their own entries are passed over."""
    plain = {"temperature": F.lit(None).cast("double"), "max_tokens": F.lit(None).cast("int")}
    rows = _all_vectors(spark, d).withColumns(plain)
    text = lambda c: c.cast("string")
    lookups = rows.withColumn("prompt", F.when(F.col("lookup_id") % 4 == 0, F.concat(F.lit("#"), text(F.col("lookup_id") + 1))).otherwise(F.concat(F.lit("?"), text(F.col("lookup_id")))))
    entries = rows.withColumns({"prompt": F.concat(F.lit("#"), text(F.col("entry_id"))), "embedding": F.transform("embedding", lambda x: x * F.lit(1.01).cast("float"))})
    return cache.looked_up(lookups, entries, 0.3, itself=False)


_KINDS = """WITH s AS (SELECT q.vec_id AS lookup_id, e.vec_id AS entry_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id),
 b AS (SELECT lookup_id, arg_max(entry_id, score) AS entry_id FROM s WHERE score >= 0.3 GROUP BY lookup_id),
 k AS (SELECT v.vec_id AS lookup_id, CASE WHEN v.vec_id % 4 = 0 AND n.vec_id IS NOT NULL THEN n.vec_id ELSE b.entry_id END AS answer, CASE WHEN v.vec_id % 4 = 0 AND n.vec_id IS NOT NULL THEN 'exact' WHEN b.entry_id IS NOT NULL THEN 'semantic' ELSE 'miss' END AS kind
  FROM embeddings v LEFT JOIN b ON b.lookup_id = v.vec_id LEFT JOIN embeddings n ON n.vec_id = v.vec_id + 1)"""


@query("C06_hit_kinds", f"{_KINDS} SELECT lookup_id, kind, cast(answer as string) AS response FROM k")
def c06(spark, d):
    return _looked_up(spark, d).select("lookup_id", "kind", "response")


@query("C07_store_rule", f"""{A} SELECT lookup_id FROM e WHERE lookup_id % 3 = 0 AND lookup_id % 5 <> 0 AND lookup_id % 7 <> 0""")
def c07(spark, d):
    rows = _all_entries(spark, d).withColumns({"kind": F.when(F.col("lookup_id") % 3 == 0, "miss").otherwise("exact"), "cacheable": F.col("lookup_id") % 5 != 0, "ok": F.lit(True), "answer": F.when(F.col("lookup_id") % 7 == 0, "").otherwise("text")})
    return cache.stores(rows).select("lookup_id")


@query("C07_append", f"{E} SELECT partition, count(*) AS entries FROM (SELECT * FROM q UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.partition = e.partition AND q.model = e.model AND q.prompt = e.prompt AND q.temperature IS NOT DISTINCT FROM e.temperature AND q.max_tokens IS NOT DISTINCT FROM e.max_tokens)) GROUP BY partition")
def c07_append(spark, d):
    return cache.per_partition(cache.appended(_entries(spark, d), _entries(spark, d, 1)))


@query("C08_expiry", f"{A} SELECT entry_id FROM e WHERE epoch_us({NOW}) - epoch_us(stored_at) <= {TTL * 5}000000")
def c08(spark, d):
    return cache.expired(_all_entries(spark, d), F.expr(NOW), TTL * 5).select("entry_id")


@query("C09_replay", """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS i FROM (SELECT cast(user_id % 20 as string) || '|' || event_type AS key, epoch_us(ts) AS us, event_id FROM events)),
 t AS (SELECT key, event_id, i, us AS since, 'miss' AS kind FROM o WHERE i = 1 UNION ALL
  SELECT o.key, o.event_id, o.i, CASE WHEN o.us - t.since <= 3600000000 THEN t.since ELSE o.us END, CASE WHEN o.us - t.since <= 3600000000 THEN 'exact' ELSE 'miss' END FROM t JOIN o ON o.key = t.key AND o.i = t.i + 1)
 SELECT key, event_id, kind FROM t""")
def c09(spark, d):
    log = table(spark, d, "events").select(F.concat_ws("|", (F.col("user_id") % 20).cast("string"), "event_type").alias("key"), "ts", "event_id")
    return cache.replayed(log, 3600)


@query("C09_hot_key", """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS i FROM (SELECT CASE WHEN event_id % 10 < 9 THEN 'one' ELSE event_type END AS key, epoch_us(ts) AS us, event_id FROM events)),
 t AS (SELECT key, event_id, i, us AS since, 'miss' AS kind FROM o WHERE i = 1 UNION ALL
  SELECT o.key, o.event_id, o.i, CASE WHEN o.us - t.since <= 600000000 THEN t.since ELSE o.us END, CASE WHEN o.us - t.since <= 600000000 THEN 'exact' ELSE 'miss' END FROM t JOIN o ON o.key = t.key AND o.i = t.i + 1)
 SELECT key, event_id, kind FROM t""")
def c09_hot(spark, d):
    """Nine of ten requests ask for one key."""
    log = table(spark, d, "events").select(F.expr("CASE WHEN event_id % 10 < 9 THEN 'one' ELSE event_type END").alias("key"), "ts", "event_id")
    return cache.replayed(log, 600, hot_rows=100)


@query("C10_caps", f"{A} SELECT entry_id FROM (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY last_used DESC, entry_id) AS n FROM e) WHERE n <= 200 ORDER BY last_used DESC, entry_id LIMIT 500")
def c10(spark, d):
    return cache.capped(_all_entries(spark, d), 200, 500).select("entry_id")


#: Requests of four partitions for some 400 prompts each, and what a cache of the 60 most recently used ones makes of them.
_USES = """WITH u AS (SELECT concat('t', cast(user_id % 4 as string)) AS partition, concat(event_type, ' ', cast(event_id * 7 % 101 as string)) AS key, event_id, epoch_us(ts) AS us FROM events),
 o AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY us, event_id) AS i FROM u), l AS (SELECT *, lag(i) OVER (PARTITION BY partition, key ORDER BY i) AS p FROM o),
 d AS (SELECT l.partition, l.key, l.event_id, CASE WHEN l.p IS NOT NULL THEN count(DISTINCT k.key) END AS distance FROM l LEFT JOIN l k ON k.partition = l.partition AND k.i > l.p AND k.i < l.i GROUP BY l.partition, l.key, l.event_id, l.p),
 r AS (SELECT *, CASE WHEN distance < 60 THEN 'exact' ELSE 'miss' END AS kind FROM d)"""


def _uses(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("partition"), F.concat("event_type", F.lit(" "), (F.col("event_id") * 7 % 101).cast("string")).alias("key"), "ts", "event_id")


@query("C10_reuse_distances", f"{_USES} SELECT partition, key, event_id, distance FROM d")
def c10_reuse(spark, d):
    return cache.reuse_distances(_uses(spark, d), 500)


@query("C10_capped_replay", f"{_USES} SELECT partition, key, event_id, kind FROM r")
def c10_replay(spark, d):
    return cache.capped_replay(_uses(spark, d), 60)


@query("C12_replay_statistics", f"""{_USES} SELECT partition, count(*) AS lookups, count(*) FILTER (kind = 'exact') AS exact_hits, count(*) FILTER (kind = 'miss') AS misses, count(*) FILTER (kind = 'miss') AS stores,
 count(*) FILTER (kind = 'miss') - least(count(DISTINCT key), 60) AS evictions, least(count(DISTINCT key), 60) AS entries, count(*) FILTER (kind = 'exact') / count(*) AS hit_rate FROM r GROUP BY partition""")
def c12_replay(spark, d):
    """Hits, misses, stores and evictions of one log through one cache."""
    return cache.replay_statistics(cache.capped_replay(_uses(spark, d), 60), 60)


@query("C11_invalidate", f"{A} SELECT count(*) AS removed FROM e WHERE partition = 't1' AND model = 'm2'")
def c11(spark, d):
    e = _all_entries(spark, d)
    return cache.without(e, cache.invalidated(e, "t1", "m2")).agg(F.count("*").alias("removed"))


@query("C12_statistics", f"""{_KINDS}, e AS ({_E} FROM events), x AS (SELECT * FROM e WHERE epoch_us({NOW}) - epoch_us(stored_at) <= {TTL * 5}000000),
 y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY last_used DESC, entry_id) AS n FROM x) WHERE n <= 200 ORDER BY last_used DESC, entry_id LIMIT 500)
 SELECT count(*) AS lookups, count(*) FILTER (kind = 'exact') AS exact_hits, count(*) FILTER (kind = 'semantic') AS semantic_hits, count(*) FILTER (kind = 'miss') AS misses,
 count(*) FILTER (kind = 'miss' AND lookup_id % 5 <> 0) AS stores, (SELECT count(*) FROM x) - (SELECT count(*) FROM y) AS evictions, (SELECT count(*) FROM e) - (SELECT count(*) FROM x) AS expirations,
 (SELECT count(*) FROM y WHERE partition = 't1') AS invalidations, count(*) FILTER (kind <> 'miss') / count(*) AS hit_rate FROM k""")
def c12(spark, d):
    """Lookups of the vectors, of whose misses four of five are stored; the cache of all events expires, is cut to its caps,
    and loses a partition."""
    results = _looked_up(spark, d).withColumns({"cacheable": F.col("lookup_id") % 5 != 0, "ok": F.lit(True), "answer": F.lit("text")})
    entries = _all_entries(spark, d)
    living = cache.expired(entries, F.expr(NOW), TTL * 5)
    kept = stored(cache.capped(living, 200, 500), "kept")
    return cache.statistics(results, cache.stores(results), cache.without(entries, living), cache.without(living, kept), cache.without(kept, cache.invalidated(kept, "t1")))


@query("C13_entries_per_partition", f"{A} SELECT partition, count(*) AS entries FROM e GROUP BY partition")
def c13(spark, d):
    return cache.per_partition(_all_entries(spark, d))


@query("S25_snapshot_restore", f"{A} SELECT entry_id FROM e WHERE epoch_us({NOW}) - epoch_us(stored_at) <= {TTL * 5}000000 ORDER BY last_used DESC, entry_id LIMIT 1000")
def s25(spark, d):
    return cache.restored(stored(_all_entries(spark, d), "snapshot"), F.expr(NOW), TTL * 5).select("entry_id")
