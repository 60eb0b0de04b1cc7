"""Streams with state against the same work in batch: many triggers, restarts, hot keys, chunks in any order."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wardline.streaming import keyed, state
from wardline.functions.forms import Forms


def _streamed(spark, rows, schema, transform, base, triggers, restart_at):
    """rows (a list for each trigger) as files of rising age, one a trigger; the query ends and starts again before restart_at."""
    live = keyed.store_session(spark)
    for k, own in enumerate(rows):
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        if k + 1 in (restart_at, triggers):
            source = live.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
            run = transform(source).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start()
            run.awaitTermination()
            assert run.exception() is None
    return spark.read.parquet(f"{base}/out")


def _cut(rows, n):
    return [rows[k * len(rows) // n : (k + 1) * len(rows) // n] for k in range(n)]


def test_the_callers_session_is_left_alone(spark):
    assert keyed.store_session(spark).conf.get(keyed.STORE) == keyed.ROCKSDB and spark.conf.get(keyed.STORE) != keyed.ROCKSDB
    stream = spark.readStream.format("rate").load().select(F.lit("a").alias("caller"), F.col("timestamp").alias("ts"), F.col("value").alias("event_id"))
    with pytest.raises(ValueError, match="RocksDB"):
        keyed.rate_limited_stream(stream)


@pytest.mark.parametrize("at_once", [7, 10_000])
def test_a_hot_caller_over_many_triggers_equals_batch(spark, tmp_path, at_once):
    """A third of the rows are one caller's; slices of state take what is more than at_once rows of a trigger."""
    rng, t0 = random.Random(2), datetime(2024, 1, 1, tzinfo=timezone.utc)
    at = sorted(rng.random() * 40_000 for _ in range(900))
    rows = [("hot" if i % 3 == 0 else f"c{rng.randrange(9)}", t0 + timedelta(seconds=round(a)), i) for i, a in enumerate(at)]
    cut = _cut(rows, 20 if at_once == 7 else 6)
    for own in cut:
        rng.shuffle(own)
    schema = "caller string, ts timestamp, event_id long"
    got = _streamed(spark, cut, schema, lambda s: keyed.rate_limited_stream(s, 4, 600.0, 3, late="2 seconds", at_once=at_once, slice_s=300), str(tmp_path), len(cut), 3)
    want = state.rate_limited(spark.createDataFrame(rows, schema), 4, 600.0, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.allowed for r in want.where("caller = 'hot'").collect()} == {True, False}


def test_sessions_over_many_triggers_equal_batch(spark, tmp_path):
    rng, t0 = random.Random(3), datetime(2024, 1, 1, tzinfo=timezone.utc)
    at = sorted(rng.random() * 60_000 for _ in range(600))
    rows = [("hot" if i % 3 == 0 else f"s{rng.randrange(9)}", t0 + timedelta(seconds=round(a)), i, rng.choice("pq"), rng.choice(["park", "fetch", "fetch", "extend", "close"]), rng.randrange(3)) for i, a in enumerate(at)]
    cut = _cut(rows, 8)
    for own in cut:
        rng.shuffle(own)
    schema = "correlation string, ts timestamp, event_id long, partition string, op string, size int"
    got = _streamed(spark, cut, schema, lambda s: keyed.session_stream(s, late="2 seconds", at_once=9, slice_s=600), str(tmp_path), 8, 5)
    want = state.sessions(spark.createDataFrame(rows, schema))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.where("found").count() > 20


# --- chunks -------------------------------------------------------------------------------------------------


def _arrivals(rng, streams, triggers):
    """(stream, seq, chunk, last) of all streams, dealt over triggers at random, some of them twice."""
    rows = [(k, i, c, i == len(cs) - 1) for k, cs in streams.items() for i, c in enumerate(cs)]
    rows += rng.sample(rows, len(rows) // 8)
    rng.shuffle(rows)
    return _cut(rows, triggers)


def test_lines_in_any_order_with_cut_characters(spark, tmp_path):
    rng = random.Random(4)
    bodies = {k: "".join(rng.choice(["ä", "日", "x", "\n", "data: y\n", "😀"]) for _ in range(60)).encode() for k in range(6)} | {6: b"", 7: b"no end", 8: b"\n\n"}
    streams = {k: [bytearray(b[i : i + 3]) for i in range(0, len(b), 3)] or [bytearray()] for k, b in bodies.items()}
    got = _streamed(spark, _arrivals(rng, streams, 6), "stream_id long, seq long, chunk binary, last boolean", keyed.line_stream, str(tmp_path), 6, 3).collect()
    want = [(k, i, line, False) for k, b in bodies.items() for i, line in enumerate(b.decode().split("\n")[:-1])] + [(k, b.count(b"\n"), None, True) for k, b in bodies.items()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_folds_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    schema = "stream_id long, seq long, delta string, usage struct<prompt_tokens:long,completion_tokens:long>, failure string, last boolean"
    rows, want = [], []
    for k in range(5):
        own = [(k, i, rng.choice(["a", "ü", None, ""]), rng.choice([None, None, (rng.randrange(9), rng.randrange(9))]), rng.choice([None] * 5 + ["broken"]), i == 11) for i in range(12)]
        rows += own
        used = [r[3] for r in own if r[3]]
        want.append((k, "".join(r[2] or "" for r in own), *(map(max, zip(*used)) if used else (None, None)), next((r[4] for r in reversed(own) if r[4]), None)))
    rng.shuffle(rows)
    got = _streamed(spark, _cut(rows, 5), schema, keyed.fold_stream, str(tmp_path), 5, 2)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_unmasking_live_equals_batch_for_any_cut(spark, tmp_path):
    rng = random.Random(6)
    sessions = {k: {f"[Person-{i}]": f"Name {i}" for i in range(1, 40)} | {"Nora B.": "Anna", "Nora": "Eva"} for k in range(4)} | {4: {}}
    texts = {k: "".join(rng.choice([f"[Person-{rng.randrange(45)}]", "Nora", " B.", "[", "Per", " word "]) for _ in range(40)) for k in sessions}
    streams = {}
    for k, t in texts.items():
        cuts = sorted(rng.sample(range(1, len(t)), 15))
        streams[k] = [t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)])]
    arrivals = [[(*r, None) for r in own] for own in _arrivals(rng, streams, 6)]
    for k, s in sessions.items():  # some sessions come after the first chunks, in a row of their own
        arrivals[k % 3].append((k, None, None, None, s))
    got = _streamed(spark, arrivals, "stream_id long, seq long, chunk string, last boolean, session map<string,string>", keyed.unmasked_live, str(tmp_path), 6, 3)
    chunks = spark.createDataFrame([(k, i, c) for k, cs in streams.items() for i, c in enumerate(cs)], "stream_id long, seq long, chunk string")
    want = state.unmasked_stream(chunks, spark.createDataFrame([(k, s) for k, s in sessions.items()], "stream_id long, session map<string,string>"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


# --- the automaton ------------------------------------------------------------------------------------------


def _held(forms, text):
    return max((n for f in forms for n in range(min(len(f) - 1, len(text)) + 1) if text.endswith(f[:n])), default=0)


def test_held_back_is_the_longest_suffix_that_begins_a_form():
    rng = random.Random(7)
    for _ in range(2000):
        forms = {"".join(rng.choice("ab[") for _ in range(rng.randint(1, 6))): "X" for _ in range(rng.randint(0, 6))}
        own, text = Forms(forms), "".join(rng.choice("ab[c") for _ in range(12))
        assert own.held(text) == _held(forms, text)


def test_clear_equals_replacing_the_longest_first():
    rng = random.Random(8)
    for _ in range(2000):
        forms = {"".join(rng.choice("ab[]") for _ in range(rng.randint(1, 5))): rng.choice(["X", "Y Z", "Q"]) for _ in range(rng.randint(0, 6))}
        text = want = "".join(rng.choice("ab[]c") for _ in range(30))
        for form in sorted(forms, key=lambda k: (-len(k), k)):
            want = want.replace(form, forms[form])
        assert Forms(forms).clear(text) == want


def test_values_that_hold_forms_are_replaced_one_after_the_other():
    assert Forms({"[A-1]": "see [B]", "[B]": "end"}).clear("[A-1].") == "see end."


def test_ten_thousand_forms():
    forms = Forms({f"[Person-{i}]": f"N{i}" for i in range(10_000)})
    tail, out, text = "", [], "".join(f"x [Person-{i}]" for i in range(0, 10_000, 7))
    for at in range(0, len(text), 5):
        ready, tail = forms.push(tail, text[at : at + 5])
        out.append(ready)
    assert "".join(out) + forms.clear(tail) == "".join(f"x N{i}" for i in range(0, 10_000, 7))
    assert not tail


# --- hot keys in batch --------------------------------------------------------------------------------------


def test_a_hot_callers_log_is_walked_by_many_tasks(spark, sf):
    from wardline.plans import state as plans
    from wardline.plans.fixtures import table

    log = plans._hot_log(table(spark, sf, "events"))
    got = state.rate_limited(log, 60, 3600.0, 2, hot_rows=100).where("caller = 'one'")
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    parts = state.limit_parts(log, 60, 3600.0, 2).where("caller = 'one'").first()
    assert parts.rows == got.count() and parts.parts > 100 and parts.longest < parts.rows / 10
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, state.rate_limited(log, 60, 3600.0, 2).where("caller = 'one'").collect()))


def test_a_log_without_reset_points_is_one_part(spark):
    log = spark.range(300).select(F.lit("c").alias("caller"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"))
    assert tuple(state.limit_parts(log, 0, 60.0, 5).first()) == ("c", 1, 300, 300)
    assert state.rate_limited(log, 0, 60.0, 5, hot_rows=10).where("allowed").count() == 5


def test_early_chunks_of_many_pages(spark, tmp_path):
    """More chunks than a page of early ones holds, in any order, over triggers and a restart."""
    rng = random.Random(9)
    streams = {k: [bytearray(rng.choice([b"a", b"b\n", "ü".encode()])) for _ in range(5 * keyed.PAGE + k)] for k in range(3)}
    got = _streamed(spark, _arrivals(rng, streams, 4), "stream_id long, seq long, chunk binary, last boolean", keyed.line_stream, str(tmp_path), 4, 2).collect()
    bodies = {k: b"".join(map(bytes, cs)).decode() for k, cs in streams.items()}
    want = [(k, i, line, False) for k, b in bodies.items() for i, line in enumerate(b.split("\n")[:-1])] + [(k, b.count("\n"), None, True) for k, b in bodies.items()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_long_captures_are_cut_in_proportion_to_their_length(spark):
    """The size of a split capture stood beside its lines, and was made again for each of them."""
    import time

    from wardline.plans.fixtures import chunked
    from wardline.sources import streams

    rows = spark.range(1).selectExpr("id AS stream_id", "repeat('data: x\\n', 40000) AS body")
    t0 = time.monotonic()
    assert streams.payloads(rows, True).where("payload = 'x'").count() == 40_000
    cut = chunked(rows.selectExpr("stream_id", "encode(body, 'UTF-8') AS data"), 8)
    assert cut.where("chunk = encode('data: x\n', 'UTF-8')").count() == 40_000 and [r.seq for r in cut.where("last").collect()] == [39_999]
    assert time.monotonic() - t0 < 60
