"""Streams whose keys keep state, on Spark's processors of arbitrary state: token buckets, sessions, answers in chunks.

The state store must be RocksDB, which alone has several named states for a key (`store_session` gives a session with it).
A trigger hands a key's rows over in any order and in frames of bounded size. What must be walked in order is either sorted
at once, if it is little, or laid into state by slices of time, each with a timer of its own, and read back a slice at a
time: timers fire in order, so what a task holds of a key doesn't grow with the key's rows.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.forms import Forms
from .state import BURST, INTERVAL, RATE, admit, session_step

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a key that are sorted at once, and seconds of a slice where there are more.
AT_ONCE, SLICE_S = 10_000, 60
#: Timers of slices stand before all times of events, so they fire in the trigger that sets them.
_BEFORE = -(1 << 50)


def store_session(spark: SparkSession) -> SparkSession:
    """A new session on the same cluster whose streams keep their state in RocksDB; the caller's stays as it is."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set(STORE, ROCKSDB)
    return own


def _with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time_mode: str = "EventTime", time_column: str = "") -> DataFrame:
    if not rows.sparkSession.conf.get(STORE, "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"streams with state need {STORE}={ROCKSDB}; see store_session()")
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", time_mode, eventTimeColumnName=time_column)


def _packed(frame: pd.DataFrame) -> bytes:
    batch, out = pa.RecordBatch.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class InOrder(StatefulProcessor):
    """Walks a key's rows by (at, event_id). Subclasses say what state is (`kept`, a schema), what a row makes of it (`step`)
    and when it says no more than none would (`until`, seconds of event time): then a timer drops it."""

    kept, out = "", []

    def __init__(self, at_once: int = AT_ONCE, slice_s: float = SLICE_S):
        self.at_once, self.slice_s = at_once, slice_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"{self.kept}, timer long")
        self.waiting = handle.getMapState("waiting", "slice long, part int", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, many, parts = [], 0, None
        for frame in rows:
            held.append(frame)
            many += len(frame)
            if parts is None and many > self.at_once:
                parts = {}
            if parts is not None:
                for own in held:
                    self._lay(own, parts)
                held = []
        if held:
            yield self._walk(key, pd.concat(held))

    def _lay(self, frame: pd.DataFrame, parts: dict) -> None:
        for slice_, own in frame.groupby((frame["at"] // self.slice_s).astype("int64")):
            part = parts[slice_] = parts.get(slice_, -1) + 1
            self.waiting.updateValue((int(slice_), part), (_packed(own),))
            if not part:
                self.handle.registerTimer(_BEFORE + int(slice_))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at < _BEFORE // 2:
            slice_, frames = at - _BEFORE, []
            while self.waiting.containsKey((slice_, len(frames))):
                frames.append(_unpacked(bytes(self.waiting.getValue((slice_, len(frames)))[0])))
            for part in range(len(frames)):
                self.waiting.removeKey((slice_, part))
            yield self._walk(key, pd.concat(frames))
        elif self.state.exists() and self.state.get()[-1] == at:
            self.state.clear()

    def _walk(self, key, frame: pd.DataFrame) -> pd.DataFrame:
        before = tuple(self.state.get()) if self.state.exists() else None
        now, out = before[:-1] if before else None, []
        for row in frame.sort_values(["at", "event_id"]).to_dict("records"):
            now, made = self.step(now, row)
            out.append((row["event_id"], key[0], *made))
        timer = None if now is None else int(self.until(now) * 1000) + 1
        if before and before[-1] != timer:
            self.handle.deleteTimer(before[-1])
        if now is None:
            if before:
                self.state.clear()
        else:
            self.state.update((*now, timer))
            if not before or before[-1] != timer:
                self.handle.registerTimer(timer)
        return pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


class Buckets(InOrder):
    kept, out = "tokens double, updated double", ["event_id", "caller", "allowed", "retry_after"]

    def __init__(self, requests: int, interval: float, burst: int, **more):
        super().__init__(**more)
        self.policy, self.full_s = (requests, interval, burst), max(1, burst) * interval / requests if requests > 0 and interval > 0 else float(1 << 40)

    def step(self, now, row):
        now, ok, wait = admit(now, max(row["at"], now[1]) if now else row["at"], *self.policy)
        return now, (ok, wait)

    def until(self, now) -> float:
        return now[1] + self.full_s  # by then any bucket is full again, as a new one is


class Sessions(InOrder):
    kept, out = "partition string, expires double", ["event_id", "correlation", "op", "found"]

    def step(self, now, row):
        now, found = session_step(dict(zip(("partition", "expires"), now)) if now else None, row["op"], row["partition"], row["size"], row["at"])
        return (now["partition"], now["expires"]) if now else None, (row["op"], found)

    def until(self, now) -> float:
        return now[1]


def rate_limited_stream(log: DataFrame, requests: int = RATE, interval: float = INTERVAL, burst: int = BURST, late: str = "1 day", **order) -> DataFrame:
    """A streaming log (caller, ts, event_id) -> event_id, caller, allowed, retry_after: the rows of a trigger in the order of
    time, a bucket for each caller as state. It is dropped once the watermark, which waits for late rows, has passed the
    time at which it is full again. A row older than its caller's last one finds no tokens flown back."""
    rows = log.withWatermark("ts", late).select("caller", "ts", (F.unix_micros("ts") / 1e6).alias("at"), "event_id")
    return _with_state(rows, "caller", Buckets(requests, interval, burst, **order), "event_id long, caller string, allowed boolean, retry_after double")


def session_stream(ops: DataFrame, late: str = "1 day", **order) -> DataFrame:
    """A streaming log of session operations, with a session's partition and expiry as state, dropped once the watermark
    has passed the expiry."""
    rows = ops.withWatermark("ts", late).select("correlation", "ts", (F.unix_micros("ts") / 1e6).alias("at"), "event_id", "partition", "op", "size")
    return _with_state(rows, "correlation", Sessions(**order), "event_id long, correlation string, op string, found boolean")


def _rows(frame: pd.DataFrame) -> list[dict]:
    """Rows by seq as plain values: pandas makes floats of whole numbers beside nulls, which a state of whole numbers doesn't take."""
    plain = lambda v: None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, float) else v
    rows = [dict(zip(frame.columns, r)) for r in zip(*[[plain(v) for v in frame[c].tolist()] for c in frame.columns])]
    return sorted(rows, key=lambda r: (r["seq"] is None, r["seq"]))


#: Early rows of one page, which is what a key reads and writes of them at once.
PAGE = 64


class InSequence(StatefulProcessor):
    """Takes a key's rows by their number seq, from 0 on; rows that come early wait as state, those told twice are passed over.
    Subclasses name the columns that wait (`columns`), take a row (`take`, which returns rows to put out) and write what they hold
    back (`save`) at the end of a key's trigger.

    A call to the state store costs more than a row's work, so what a key carries is one value: its place, what the subclass
    carries, and the early rows of the page at its place. Those of later pages are in a map, a value a page."""

    columns, out = [], []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, near binary, far long, carried binary")
        self.pages = handle.getMapState("pages", "page long", "rows binary")
        self.states(handle)

    def states(self, handle) -> None:
        pass

    def _turn(self, page: int) -> None:
        """The early rows of the page at which the key is now."""
        self.near = self.fresh.pop(page, {})
        if self.far and (held := self.pages.getValue((page,))) is not None:
            self.pages.removeKey((page,))
            self.near, self.far = pickle.loads(held[0]) | self.near, self.far - 1

    def _lay(self) -> None:
        """Early rows of later pages into the map; far counts the pages there."""
        for page, rows in self.fresh.items():
            held = self.pages.getValue((page,)) if self.far else None
            self.pages.updateValue((page,), (pickle.dumps(rows | pickle.loads(held[0]) if held is not None else rows),))
            self.far += held is None
        self.fresh, self.many = {}, 0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.place.get()
        at, near, self.far, carried = before if before is not None else (0, None, 0, None)
        if at < 0:  # the stream has ended
            return
        self.near, self.fresh, self.many, self.ended = pickle.loads(near) if near else {}, {}, 0, False
        ready = self.load(pickle.loads(carried) if carried else None)
        for frame in rows:
            out = []
            for row in _rows(frame):
                if not ready:
                    ready = self.opens(row)
                seq = row["seq"]
                if seq is None or seq < at:
                    if not (ready and at in self.near):
                        continue
                elif not (ready and seq == at):
                    own = self.near if seq // PAGE == at // PAGE else self.fresh.setdefault(seq // PAGE, {})
                    self.many += own is not self.near and seq not in own
                    own.setdefault(seq, tuple(row[c] for c in self.columns))
                else:
                    self.near.setdefault(seq, tuple(row[c] for c in self.columns))
                while ready and at in self.near:
                    out += self.take(key, at, self.near.pop(at))
                    at += 1
                    if at % PAGE == 0:
                        self._turn(at // PAGE)
                if self.many >= AT_ONCE:
                    self._lay()
            if out:
                yield pd.DataFrame(out, columns=self.out)
        if self.ended:
            self.drop()
            for (page,) in list(self.pages.keys()) if self.far else []:
                self.pages.removeKey((page,))
            self.place.update((-1, None, 0, None))
        else:
            self._lay()
            self.place.update((at, pickle.dumps(self.near) if self.near else None, self.far, pickle.dumps(self.save())))

    def opens(self, row: dict) -> bool:
        return True

    def drop(self) -> None:
        pass

    def close(self) -> None:
        pass


class Lines(InSequence):
    columns, out = ["chunk", "last"], ["stream_id", "seq", "line", "last"]

    def load(self, carried) -> bool:
        self.line, tail = carried or (0, b"")
        self.tail = [tail]
        return True

    def take(self, key, seq, values) -> list:
        *lines, rest = bytes(values[0] or b"").split(b"\n")
        out = []
        for line in lines:
            whole = b"".join([*self.tail, line])
            out.append((key[0], self.line, whole.decode("utf-8", "replace"), False))
            self.line, self.tail = self.line + 1, []
        self.tail.append(rest)
        if values[1]:
            self.ended = True
            out.append((key[0], self.line, None, True))
        return out

    def save(self) -> tuple:
        return self.line, b"".join(self.tail)


def line_stream(chunks: DataFrame) -> DataFrame:
    """Streaming chunks (stream_id, seq from 0, chunk binary, last), in any order -> stream_id, seq, line, last: each line once
    it ends, numbered from 0, and after the last chunk a row without a line. Bytes are put together before they are read
    as UTF-8; a last line without an end isn't given out. State: the unfinished line, and chunks that came early."""
    return _with_state(chunks.select("stream_id", "seq", "chunk", "last"), "stream_id", Lines(), "stream_id long, seq long, line string, last boolean", "None")


class Folds(InSequence):
    columns, out = ["delta", "prompt", "completion", "failure", "last"], ["stream_id", "content", "prompt_tokens", "completion_tokens", "failure"]

    def states(self, handle) -> None:
        self.deltas = handle.getMapState("deltas", "part int", "delta string")

    def load(self, carried) -> bool:
        (self.now, self.parts), self.new = carried or ((None, None, None), 0), []
        return True

    def take(self, key, seq, values) -> list:
        delta, prompt, completion, failure, last = values
        if delta:
            self.new.append(delta)
        if prompt is not None or completion is not None or failure is not None:
            self.now = (*(max((x for x in pair if x is not None), default=None) for pair in zip(self.now, (prompt, completion))), failure if failure is not None else self.now[2])
        if not last:
            return []
        self.ended = True
        used = self.now[:2] if self.now[:2] == (None, None) else tuple(x or 0 for x in self.now[:2])
        return [(key[0], "".join([*(self.deltas.getValue((k,))[0] for k in range(self.parts)), *self.new]), *used, self.now[2])]

    def save(self) -> tuple:
        if self.new:
            self.deltas.updateValue((self.parts,), ("".join(self.new),))
            self.parts += 1
        return self.now, self.parts

    def drop(self) -> None:
        for part in range(self.parts):
            self.deltas.removeKey((part,))


def fold_stream(events: DataFrame) -> DataFrame:
    """Streaming events (stream_id, seq from 0, delta, usage, failure, last), in any order -> a row for each stream once its last
    event and all before it are there: content, usage as the highest of each side, the last failure. Deltas go into
    state a part a trigger and are read back once, at the end."""
    rows = events.select("stream_id", "seq", "delta", F.col("usage.prompt_tokens").alias("prompt"), F.col("usage.completion_tokens").alias("completion"), "failure", "last")
    return _with_state(rows, "stream_id", Folds(), "stream_id long, content string, prompt_tokens long, completion_tokens long, failure string", "None")


class Unmasked(InSequence):
    columns, out = ["chunk", "last"], ["stream_id", "seq", "text"]

    def load(self, carried) -> bool:
        self.session, self.tail = carried or (None, "")
        self.forms = None if self.session is None else Forms(json.loads(self.session))
        return self.forms is not None

    def opens(self, row: dict) -> bool:
        if row["session"] is None:
            return False
        self.session, self.forms = row["session"], Forms(json.loads(row["session"]))
        return True

    def take(self, key, seq, values) -> list:
        text, self.tail = self.forms.push(self.tail, values[0] or "")
        if values[1]:
            text, self.ended = text + self.forms.clear(self.tail), True
        return [(key[0], seq, text)]

    def save(self) -> tuple:
        return self.session, self.tail


def unmasked_live(chunks: DataFrame) -> DataFrame:
    """Streaming chunks (stream_id, seq from 0, chunk, last, session), in any order -> stream_id, seq, text: each chunk's clear part
    as it can go out. One row of a stream, whose seq may be null, brings its session (a map of forms to clear values);
    chunks before it wait. State: the session, and the held-back tail, which says where in its forms the stream stands."""
    rows = chunks.select("stream_id", "seq", "chunk", "last", F.to_json("session").alias("session"))
    return _with_state(rows, "stream_id", Unmasked(), "stream_id long, seq long, text string", "None")
