"""Captured answer streams: lines out of captures or chunks, deltas, usage, failures, and the fold of a whole stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dialects import _kind, _number, _text, parsed, usage, usage_of


def payloads(captures: DataFrame, sse: bool) -> DataFrame:
    """captures (stream_id, body) -> stream_id, seq, payload. Server-sent events: what follows 'data:', trimmed, if there
    is any; JSON lines: each line that isn't blank. A last line without an end isn't taken."""
    parts = F.split("body", "\n")  # cut before the explode: what stands beside it is made again for every line
    lines = captures.select("stream_id", F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("seq", "raw"))
    text = F.trim(F.regexp_replace("raw", "\r$", ""))
    if sse:
        lines = lines.where(F.startswith(text, F.lit("data:")))
        text = F.trim(F.substring(text, 6, 1 << 30))
    return lines.select("stream_id", F.col("seq").cast("long"), text.alias("payload")).where("payload <> ''")


def reassembled(chunks: DataFrame) -> DataFrame:
    """chunks (stream_id, seq, chunk binary) -> stream_id, body: bytes are put together before they are read as UTF-8, so
    a character may be cut anywhere."""
    whole = chunks.groupBy("stream_id").agg(F.expr("listagg(chunk) WITHIN GROUP (ORDER BY seq)").alias("body"))
    return whole.select("stream_id", F.decode("body", "UTF-8").alias("body"))


def deltas(events: DataFrame, dialect: str) -> DataFrame:
    """events (stream_id, seq, payload) with delta, usage, failure."""
    v = F.col("_v")
    out = events.withColumn("_v", parsed(F.col("payload")))
    kind = _text(v, "$.type")
    if dialect == "openai":
        delta, used = _text(v, "$.choices[0].delta.content"), usage_of(v, "$.usage")
    elif dialect == "anthropic":
        delta = F.when(kind == "content_block_delta", _text(v, "$.delta.text"))
        none = F.lit(None).cast("long")
        used = F.when(kind == "message_start", usage(_number(v, "$.message.usage.input_tokens", "long"), _number(v, "$.message.usage.output_tokens", "long"))).when(kind == "message_delta", usage(none, _number(v, "$.usage.output_tokens", "long")))
    else:
        delta = _text(v, "$.message.content")
        used = F.when(F.try_variant_get(v, "$.done", "boolean"), usage(_number(v, "$.prompt_eval_count", "long"), _number(v, "$.eval_count", "long")))
    return out.select(*events.columns, F.nullif(delta, F.lit("")).alias("delta"), used.alias("usage"), failure(v).alias("failure"))


def failure(v: Column) -> Column:
    """An in-band failure: an error string, or an error object's message."""
    error = F.try_variant_get(v, "$.error", "variant")
    is_object = F.startswith(_kind(error), F.lit("OBJECT"))
    return F.coalesce(_text(v, "$.error"), F.when(is_object, F.coalesce(_text(v, "$.error.message"), F.lit("upstream stream error"))))


def folded(events: DataFrame) -> DataFrame:
    """A row a stream: deltas put together in order, usage as the highest of each side, the last failure."""
    return events.groupBy("stream_id").agg(
        F.coalesce(F.expr("listagg(delta) WITHIN GROUP (ORDER BY seq)"), F.lit("")).alias("content"),
        usage(F.max("usage.prompt_tokens"), F.max("usage.completion_tokens")).alias("usage"), F.max_by("failure", F.when(F.col("failure").isNotNull(), F.col("seq"))).alias("failure"),
    )
