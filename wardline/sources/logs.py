"""Audit and completion logs as JSON lines, attachments as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT = "request string, tenant string, model string, disposition string, risk_score double, rule_ids array<string>, categories array<string>, max_severity string, content_bytes long, total_ms double, degraded boolean"
COMPLETION = "request string, model string, status int, cache_hit boolean, prompt_tokens long, completion_tokens long"


def audit_lines(audit: DataFrame) -> DataFrame:
    """One JSON object a row, '-' for a tenant or model that isn't known."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) if c in ("tenant", "model") else F.col(c).cast("string").alias(c) if c == "request" else F.col(c) for c in audit.columns]
    return audit.select(F.to_json(F.struct(*fields)).alias("value"))


def completion_lines(completions: DataFrame) -> DataFrame:
    """One JSON object a row; token fields only where usage was reported."""
    return completions.select(F.to_json(F.struct(F.col("request").cast("string").alias("request"), "model", "status", "cache_hit", "usage.prompt_tokens", "usage.completion_tokens")).alias("value"))


def write_lines(lines: DataFrame, path: str, mode: str = "append") -> None:
    lines.write.mode(mode).text(path)


def append_audit(audit: DataFrame, path: str, checkpoint: str, **trigger):
    """Start appending a stream of audit rows to a log: each micro-batch has a folder of its own, written whole, so one that
    is run again after a failure replaces its own lines and no other's."""

    def write(batch: DataFrame, number: int) -> None:
        write_lines(audit_lines(batch), f"{path}/batch={number}", "overwrite")

    return audit.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_audit(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """An audit log; more: columns (a schema) that its lines have besides."""
    return spark.read.schema(AUDIT + (f", {more}" if more else "")).json(path)


def read_completions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMPLETION).json(path)


def read_attachments(spark: SparkSession, path: str, media_type: str | None = None) -> DataFrame:
    """Files as (name, media_type, bytes)."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(media_type).alias("media_type"), F.col("content").alias("bytes"))
