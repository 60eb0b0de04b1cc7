"""Decisions for whole requests: guards, stages in order, audit, quarantine and completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dlp import redacted
from ..functions.payload import payload_findings
from ..functions.scan import FINDING, SEVERITIES, finding, multiplier, no_findings, role_trust, scan

MAX_BYTES, MAX_MESSAGES, THRESHOLD = 1_000_000, 1000, 0.7
STAGES = ("malware", "injection", "pii", "dlp")


def size_guard(content_bytes: Column, attachment_bytes: Column | int = 0, limit: int = MAX_BYTES) -> Column:
    return content_bytes + (attachment_bytes if isinstance(attachment_bytes, Column) else F.lit(attachment_bytes)) > limit


def guarded(requests: DataFrame, max_bytes: int = MAX_BYTES, max_messages: int = MAX_MESSAGES) -> DataFrame:
    """requests (bytes, n_messages) with guard: the rule that turns the request away, or null. The count is looked at
    only if the size passes."""
    guard = F.when(F.col("bytes") > max_bytes, "GW-001").when(F.col("n_messages") > max_messages, "GW-003")
    return requests.withColumn("guard", guard)


def stage_timings(timings: Column, budget: float = 50.0) -> Column:
    return F.transform(timings, lambda t: F.struct(t["stage"].alias("stage"), t["ms"].alias("ms"), (t["ms"] > budget).alias("timed_out")))


def budget_verdict(timings: Column, budget: float = 50.0, fail_closed: bool = True) -> Column:
    """(degraded, slow stage, blocked): the first stage over budget blocks where the policy fails closed."""
    slow = F.filter(timings, lambda t: t["ms"] > budget)
    first = F.when(F.size(slow) > 0, F.element_at(slow, 1)["stage"])
    return F.struct((F.size(slow) > 0).alias("degraded"), first.alias("slow_stage"), ((F.size(slow) > 0) & F.lit(fail_closed)).alias("blocked"))


def attached(files: DataFrame, suppressed: tuple[str, ...] = ()) -> DataFrame:
    """files (request, ord, bytes, media_type) -> a row a request: attachment_bytes, payload (findings in order), risk0."""
    rows = files.select("request", "ord", F.octet_length("bytes").alias("n"), payload_findings(F.col("bytes"), F.col("media_type")).alias("f"))
    rows = rows.withColumn("score", _stage_risk(F.col("f"), F.lit(1.0), suppressed))
    listed = F.array_sort(F.collect_list(F.struct("ord", "f")))
    return rows.groupBy("request").agg(F.sum("n").alias("attachment_bytes"), F.flatten(F.transform(listed, lambda x: x["f"])).alias("payload"), F.max("score").alias("risk0"))


def _stage_risk(findings: Column, times: Column, suppressed: tuple[str, ...]) -> Column:
    """What findings weigh, those of suppressed rules taken off, times the trust of the source."""
    total = F.aggregate(findings, F.lit(0.0), lambda a, f: a + f["weight"])
    if suppressed:
        off = F.aggregate(F.filter(findings, lambda f: f["rule_id"].isin(*suppressed)), F.lit(0.0), lambda a, f: a + f["weight"])
        total = F.greatest(F.lit(0.0), total - off)
    return F.least(F.lit(1.0), total * times)


def received(messages: DataFrame, attachments: DataFrame | None = None, max_bytes: int = MAX_BYTES, max_messages: int = MAX_MESSAGES) -> DataFrame:
    """A row a request: tenant, model, bytes (attachments among them), n_messages, payload, risk0, guard. Nothing is scanned, and
    lengths are summed before anything is shuffled."""
    size = (F.sum(F.octet_length(F.coalesce("text", F.lit("")))) + F.count("*") - 1).alias("bytes")
    by = messages.groupBy("request").agg(F.first("tenant").alias("tenant"), F.first("model").alias("model"), size, F.count("*").alias("n_messages"))
    if attachments is None:
        by = by.withColumns({"payload": no_findings(), "risk0": F.lit(0.0)})
    else:
        by = by.join(attachments, "request", "left").withColumns({"payload": F.coalesce("payload", no_findings()), "risk0": F.coalesce("risk0", F.lit(0.0))})
        by = by.withColumn("bytes", F.col("bytes") + F.coalesce("attachment_bytes", F.lit(0))).drop("attachment_bytes")
    return guarded(by, max_bytes, max_messages)


def scanned(messages: DataFrame, requests: DataFrame, threshold: float = THRESHOLD, cap_system: bool = False, normalize: bool = True) -> DataFrame:
    """The messages, scanned, of the requests that pass the guards and whose attachments don't end them. Texts are shuffled once,
    by request."""
    passed = requests.where(F.col("guard").isNull() & (F.col("risk0") < threshold)).select("request")
    rows = messages.repartition("request").join(passed, "request", "left_semi")
    return scan(rows.withColumn("trust", role_trust(F.col("role"), cap_system)), normalize=normalize)


def admitted(messages: DataFrame, attachments: DataFrame | None = None, threshold: float = THRESHOLD, max_bytes: int = MAX_BYTES, max_messages: int = MAX_MESSAGES, cap_system: bool = False, normalize: bool = True, rows: DataFrame | None = None) -> DataFrame:
    """(request, tenant, idx, text): the sanitized messages of the requests that reach the stage for personal data. rows:
    what scanned() gives of these messages, where it is at hand."""
    if rows is None:
        rows = scanned(messages, received(messages, attachments, max_bytes, max_messages), threshold, cap_system, normalize)
    stopped = rows.groupBy("request").agg(F.max("risk_score").alias("risk1")).where(F.col("risk1") >= threshold)
    return rows.join(stopped, "request", "left_anti").select("request", "tenant", "idx", F.col("cleaned").alias("text"))


def decided(messages: DataFrame, threshold: float = THRESHOLD, max_bytes: int = MAX_BYTES, max_messages: int = MAX_MESSAGES, cap_system: bool = False, masked: DataFrame | None = None, normalize: bool = True, attachments: DataFrame | None = None, suppressed: tuple[str, ...] = (), timings: DataFrame | None = None, budget: float = 50.0, fail_closed: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """One row a request: disposition, risk_score, findings in stage order, bytes, content, messages to forward, total_ms,
    degraded.

    messages: (request, tenant, model, idx, role, text). Guards come first and end a request with no content; then
    attachments, injection, personal data and redaction, each stage's risk the highest of its parts. The first stage
    that brings the risk to the threshold ends the request with its original text; later stages' findings are left
    out, and messages of requests that guards or attachments end aren't scanned. masked: (request, idx, masked,
    pii_findings) for the requests that reach that stage. attachments: as of attached(). suppressed: rules that are
    listed but don't weigh. timings: (request, timings array of (stage, ms)); a stage over budget degrades the request
    and, with fail_closed, ends it by GW-002. rows: what scanned() gives of these messages, where it is at hand.
    The messages are dealt out by request; all grouping uses that."""
    by = received(messages, attachments, max_bytes, max_messages)
    if rows is None:
        rows = scanned(messages, by, threshold, cap_system, normalize)
    rows = rows.select("request", "idx", "role", F.coalesce("text", F.lit("")).alias("text"), "cleaned", "findings", "was_modified", "trust")
    rows = rows.withColumn("stage2", F.col("cleaned")).withColumn("pii", no_findings())
    if masked is not None:
        rows = rows.drop("stage2", "pii").join(masked.select("request", "idx", F.col("masked").alias("stage2"), F.col("pii_findings").alias("pii")), ["request", "idx"], "left")
        rows = rows.withColumn("stage2", F.coalesce("stage2", "cleaned")).withColumn("pii", F.coalesce("pii", no_findings()))
    rows = redacted(rows, "stage2")
    one = F.struct(
        "idx", "role", "text", "dlp_text", (F.col("was_modified") | F.col("dlp_modified") | (F.col("stage2") != F.col("cleaned"))).alias("modified"), "findings", "pii", "dlp_findings",
        _stage_risk(F.col("findings"), multiplier(F.col("trust")), suppressed).alias("risk1"), _stage_risk(F.col("pii"), F.lit(1.0), suppressed).alias("risk2"),
        _stage_risk(F.col("dlp_findings"), multiplier(role_trust(F.col("role"))), suppressed).alias("risk3"),
    )
    live = rows.groupBy("request").agg(F.array_sort(F.collect_list(one)).alias("m"))
    by = by.join(live, "request", "left")
    if attachments is None:  # nothing ends a request before its messages are scanned but guards, which leave no content
        by = by.withColumn("said", F.expr("cast(null as array<struct<idx:int,text:string>>)"))
    else:
        ended = by.where(F.col("guard").isNull() & (F.col("risk0") >= threshold)).select("request")
        said = messages.join(ended, "request", "left_semi").groupBy("request").agg(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("text")))).alias("said"))
        by = by.join(said, "request", "left")
    none = F.expr("cast(array() as array<struct<stage:string,ms:double>>)")
    by = by.withColumn("timings", none) if timings is None else by.join(timings.select("request", "timings"), "request", "left").withColumn("timings", F.coalesce("timings", none))

    of = lambda name: F.transform("m", lambda x: x[name])
    listed = [F.col("payload"), *(F.coalesce(F.flatten(of(c)), no_findings()) for c in ("findings", "pii", "dlp_findings"))]
    risks = ["risk0", F.array_max(of("risk1")), F.array_max(of("risk2")), F.array_max(of("risk3"))]
    so_far = [F.coalesce(F.greatest(*risks[: k + 1]) if k else F.col("risk0"), F.col("risk0")) for k in range(4)]
    late_at = lambda stage: F.exists("timings", lambda t: (t["stage"] == stage) & (t["ms"] > budget))
    slow = [F.lit(fail_closed) & late_at(stage) for stage in STAGES]
    by = by.withColumns({f"r{k}": r for k, r in enumerate(so_far)} | {f"f{k}": F.concat(*listed[: k + 1]) for k in range(4)} | {f"slow{k}": x for k, x in enumerate(slow)})
    ends = F.when(F.col("guard").isNotNull(), -1)
    for k in range(4):
        ends = ends.when((F.col(f"r{k}") >= threshold) | F.col(f"slow{k}"), k)
    by = by.withColumn("ends", ends)
    last = F.coalesce("ends", F.lit(3))
    pick = lambda name: F.element_at(F.array(*[F.col(f"{name}{k}") for k in range(4)]), F.greatest(last, F.lit(0)) + 1)
    late = F.col("ends").isNotNull() & (pick("r") < threshold)
    over = F.when(late, F.array(finding("GW-002", "anomaly", "high", 1.0, 1))).otherwise(no_findings())
    guard = F.array(F.when(F.col("guard") == "GW-001", finding("GW-001", "anomaly", "high", 1.0, 1)).otherwise(finding("GW-003", "anomaly", "high", 1.0, 1)))
    stopped = F.col("ends").isNotNull()
    text = F.coalesce(of("text"), F.transform("said", lambda x: x["text"]))
    measured = F.filter("timings", lambda t: (F.array_position(F.array(*map(F.lit, STAGES)), t["stage"]) - 1) <= last)
    return by.select(
        "request", "tenant", "model", F.when(stopped, "block").when(F.exists("m", lambda x: x["modified"]), "allow_modified").otherwise("allow").alias("disposition"),
        F.when((last < 0) | late, 1.0).otherwise(pick("r")).alias("risk_score"), F.when(last < 0, guard).otherwise(F.concat(pick("f"), over)).alias("findings"),
        F.when(last < 0, "").otherwise(F.array_join(F.when(stopped, text).otherwise(of("dlp_text")), "\n")).alias("content"),
        F.when(~stopped, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["dlp_text"].alias("content")))).alias("forwarded"), F.col("bytes").cast("long").alias("bytes"), F.col("n_messages").cast("int").alias("n_messages"),
        F.when(last < 0, 0.0).otherwise(F.aggregate(measured, F.lit(0.0), lambda a, t: a + t["ms"])).alias("total_ms"),
        ((last >= 0) & F.exists(measured, lambda t: t["ms"] > budget)).alias("degraded"),
    )


def arrived(messages: DataFrame, threshold: float = THRESHOLD, max_bytes: int = MAX_BYTES, cap_system: bool = False, normalize: bool = True) -> DataFrame:
    """A decision for each message by itself, as it arrives: (request, tenant, model, idx, role, text) -> request, idx, tenant, model,
    disposition, risk_score, findings, content, total_ms, degraded. Size guard, then injection, then redaction; the first that
    reaches the threshold ends it with the original text. Nothing is grouped, so it runs on streams."""
    text = F.coalesce("text", F.lit(""))
    rows = redacted(scan(messages.withColumn("text", text).withColumn("trust", role_trust(F.col("role"), cap_system)), normalize=normalize), "cleaned")
    one = _stage_risk(F.col("findings"), multiplier(F.col("trust")), ())
    both = F.greatest(one, _stage_risk(F.col("dlp_findings"), multiplier(role_trust(F.col("role"))), ()))
    ends = F.when(F.octet_length("text") > max_bytes, 0).when(one >= threshold, 1).when(both >= threshold, 2).otherwise(3)
    rows = rows.withColumn("ends", ends)
    too_large = F.array(finding("GW-001", "anomaly", "high", 1.0, 1))
    changed = F.col("was_modified") | F.col("dlp_modified")
    return rows.select(
        "request", "idx", "tenant", "model", F.when(F.col("ends") < 3, "block").when(changed, "allow_modified").otherwise("allow").alias("disposition"),
        F.when(F.col("ends") == 0, 1.0).when(F.col("ends") == 1, one).otherwise(both).alias("risk_score"),
        F.when(F.col("ends") == 0, too_large).when(F.col("ends") == 1, F.col("findings")).otherwise(F.concat("findings", "dlp_findings")).alias("findings"),
        F.when(F.col("ends") == 0, "").when(F.col("ends") < 3, F.col("text")).otherwise(F.col("dlp_text")).alias("content"), F.lit(0.0).alias("total_ms"), F.lit(False).alias("degraded"),
    )


def audited(decisions: DataFrame, key: tuple[str, ...] = ("request",)) -> DataFrame:
    """Payload-free audit rows, with the columns of key: rule ids in finding order with repeats, categories once each in order, the highest
    severity, bytes of content (0 for guard blocks), total time, and whether a stage was over its budget."""
    ranks = F.transform("findings", lambda f: F.array_position(F.array(*map(F.lit, SEVERITIES)), f["severity"]).cast("int"))
    top = F.when(F.size("findings") > 0, F.element_at(F.array(*map(F.lit, SEVERITIES)), F.array_max(ranks)))
    return decisions.select(
        *key, F.coalesce("tenant", F.lit("-")).alias("tenant"), F.coalesce("model", F.lit("-")).alias("model"), "disposition", "risk_score",
        F.transform("findings", lambda f: f["rule_id"]).alias("rule_ids"), F.array_distinct(F.transform("findings", lambda f: f["category"])).alias("categories"),
        top.alias("max_severity"), F.octet_length("content").cast("long").alias("content_bytes"), "total_ms", "degraded",
    )


def refusals(refused: DataFrame) -> DataFrame:
    """Audit rows of rate refusals: blocked, risk 1.0, GW-004. refused: (request, tenant, model)."""
    return refused.select(
        "request", F.coalesce("tenant", F.lit("-")).alias("tenant"), F.coalesce("model", F.lit("-")).alias("model"), F.lit("block").alias("disposition"), F.lit(1.0).alias("risk_score"),
        F.array(F.lit("GW-004")).alias("rule_ids"), F.array(F.lit("anomaly")).alias("categories"), F.lit("high").alias("max_severity"), F.lit(0).cast("long").alias("content_bytes"),
        F.lit(0.0).alias("total_ms"), F.lit(False).alias("degraded"),
    )


def completions(answers: DataFrame) -> DataFrame:
    """Completion rows of answers (request, asked_model, model, prompt_tokens, completion_tokens, ok, cache_hit): the
    provider's model or else the one asked for, status 200 or 502, usage null where none was reported."""
    usage = F.when(F.col("prompt_tokens").isNotNull() | F.col("completion_tokens").isNotNull(), F.struct(F.coalesce("prompt_tokens", F.lit(0)).cast("long").alias("prompt_tokens"), F.coalesce("completion_tokens", F.lit(0)).cast("long").alias("completion_tokens")))
    return answers.select("request", F.coalesce(F.when(F.col("model") != "", F.col("model")), "asked_model").alias("model"), F.when(F.col("ok"), 200).otherwise(502).alias("status"), usage.alias("usage"), "cache_hit")


def linked(audit: DataFrame, completion: DataFrame) -> DataFrame:
    """Audit rows with their completion; those without were blocked or died."""
    return audit.join(completion.drop("model"), "request", "left")


def near_miss(disposition: Column, risk: Column, threshold: float = THRESHOLD, band: float = 0.15, enabled: bool = True) -> Column:
    return F.lit(enabled) & ((disposition == "block") | (F.lit(band > 0) & (risk >= threshold - band)))


def quarantined(decisions: DataFrame, raw: DataFrame, at: Column, detail: str = "masked", masked: DataFrame | None = None, retention_s: int = 604_800, threshold: float = THRESHOLD, band: float = 0.15) -> DataFrame:
    """Samples of blocked and nearly blocked requests. raw: (request, raw). Without a stage for personal data 'masked'
    falls back to counts."""
    level = detail if detail != "masked" or masked is not None else "counts"
    rows = audited(decisions.where(near_miss(F.col("disposition"), F.col("risk_score"), threshold, band)))
    if level == "raw":
        rows = rows.join(raw.select("request", F.col("raw").alias("sample")), "request", "left")
    elif level == "masked":
        rows = rows.join(masked.select("request", F.col("masked").alias("sample")), "request", "left")
    else:
        rows = rows.withColumn("sample", F.lit(None).cast("string"))
    return rows.drop("max_severity", "content_bytes", "total_ms", "degraded").withColumn("detail", F.lit(level)).withColumn("expires_at", at + F.expr(f"make_interval(0,0,0,0,0,0,{retention_s})"))


def swept(samples: DataFrame, now: Column, keep: int = 1000) -> DataFrame:
    """Samples that haven't expired, the newest keep of them."""
    return samples.where(F.col("expires_at") > now).orderBy(F.desc("expires_at"), "request").limit(keep)
