"""Queries: dialects, captured streams, logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import decide
from ..operators.storage import shared_path
from ..sources import dialects, logs, streams
from ..streaming import keyed
from .fixtures import MESSAGES_SQL, chunked, derived, messages, query, replayed, sevens, table
from .screening import _BYTES_SQL, ANSWERS, G, _AUDIT, _attachments, _decided

DIALECTS = ("openai", "anthropic", "ollama")


def _canonical(spark, d):
    """Requests as the survey's canonical rows, made from the conversations."""
    by = messages(spark, d).groupBy("request").agg(F.array_sort(F.collect_list(F.struct("idx", "role", "text"))).alias("m"))
    return by.select(
        "request", F.concat(F.lit("m"), (F.col("request") % 3).cast("string")).alias("model"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"),
        (F.col("request") % 2 == 0).alias("stream"), F.when(F.col("request") % 3 > 0, (F.col("request") % 3) / 4).alias("temperature"), F.when(F.col("request") % 5 > 0, F.lit(256)).alias("max_tokens"),
    )


def _lines(spark, d, dialect):
    """Request lines; some are broken, some have fields that a gateway must not drop, some carry images."""
    line = F.col("line")
    odd = (
        F.when(F.col("request") % 17 == 1, F.lit("not json")).when(F.col("request") % 17 == 2, F.regexp_replace(line, r"\}$", ',"tools":[]}'))
        .when(F.col("request") % 17 == 3, F.regexp_replace(line, '"messages":\\[', '"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"image"}]},'))
        .when(F.col("request") % 17 == 4, F.regexp_replace(line, '"messages":\\[', '"messages":[{"role":"wizard","content":[{"type":"text","text":"a"},{"text":"b"}]},{"content":"no role"},'))
        .otherwise(line)
    )
    return dialects.exported(_canonical(spark, d), dialect).select("request", odd.alias("line"))


def _told(messages):
    """Roles and contents of messages in order, as one text."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("\x1f"), m["content"])), "\x1e")


#: The messages of each request in order, in SQL: as they are, and as a dialect hands them on.
_OWN_SQL = f"""WITH m AS ({MESSAGES_SQL}), w AS (SELECT request, list(role || chr(31) || text ORDER BY idx) AS plain, list(role ORDER BY idx) AS roles, string_agg(text, chr(10) ORDER BY idx) FILTER (role = 'system') AS system,
 coalesce(list(CASE role WHEN 'tool' THEN 'user' ELSE role END || chr(31) || text ORDER BY idx) FILTER (role <> 'system'), []) AS rest FROM m GROUP BY request)"""
_GIVEN = {"openai": "plain", "ollama": "plain", "anthropic": "CASE WHEN system <> '' THEN ['system' || chr(31) || system] ELSE [] END || rest"}
_ODD = {"openai": "[x] || plain", "ollama": "[x] || plain", "anthropic": "CASE WHEN system <> '' THEN ['system' || chr(31) || system] ELSE [] END || [x] || rest"}
_MOST = {"openai": "CASE WHEN request % 5 > 0 THEN 256 END", "ollama": "CASE WHEN request % 5 > 0 THEN 256 END", "anthropic": "CASE WHEN request % 5 > 0 THEN 256 ELSE 4096 END"}


def _decoded_sql(dialect: str, given: str, error: str = "NULL::VARCHAR") -> str:
    """What decoding gives: the columns of a request without an error, null for one with."""
    columns = {
        "model": "concat('m', cast(request % 3 as string))", "n_messages": f"len({given})", "messages_sha256": f"sha256(array_to_string({given}, chr(30)))", "stream": "request % 2 = 0",
        "temperature": "CASE WHEN request % 3 > 0 THEN (request % 3) / 4 END", "max_tokens": _MOST[dialect],
    }
    return f"SELECT request, {', '.join(f'CASE WHEN error IS NULL THEN {e} END AS {c}' for c, e in columns.items())}, error FROM (SELECT *, {error} AS error, 'user' || chr(31) || 'ab' AS x FROM w)"


_ERRORS = {d: f"CASE request % 17 WHEN 1 THEN 'not a JSON object' WHEN 2 THEN 'unsupported field tools' WHEN 3 THEN 'binary content' END" for d in DIALECTS}


def _columns(r):
    return r.select("request", "model", F.size("messages").cast("long").alias("n_messages"), F.sha2(_told(F.col("messages")), 256).alias("messages_sha256"), "stream", "temperature", "max_tokens", "error")


def _decode(name, dialect):
    @query(name, f"{_OWN_SQL} {_decoded_sql(dialect, f'CASE WHEN request % 17 = 4 THEN {_ODD[dialect]} ELSE {_GIVEN[dialect]} END', _ERRORS[dialect])}")
    def q(spark, d):
        return _columns(dialects.requests(_lines(spark, d, dialect), dialect))


_decode("S01_openai_requests", "openai")
_decode("S02_anthropic_requests", "anthropic")
_decode("S03_ollama_requests", "ollama")


@query("S04_rejected_fields", "SELECT request, CASE WHEN request % 17 = 2 THEN 'tools' END AS field FROM (SELECT DISTINCT conv_id AS request FROM conversations)")
def s04(spark, d):
    return _lines(spark, d, "openai").select("request", dialects.rejected_field(dialects.parsed(F.col("line")), "openai").alias("field"))


@query("S05_flattened_content", "SELECT conv_id AS request, turn AS idx, sha256(CASE (conv_id + turn) % 3 WHEN 0 THEN text WHEN 1 THEN text || text ELSE '' END) AS content_sha256 FROM conversations")
def s05(spark, d):
    block = F.struct(F.lit("text").alias("type"), "text")
    kind = (F.col("conv_id") + F.col("turn")) % 3
    line = F.when(kind == 0, F.to_json(F.struct(F.col("text").alias("content")))).when(kind == 1, F.to_json(F.struct(F.array(block, block).alias("content")))).otherwise(F.lit('{"content":5}'))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("request"), F.col("turn").alias("idx"), F.try_variant_get(F.try_parse_json(line), "$.content", "variant").alias("c"))
    return rows.select("request", "idx", F.sha2(dialects.flattened(F.col("c")), 256).alias("content_sha256"))


@query("S06_binary_blocks", "SELECT request, request % 17 = 3 AS has_binary FROM (SELECT DISTINCT conv_id AS request FROM conversations)")
def s06(spark, d):
    v = dialects.parsed(F.col("line"))
    entries = F.try_variant_get(v, "$.messages", "array<variant>")
    return _lines(spark, d, "openai").select("request", F.coalesce(F.exists(entries, lambda e: dialects.carries_binary(F.try_variant_get(e, "$.content", "variant"))), F.lit(False)).alias("has_binary"))


@query("S07_message_roles", f"{_OWN_SQL} SELECT request, CASE WHEN request % 17 <> 1 THEN array_to_string(CASE WHEN request % 17 IN (3, 4) THEN ['user'] ELSE [] END || roles, ',') END AS roles FROM w")
def s07(spark, d):
    entries = F.try_variant_get(dialects.parsed(F.col("line")), "$.messages", "array<variant>")
    return _lines(spark, d, "openai").select("request", F.array_join(F.transform(dialects.messages_of(entries), lambda m: m["role"]), ",").alias("roles"))


RESPONSE = {
    "openai": "concat('{\"model\":\"', model, '\",\"choices\":[{\"message\":{\"content\":\"a', cast(event_id as string), '\"},\"finish_reason\":\"stop\"}]', CASE WHEN value >= 5 THEN concat(',\"usage\":{\"prompt_tokens\":', cast(cast(floor(value) as bigint) as string), '}') ELSE '' END, '}')",
    "anthropic": "concat('{\"model\":\"', model, '\",\"content\":[{\"type\":\"text\",\"text\":\"a', cast(event_id as string), '\"}],\"stop_reason\":\"end_turn\"', CASE WHEN value >= 5 THEN concat(',\"usage\":{\"input_tokens\":', cast(cast(floor(value) as bigint) as string), ',\"output_tokens\":3}') ELSE '' END, '}')",
    "ollama": "concat('{\"model\":\"', model, '\",\"message\":{\"content\":\"a', cast(event_id as string), '\"},\"done_reason\":\"stop\"', CASE WHEN value >= 5 THEN concat(',\"eval_count\":', cast(cast(floor(value) as bigint) as string)) ELSE '' END, '}')",
}


@query("S08_responses", """SELECT event_id, concat('m', cast(user_id % 3 as string)) AS model, concat('a', cast(event_id as string)) AS content,
 CASE WHEN value >= 5 THEN CASE event_id % 3 WHEN 2 THEN 0 ELSE cast(floor(value) as bigint) END END AS prompt_tokens, CASE WHEN value >= 5 THEN CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE cast(floor(value) as bigint) END END AS completion_tokens,
 CASE event_id % 3 WHEN 1 THEN 'end_turn' ELSE 'stop' END AS finish_reason FROM events""")
def s08(spark, d):
    rows = table(spark, d, "events").withColumn("model", F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")))
    out = [dialects.responses(rows.where(F.col("event_id") % 3 == i).select("event_id", F.expr(RESPONSE[x]).alias("line")), x) for i, x in enumerate(DIALECTS)]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("event_id", "model", "content", "usage.prompt_tokens", "usage.completion_tokens", "finish_reason")


@query("S09_token_usage", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN user_id ELSE 0 END AS prompt_tokens, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 0 ELSE user_id END AS completion_tokens FROM events")
def s09(spark, d):
    uid = F.col("user_id").cast("string")
    line = F.when(F.col("event_id") % 3 == 0, "{}").when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"prompt_tokens":'), uid, F.lit("}"))).otherwise(F.concat(F.lit('{"completionTokens":'), uid, F.lit("}")))
    return table(spark, d, "events").select("event_id", dialects.usage_of(dialects.parsed(line)).alias("u")).select("event_id", "u.prompt_tokens", "u.completion_tokens")


@query("S10_exported_round_trip", _OWN_SQL + " " + " UNION ALL ".join(f"SELECT '{x}' AS dialect, * FROM ({_decoded_sql(x, _GIVEN[x])})" for x in DIALECTS))
def s10(spark, d):
    own, out = _canonical(spark, d), []
    for x in DIALECTS:
        back = dialects.requests(dialects.exported(own, x).select("request", "line"), x)
        out.append(_columns(back).withColumn("dialect", F.lit(x)))
    return out[0].unionByName(out[1]).unionByName(out[2])


def _events(spark, d, dialect):
    """A capture for each answer of a conversation: an event for every seven characters, usage at the end."""
    rows = table(spark, d, "conversations").where("role = 'assistant'")
    pieces = F.concat(sevens(F.col("text")), F.when(F.length("text") % 7 == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^.{5}(.*).$", 1)
    shape = {"openai": ('{"choices":[{"delta":{"content":', "}}]}"), "anthropic": ('{"type":"content_block_delta","delta":{"text":', "}}"), "ollama": ('{"message":{"content":', "}}")}[dialect]
    end = {"openai": '{"choices":[],"usage":{"prompt_tokens":3,"completion_tokens":9}}', "anthropic": '{"type":"message_delta","usage":{"output_tokens":9}}', "ollama": '{"done":true,"eval_count":9}'}[dialect]
    prefix = F.lit("" if dialect == "ollama" else "data: ")
    events = F.transform(pieces, lambda p: F.concat(prefix, F.lit(shape[0]), quoted(p), F.lit(shape[1])))
    tail = [F.concat(prefix, F.lit(end))] + ([F.lit('data: {"error":{"message":"late"}}')] if dialect == "openai" else [])
    body = F.concat(F.array_join(F.concat(events, F.array(*tail)), "\n\n"), F.lit("\n"), F.lit("data: cut off"))
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), body.alias("body"), "text")


_CUT = "SELECT conv_id * 1000 + turn AS stream_id, len(text) // 7 + 1 AS pieces, list_sum(list_transform(range(0, len(text) // 7 + 1), lambda i: len(to_json(substr(text, i * 7 + 1, 7))))) AS quoted, text FROM conversations WHERE role = 'assistant'"


@query("S12_sse_payloads", f"""SELECT stream_id, pieces + 2 AS payloads, quoted + pieces * len('{{"choices":[{{"delta":{{"content":}}}}]}}') + len('{{"choices":[],"usage":{{"prompt_tokens":3,"completion_tokens":9}}}}{{"error":{{"message":"late"}}}}') AS chars FROM ({_CUT})""")
def s12(spark, d):
    return streams.payloads(_events(spark, d, "openai"), True).groupBy("stream_id").agg(F.count("*").alias("payloads"), F.sum(F.length("payload")).alias("chars"))


@query("S13_ndjson_payloads", f"""SELECT stream_id, pieces + 1 AS payloads, quoted + pieces * len('{{"message":{{"content":}}}}') + len('{{"done":true,"eval_count":9}}') AS chars FROM ({_CUT})""")
def s13(spark, d):
    return streams.payloads(_events(spark, d, "ollama"), False).groupBy("stream_id").agg(F.count("*").alias("payloads"), F.sum(F.length("payload")).alias("chars"))


@query("S14_reassembled_chunks", "SELECT doc_id AS stream_id, sha256(text) AS body_sha256 FROM documents WHERE octet_length(encode(text)) > 0")
def s14(spark, d):
    data = F.encode(F.col("text"), "UTF-8")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / 997)), lambda i: F.substring(data, (i * 997 + 1).cast("int"), F.lit(997)))
    chunks = table(spark, d, "documents").where("octet_length(text) > 0").select(F.col("doc_id").alias("stream_id"), F.posexplode(cut).alias("seq", "chunk"))
    return streams.reassembled(chunks).select("stream_id", F.sha2("body", 256).alias("body_sha256"))


@query("S14_streamed_lines", """SELECT request AS stream_id, unnest(range(0, len(parts) - 1)) AS seq, unnest(list_transform(parts[:-2], lambda p: sha256(p))) AS line_sha256
 FROM (SELECT doc_id AS request, string_split(text, chr(10)) AS parts FROM documents WHERE octet_length(encode(text)) > 0) WHERE len(parts) > 1""")
def s14_streamed(spark, d):
    """The documents as streams of chunks of 997 bytes, each trigger with a part of every stream's chunks, the early ones too."""
    rows = chunked(table(spark, d, "documents").where("octet_length(text) > 0").select(F.col("doc_id").alias("stream_id"), F.encode("text", "UTF-8").alias("data")), 997)
    lines = replayed(spark, rows, keyed.line_stream, "trigger")
    return lines.where("not last").select("stream_id", "seq", F.sha2("line", 256).alias("line_sha256"))


def _deltas(spark, d, dialect):
    return streams.deltas(streams.payloads(_events(spark, d, dialect), dialect != "ollama"), dialect)


@query("S15_S16_deltas_and_usage", f"SELECT stream_id, cast(ceil(len(text) / 7) as bigint) AS deltas, 9 AS completion_tokens, dialect FROM ({_CUT}), (SELECT unnest(['openai', 'anthropic', 'ollama']) AS dialect)")
def s15(spark, d):
    out = []
    for x in DIALECTS:
        out.append(_deltas(spark, d, x).groupBy("stream_id").agg(F.count("delta").alias("deltas"), F.max("usage.completion_tokens").alias("completion_tokens")).withColumn("dialect", F.lit(x)))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("S17_failures", "SELECT conv_id * 1000 + turn AS stream_id, 'late' AS failure FROM conversations WHERE role = 'assistant'")
def s17(spark, d):
    return _deltas(spark, d, "openai").where("failure is not null").select("stream_id", "failure")


@query("S18_folded_streams", "SELECT conv_id * 1000 + turn AS stream_id, sha256(text) AS content_sha256, 9 AS completion_tokens FROM conversations WHERE role = 'assistant'")
def s18(spark, d):
    f = streams.folded(_deltas(spark, d, "anthropic"))
    return f.select("stream_id", F.sha2("content", 256).alias("content_sha256"), F.col("usage.completion_tokens").cast("int").alias("completion_tokens"))


@query("S18_streamed_folds", "SELECT conv_id * 1000 + turn AS stream_id, sha256(text) AS content_sha256, 9 AS completion_tokens FROM conversations WHERE role = 'assistant'")
def s18_streamed(spark, d):
    """The captures as streams of chunks of 100 bytes, each trigger with a part of every stream's, put together to lines as they
    come; the lines' events folded by a second stream."""
    rows = chunked(_events(spark, d, "anthropic").select("stream_id", F.encode("body", "UTF-8").alias("data")), 100)
    lines = replayed(spark, rows, keyed.line_stream, "trigger")
    payload = F.when(F.startswith("line", F.lit("data:")), F.trim(F.substring("line", 6, 1 << 30)))
    events = streams.deltas(lines.withColumn("payload", payload), "anthropic").withColumn("trigger", F.col("seq") % 3)
    f = replayed(spark, events, keyed.fold_stream, "trigger")
    return f.select("stream_id", F.sha2("content", 256).alias("content_sha256"), F.col("completion_tokens").cast("int").alias("completion_tokens"))


@query("S19_next_stage", "SELECT conv_id, turn, CASE WHEN text <> '' THEN sha256(text) END AS delta_sha256, turn AS prompt_tokens, NULL::VARCHAR AS failure FROM conversations WHERE turn % 5 <> 4")
def s19(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 == 4, "oops").otherwise(F.to_json(F.struct(F.col("text").alias("delta"), F.struct(F.col("turn").alias("prompt_tokens")).alias("usage")))).alias("line"))
    return dialects.next_stage(rows).select("conv_id", "turn", F.sha2("delta", 256).alias("delta_sha256"), "usage.prompt_tokens", "failure")


@query("S19_next_stage_answers", """SELECT event_id, CASE WHEN event_id % 4 > 0 THEN concat('a', cast(event_id as string)) END AS content, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'm' END AS model, CASE WHEN event_id % 4 > 2 THEN 'stop' END AS finish_reason,
 CASE WHEN event_id % 4 > 2 THEN user_id END AS prompt_tokens, CASE WHEN event_id % 4 = 0 THEN 'no content' END AS error FROM events""")
def s19_answers(spark, d):
    """One-shot answers of the next stage, each with one field more than the one before; without content it is an error."""
    k = F.col("event_id") % 4
    fields = F.struct(
        F.when(k > 0, F.concat(F.lit("a"), F.col("event_id").cast("string"))).alias("content"), F.when(k > 1, F.lit("m")).alias("model"), F.when(k > 2, F.lit("stop")).alias("finish_reason"),
        F.when(k > 2, F.struct(F.col("user_id").alias("promptTokens"))).alias("usage"),
    )
    rows = table(spark, d, "events").select("event_id", F.to_json(fields).alias("line"))
    return dialects.next_stage_response(rows).select("event_id", "content", "model", "finish_reason", "usage.prompt_tokens", "error")


@query("S20_handoff_lines", f"{G} SELECT cast(request as string) AS correlation_id, 'correlation_id,principal,request,verdict' AS keys, 'a,b' AS scopes, tenant, disposition, round(risk, 6) AS risk_score, array_to_string(rules, ',') AS rules, sha256(roles) AS messages_sha256 FROM z WHERE ends IS NULL")
def s20(spark, d):
    rows = _decided(spark, d).where("forwarded is not null").withColumns({"subject": F.lit("s"), "scopes": F.array(F.lit("b"), F.lit("a")), "stream": F.lit(False), "temperature": F.lit(None).cast("double"), "max_tokens": F.lit(64)})
    lines = dialects.handoffs(rows)
    shape = "struct<correlation_id:string,principal:struct<scopes:array<string>,tenant:string>,request:struct<messages:array<struct<content:string,role:string>>>,verdict:struct<disposition:string,risk_score:double,findings:array<struct<rule:string>>>>"
    read = lines.select(F.array_join(F.json_object_keys("line"), ",").alias("keys"), F.from_json("line", shape).alias("r"))
    return read.select(
        "r.correlation_id", "keys", F.array_join("r.principal.scopes", ",").alias("scopes"), "r.principal.tenant", "r.verdict.disposition", F.round("r.verdict.risk_score", 6).alias("risk_score"),
        F.array_join("r.verdict.findings.rule", ",").alias("rules"), F.sha2(_told(F.col("r.request.messages")), 256).alias("messages_sha256"),
    )


@query("S21_audit_log", f"{G}, a AS ({_AUDIT}) SELECT cast(request as string) AS request, tenant, model, disposition, risk_score, rule_ids, categories, max_severity, content_bytes FROM a")
def s21(spark, d):
    path = shared_path(spark, f"audit-log-{uuid.uuid4().hex}")
    logs.write_lines(logs.audit_lines(decide.audited(_decided(spark, d))), path)
    rows = logs.read_audit(spark, path).drop("total_ms", "degraded")
    return rows.withColumns({"rule_ids": F.array_join("rule_ids", ","), "categories": F.array_join("categories", ","), "risk_score": F.round("risk_score", 6)})


@query("S22_completion_log", f"""WITH a AS (SELECT {', '.join(f'{e} AS {c}' for c, e in ANSWERS.items())} FROM events)
 SELECT cast(request as string) AS request, CASE WHEN model <> '' THEN model ELSE asked_model END AS model, CASE WHEN ok THEN 200 ELSE 502 END AS status, cache_hit, prompt_tokens,
 CASE WHEN prompt_tokens IS NOT NULL THEN coalesce(completion_tokens, 0) END AS completion_tokens, prompt_tokens IS NOT NULL AS has_usage FROM a""")
def s22(spark, d):
    path = shared_path(spark, f"completion-log-{uuid.uuid4().hex}")
    logs.write_lines(logs.completion_lines(decide.completions(derived(table(spark, d, "events"), ANSWERS))), path)
    said = spark.read.text(path).where(F.contains("value", F.lit("prompt_tokens"))).select(F.get_json_object("value", "$.request").alias("request"), F.lit(True).alias("has_usage"))
    return logs.read_completions(spark, path).join(said, "request", "left").withColumn("has_usage", F.coalesce("has_usage", F.lit(False)))


@query("S23_embedding_responses", "SELECT vec_id, len(embedding) AS dims, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def s23(spark, d):
    v = F.to_json(F.struct(F.col("embedding")))
    k = F.col("vec_id") % 3
    line = F.when(k == 0, v).when(k == 1, F.to_json(F.struct(F.array("embedding").alias("embeddings")))).otherwise(F.to_json(F.struct(F.array(F.struct("embedding")).alias("data"))))
    rows = table(spark, d, "embeddings").select("vec_id", dialects.embedding_of(line).alias("e"))
    return rows.select("vec_id", F.size("e").cast("long").alias("dims"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("S24_attachments", f"WITH b AS ({_BYTES_SQL}) SELECT doc_id, media_type, octet_length(bytes) AS n_bytes, sha256(bytes) AS bytes_sha256 FROM b")
def s24(spark, d):
    rows = _attachments(spark, d)
    return rows.select("doc_id", "media_type", F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("bytes_sha256"))
