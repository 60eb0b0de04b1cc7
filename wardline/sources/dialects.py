"""Requests and responses of three chat dialects, as JSON lines.

JSON at the rim is irregular, so lines are read as variants: a field is looked at for what it is, and a wrong type
counts as missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that would change an answer's meaning, in the order in which they are named; blocks that carry
#: more than text.
SEMANTIC_FIELDS = {
    "openai": ("tools", "tool_choice", "functions", "function_call", "response_format"), "anthropic": ("tools", "tool_choice"), "ollama": ("tools", "format"),
}
BINARY_TYPES = ("image", "image_url", "input_image", "file", "input_file", "audio", "input_audio", "document", "video")
BINARY_KEYS = ("image_url", "source", "input_image", "file", "audio", "data")
ROLES = ("system", "user", "assistant", "tool")
BLOCK = "struct<type:string,text:string>"
MESSAGE = "struct<role:string,content:string>"


def parsed(line: Column) -> Column:
    """The line as a variant, null where it isn't JSON."""
    return F.try_parse_json(line)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _text(v: Column, path: str) -> Column:
    """A field's string; null for anything else, numbers among them."""
    field = _get(v, path, "variant")
    return F.when(_kind(field) == "STRING", _get(v, path, "string"))


def _number(v: Column, path: str, kind: str) -> Column:
    field = _kind(_get(v, path, "variant"))
    return F.when((field == "BIGINT") | (field == "DOUBLE") | F.startswith(field, F.lit("DECIMAL")), _get(v, path, kind))


def _flag(v: Column, path: str) -> Column:
    return F.when(_kind(_get(v, path, "variant")) == "BOOLEAN", _get(v, path, "boolean"))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _is_object(v: Column) -> Column:
    return F.startswith(_kind(v), F.lit("OBJECT"))


def flattened(content: Column) -> Column:
    """A content field as text: a string as it is, blocks as their texts put together, else nothing."""
    blocks = F.try_variant_get(content, "$", "array<variant>")
    whole = F.coalesce(F.forall(blocks, _is_object), F.lit(False))
    texts = F.filter(F.transform(blocks, lambda b: _text(b, "$.text")), lambda t: t.isNotNull())
    return F.when(_kind(content) == "STRING", F.try_variant_get(content, "$", "string")).when(whole, F.array_join(texts, "")).otherwise("")


def carries_binary(content: Column) -> Column:
    """True if a block is of a known binary type or has a container's key, whatever text stands beside it."""
    blocks = F.try_variant_get(content, "$", "array<variant>")
    keyed = lambda b: reduce(lambda x, y: x | y, [_get(b, f"$.{k}", "variant").isNotNull() for k in BINARY_KEYS])
    odd = F.exists(blocks, lambda b: F.coalesce(_text(b, "$.type").isin(*BINARY_TYPES), F.lit(False)) | keyed(b))
    return F.coalesce(F.forall(blocks, _is_object) & odd, F.lit(False))


def messages_of(entries: Column) -> Column:
    """(role, content) of the entries that have a role; roles that nobody knows are users."""
    kept = F.filter(entries, lambda e: _text(e, "$.role").isNotNull())
    role = lambda e: F.when(_text(e, "$.role").isin(*ROLES), _text(e, "$.role")).otherwise("user")
    return F.transform(kept, lambda e: F.struct(role(e).alias("role"), flattened(_get(e, "$.content", "variant")).alias("content")))


def rejected_field(v: Column, dialect: str) -> Column:
    """The first field, in the dialect's order, that would change the meaning; null if none is there."""
    return F.coalesce(*[F.when(_get(v, f"$.{f}", "variant").isNotNull(), f) for f in SEMANTIC_FIELDS[dialect]], F.lit(None).cast("string"))


def requests(lines: DataFrame, dialect: str, line: str = "line") -> DataFrame:
    """lines with model, messages, stream, temperature, max_tokens, error. A line that can't be a request has the reason
    in error and the rest null."""
    v = F.col("_v")
    out = lines.withColumn("_v", parsed(F.col(line)))
    entries = _list(v, "$.messages")
    own = messages_of(entries)
    binary = F.exists(entries, lambda e: _text(e, "$.role").isNotNull() & carries_binary(_get(e, "$.content", "variant")))
    temperature, most, stream = _number(v, "$.temperature", "double"), _number(v, "$.max_tokens", "int"), F.coalesce(_flag(v, "$.stream"), F.lit(False))
    missing = F.size(own) == 0
    if dialect == "anthropic":
        system = flattened(_get(v, "$.system", "variant"))
        own = F.concat(F.when(system != "", F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))).otherwise(F.array().cast(f"array<{MESSAGE}>")), own)
        binary = binary | carries_binary(_get(v, "$.system", "variant"))
        missing = ~F.exists(own, lambda m: m["role"] != "system")
    elif dialect == "ollama":
        stream = F.coalesce(_flag(v, "$.stream"), F.lit(True))
        temperature, most = _number(v, "$.options.temperature", "double"), _number(v, "$.options.num_predict", "int")
    field = rejected_field(v, dialect)
    error = (
        F.when(v.isNull() | ~_is_object(v), "not a JSON object").when(field.isNotNull(), F.concat(F.lit("unsupported field "), field))
        .when(_text(v, "$.model").isNull(), "no model").when(binary, "binary content").when(missing, "no messages")
    )
    good = lambda c: F.when(F.col("error").isNull(), c)
    out = out.withColumn("error", error)
    return out.select(
        *lines.columns, good(_text(v, "$.model")).alias("model"), good(own).alias("messages"), good(stream).alias("stream"), good(temperature).alias("temperature"),
        good(most).alias("max_tokens"), "error",
    )


def usage(prompt: Column, completion: Column) -> Column:
    """Token usage, null where neither side is known; a missing side is 0."""
    pair = F.struct(F.coalesce(prompt, F.lit(0)).cast("long").alias("prompt_tokens"), F.coalesce(completion, F.lit(0)).cast("long").alias("completion_tokens"))
    return F.when(prompt.isNotNull() | completion.isNotNull(), pair)


def usage_of(v: Column, path: str = "$") -> Column:
    """Usage in snake or camel case."""
    side = lambda a, b: F.coalesce(_number(v, f"{path}.{a}", "long"), _number(v, f"{path}.{b}", "long"))
    return usage(side("prompt_tokens", "promptTokens"), side("completion_tokens", "completionTokens"))


def responses(lines: DataFrame, dialect: str, line: str = "line") -> DataFrame:
    """lines with model, content, usage, finish_reason."""
    v = F.col("_v")
    out = lines.withColumn("_v", parsed(F.col(line)))
    if dialect == "openai":
        content, finish, used = flattened(_get(v, "$.choices[0].message.content", "variant")), _text(v, "$.choices[0].finish_reason"), usage_of(v, "$.usage")
    elif dialect == "anthropic":
        content, finish = flattened(_get(v, "$.content", "variant")), _text(v, "$.stop_reason")
        used = usage(_number(v, "$.usage.input_tokens", "long"), _number(v, "$.usage.output_tokens", "long"))
    else:
        content, finish = flattened(_get(v, "$.message.content", "variant")), _text(v, "$.done_reason")
        used = usage(_number(v, "$.prompt_eval_count", "long"), _number(v, "$.eval_count", "long"))
    return out.select(*lines.columns, F.coalesce(_text(v, "$.model"), F.lit("")).alias("model"), content.alias("content"), used.alias("usage"), finish.alias("finish_reason"))


def exported(requests_: DataFrame, dialect: str) -> DataFrame:
    """requests with line: the request in a dialect; fields that are null are left out."""
    own = F.col("messages")
    if dialect == "openai":
        body = F.struct("model", own.alias("messages"), "stream", "temperature", "max_tokens")
    elif dialect == "anthropic":
        system = F.array_join(F.transform(F.filter(own, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n")
        rest = F.transform(F.filter(own, lambda m: m["role"] != "system"), lambda m: F.struct(F.when(m["role"] == "tool", "user").otherwise(m["role"]).alias("role"), m["content"].alias("content")))
        body = F.struct("model", F.coalesce("max_tokens", F.lit(4096)).alias("max_tokens"), rest.alias("messages"), "stream", F.nullif(system, F.lit("")).alias("system"), "temperature")
    else:
        options = F.when(F.col("temperature").isNotNull() | F.col("max_tokens").isNotNull(), F.struct("temperature", F.col("max_tokens").alias("num_predict")))
        body = F.struct("model", own.alias("messages"), "stream", options.alias("options"))
    return requests_.withColumn("line", F.to_json(body))


def handoffs(decisions: DataFrame) -> DataFrame:
    """Lines for the next stage: who, verdict without display text, masked request; keys in alphabetic order. decisions:
    request, subject, tenant, scopes, disposition, risk_score, findings, model, stream, temperature, max_tokens,
    forwarded."""
    who = F.struct(F.when(F.size("scopes") > 0, F.array_sort("scopes")).alias("scopes"), "subject", "tenant")
    found = F.transform("findings", lambda f: F.struct(f["category"].alias("category"), f["occurrences"].alias("occurrences"), f["rule_id"].alias("rule"), f["severity"].alias("severity"), f["weight"].alias("weight")))
    asked = F.struct("max_tokens", F.transform("forwarded", lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role"))).alias("messages"), "model", "stream", "temperature")
    verdict = F.struct("disposition", found.alias("findings"), "risk_score")
    body = F.struct(F.col("request").cast("string").alias("correlation_id"), who.alias("principal"), asked.alias("request"), verdict.alias("verdict"))
    return decisions.select("request", F.to_json(body).alias("line"))


def next_stage(lines: DataFrame, line: str = "line") -> DataFrame:
    """Stream lines of the next stage: delta, usage, error; unreadable lines are skipped."""
    v = F.col("_v")
    out = lines.withColumn("_v", parsed(F.col(line))).where("_v is not null").where(_is_object(v))
    return out.select(*lines.columns, F.nullif(_text(v, "$.delta"), F.lit("")).alias("delta"), usage_of(v, "$.usage").alias("usage"), _text(v, "$.error").alias("failure"))


def next_stage_response(lines: DataFrame, line: str = "line") -> DataFrame:
    """One-shot answers of the next stage: content, model (empty if it names none), finish_reason, usage; one that isn't an
    object or has no content is an error, with the rest null."""
    v = F.col("_v")
    out = lines.withColumn("_v", parsed(F.col(line)))
    content = _text(v, "$.content")
    error = F.when(v.isNull() | ~_is_object(v), "not a JSON object").when(content.isNull(), "no content")
    good = lambda c: F.when(content.isNotNull(), c)
    return out.select(*lines.columns, content.alias("content"), good(F.coalesce(_text(v, "$.model"), F.lit(""))).alias("model"), good(_text(v, "$.finish_reason")).alias("finish_reason"), good(usage_of(v, "$.usage")).alias("usage"), error.alias("error"))


def embedding_of(line: Column) -> Column:
    """The vector of an embedding response: embedding, else the first of embeddings, else the first of data; the first
    that is a non-empty array of numbers."""
    v = parsed(line)
    paths = ("$.embedding", "$.embeddings[0]", "$.data[0].embedding")
    found = [F.try_variant_get(v, p, "array<double>") for p in paths]
    return F.coalesce(*[F.when((F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull()), a) for a in found])
