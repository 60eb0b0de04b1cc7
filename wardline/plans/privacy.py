"""Queries: personal data found, masked, numbered, and put back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.personal import COMPANY, NO_CHAIN, NO_NAME, PATTERNS, Policy, alias_name, canonical_column, token_density
from ..operators import masking
from ..operators.storage import stored
from ..streaming import keyed
from .fixtures import NOTES, derived, notes, query, replayed, sevens, sql_of, table

N = f"WITH n AS ({sql_of(NOTES, 'documents')})"


#: Where the planted names stand behind a text of L characters: start and end of each.
_NAMES = {0: [(6, 18)], 1: [(6, 13)], 2: [(1, 14)], 8: [(5, 10), (20, 27)], 9: [(1, 12)], 10: [(1, 15)]}
_AT = " ".join(f"WHEN {k} THEN [" + ", ".join(f"concat('person:', L + {a}, ':', L + {b})" for a, b in at) + "]" for k, at in _NAMES.items())
_TEL = r"(?:^|[^\d.])((?:\+\d{1,3}[\s/-]?(?:\(0\)[\s/-]?)?\d{2,4}|\(0\d{1,4}\)|0\d{1,4})(?:[\s/-]?\d{2,}){1,4})\b"
_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_IBAN = r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,4})?\b"
_STREET = r"(?:\p{Lu}[\p{L}-]*(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|damm|ufer)|\p{Lu}[\p{L}-]+\s+(?:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse|Ring|Damm|Ufer))\s+\d+\s?[a-z]?\b"
_PLACE = r"\b\d{5}\s+\p{Lu}[\p{L}-]+"
_NO_PLACE = r"\d{5}\s+(?:Euro|EUR|CHF|USD|GBP|Dollar|Cent|Prozent|Punkte?|Stück|Seiten|Zeilen|Zeichen|Mitarbeiter|Einwohner|Kilometer|Meter|Tonnen|Kilo)"
_PEOPLE = " ".join(f"WHEN {k} THEN [" + ", ".join(f"{{{{'s': L + {a}, 'e': L + {b}}}}}" for a, b in at) + "]" for k, at in _NAMES.items()).replace("{{", "{").replace("}}", "}")
#: All hits in SQL: what the patterns find (equal ones in a text stand one after the other), and the planted names. Telephone
#: numbers inside an account number go.
_H = f"""{N}, p AS (SELECT request, 'mail' AS category, unnest(regexp_extract_all(text, '{_MAIL}')) AS hit FROM n UNION ALL SELECT request, 'iban', unnest(regexp_extract_all(text, '{_IBAN}', 0, 'i')) FROM n
  UNION ALL SELECT request, 'adresse', unnest(regexp_extract_all(text, '{_STREET}')) FROM n UNION ALL SELECT request, 'ort', unnest(list_filter(regexp_extract_all(text, '{_PLACE}'), lambda x: NOT regexp_full_match(x, '{_NO_PLACE}'))) FROM n
  UNION ALL SELECT request, 'tel', unnest(list_filter(regexp_extract_all(text, '{_TEL}', 1), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 7)) FROM n),
 o AS (SELECT *, row_number() OVER (PARTITION BY request, category, hit) AS k FROM p),
 b AS (SELECT n.partition, n.request, category, hit, cast(list_sum(list_transform(string_split(text, hit)[1:k], lambda x: length(x))) + (k - 1) * length(hit) as bigint) AS s FROM o JOIN n ON n.request = o.request),
 a AS (SELECT *, s + length(hit) AS e FROM b),
 w AS (SELECT doc_id AS request, unnest(CASE doc_id % 13 {_PEOPLE} END) AS place FROM (SELECT doc_id, length(coalesce(text, '')) AS L FROM documents)),
 h AS (SELECT * FROM a WHERE category <> 'tel' OR NOT EXISTS (SELECT 1 FROM a i WHERE i.category = 'iban' AND i.request = a.request AND a.s < i.e AND i.s < a.e)
  UNION ALL SELECT n.partition, n.request, 'person', substr(text, place.s + 1, place.e - place.s), place.s, place.e FROM w JOIN n ON n.request = w.request)"""
_CANON = "trim(regexp_replace(lower(hit), '\\s+', ' ', 'g'))"


def _listed_sql(condition: str) -> str:
    return f"{_H} SELECT request, count(*) AS hits, array_to_string(list_sort(list(concat(category, ':', s, ':', e))), ',') AS spans FROM h WHERE {condition} GROUP BY request"


def _hits(spark, d, policy=Policy()):
    return masking.detected(notes(spark, d), policy)


def _listed(hits):
    span = F.concat_ws(":", "category", "start", "end")
    return hits.groupBy("request").agg(F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_list(span)), ",").alias("spans"))


@query("M01_pattern_counts", f"{N} SELECT request, len(regexp_extract_all(text, '{PATTERNS['mail']}')) AS mails, len(regexp_extract_all(text, '{PATTERNS['iban']}')) AS ibans FROM n")
def m01(spark, d):
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return notes(spark, d).select("request", count(PATTERNS["mail"]).alias("mails"), count(PATTERNS["iban"]).alias("ibans"))


@query("M01_pattern_spans", _listed_sql("category IN ('iban', 'mail', 'adresse', 'ort')"))
def m01_spans(spark, d):
    return _listed(_hits(spark, d).where("category IN ('iban', 'mail', 'adresse', 'ort')"))


@query("M02_telephones", _listed_sql("category = 'tel'"))
def m02(spark, d):
    return _listed(_hits(spark, d).where("category = 'tel'"))


@query("M03_M04_persons", f"WITH n AS (SELECT doc_id AS request, length(coalesce(text, '')) AS L FROM documents), s AS (SELECT request, CASE request % 13 {_AT} END AS spans FROM n) SELECT request, len(spans) AS hits, array_to_string(list_sort(spans), ',') AS spans FROM s WHERE spans IS NOT NULL")
def m03(spark, d):
    return _listed(_hits(spark, d).where("category = 'person'"))


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


#: Two capitalised words that aren't function words, where no planted name stands, and the planted names.
_PAIRS = f"""{N}, p AS (SELECT request, unnest(regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}_])(\\p{{Lu}}[\\p{{L}}''-]*\\p{{L}}\\s\\p{{Lu}}[\\p{{L}}''-]*\\p{{L}})', 1)) AS hit FROM n), o AS (SELECT *, row_number() OVER (PARTITION BY request, hit) AS k FROM p),
 c AS (SELECT o.request, hit, text, cast(list_sum(list_transform(string_split(text, hit)[1:k], lambda x: length(x))) + (k - 1) * length(hit) as bigint) AS s, lower(regexp_split_to_array(hit, '\\s+')[1]) AS a, lower(regexp_split_to_array(hit, '\\s+')[2]) AS b FROM o JOIN n ON n.request = o.request),
 f AS (SELECT request, s, s + length(hit) AS e FROM c WHERE a NOT IN ({_quoted(NO_CHAIN)}) AND b NOT IN ({_quoted(COMPANY | NO_NAME | NO_CHAIN)}) AND NOT regexp_matches(substr(text, s + length(hit) + 1, 1), '[\\p{{L}}\\p{{N}}_]')),
 w AS (SELECT doc_id AS request, unnest(CASE doc_id % 13 {_PEOPLE} END) AS place FROM (SELECT doc_id, length(coalesce(text, '')) AS L FROM documents)),
 h AS (SELECT request, place.s AS s, place.e AS e FROM w UNION SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.request = f.request AND w.place.s < f.e AND f.s < w.place.e))
 SELECT request, count(*) AS hits, array_to_string(list_sort(list(concat('person:', s, ':', e))), ',') AS spans FROM h GROUP BY request"""


@query("M05_strict_chains", _PAIRS)
def m05(spark, d):
    return _listed(_hits(spark, d, Policy(profile="streng")).where("category = 'person'"))


@query("M06_denylist", f"{N} SELECT request, count(*) AS hits FROM (SELECT request, unnest(regexp_extract_all(text, 'MIT License', 0, 'i')) AS hit FROM n) GROUP BY request")
def m06(spark, d):
    return _hits(spark, d, Policy(deny=("MIT License",))).where("category = 'custom'").groupBy("request").agg(F.count("*").alias("hits"))


@query("M07_resolved_spans", _listed_sql("true"))
def m07(spark, d):
    return _listed(_hits(spark, d))


@query("M08_category_modes", f"""{N}, t AS (SELECT unnest(regexp_extract_all(text, '{_TEL}', 1)) AS hit FROM n WHERE request % 13 <> 3) SELECT 'person' AS category, count(*) + count(*) FILTER (request % 13 = 8) AS hits FROM n WHERE request % 13 IN (0, 1, 2, 8, 9, 10)
 UNION ALL SELECT 'iban', count(*) FROM n WHERE request % 13 = 3 UNION ALL SELECT 'tel', count(*) FROM t WHERE length(regexp_replace(hit, '\\D', '', 'g')) >= 7""")
def m08(spark, d):
    minimal = _hits(spark, d, Policy(profile="minimal", modes={"person": "alias"}, disabled=("mail",)))
    return minimal.groupBy("category").agg(F.count("*").alias("hits"))


@query("M09_allowlist", _listed_sql(f"{_CANON} NOT IN ('anna schmidt', 'max.muster@firma.de')"))
def m09(spark, d):
    return _listed(_hits(spark, d, Policy(allow=("Anna Schmidt", "MAX.MUSTER@firma.de"))))


@query("M10_asked_persons_spared", _listed_sql(f"NOT (category = 'person' AND request % 2 = 0 AND string_split({_CANON}, ' ')[-1] = 'schmidt')"))
def m10(spark, d):
    rows = notes(spark, d)
    asked = rows.select("partition", "request", F.when(F.col("request") % 2 == 0, "Was weiss Frau Schmidt?").alias("query"))
    return _listed(masking.spared(masking.detected(rows), asked))


_M11 = f"{N} SELECT request, sha256(trim(regexp_replace(lower(text), '[\\s\\x0B\\x{{85}}\\p{{Z}}]+', ' ', 'g'))) AS canonical_sha256 FROM n"


@query("M11_canonical_form", _M11)
def m11(spark, d):
    return notes(spark, d).select("request", F.sha2(canonical_column(F.col("text")), 256).alias("canonical_sha256"))


#: The vault in SQL: each name by its first sight; of persons with one surname the first decides whose token they get.
_PREFIX = "CASE category WHEN 'person' THEN 'Person' WHEN 'mail' THEN 'Mail' WHEN 'tel' THEN 'Tel' WHEN 'iban' THEN 'IBAN' WHEN 'adresse' THEN 'Adresse' WHEN 'ort' THEN 'Ort' END"
_VAULT = f"""{_H}, c AS (SELECT partition, category, {_CANON} AS name, request AS ord, -s AS back, hit FROM h),
 f AS (SELECT partition, category, name, arg_min(hit, (ord, back)) AS value, min((ord, back)) AS seen FROM c GROUP BY ALL),
 g AS (SELECT *, category = 'person' AND NOT contains(name, ' ') AS bare, CASE WHEN category = 'person' THEN string_split(name, ' ')[-1] ELSE name END AS family FROM f),
 l AS (SELECT *, first_value(name) OVER o AS eldest, first_value(bare) OVER o AS bare_first, arg_min(name, seen) FILTER (NOT bare) OVER (PARTITION BY partition, category, family) AS full_first FROM g WINDOW o AS (PARTITION BY partition, category, family ORDER BY seen)),
 k AS (SELECT *, CASE WHEN category <> 'person' THEN name WHEN bare_first THEN eldest WHEN bare THEN full_first ELSE name END AS head FROM l),
 d AS (SELECT partition, category, head, dense_rank() OVER (PARTITION BY partition, category ORDER BY min(seen)) AS n FROM k GROUP BY partition, category, head),
 v AS (SELECT k.partition, k.category, k.name, concat(k.category, '|', k.name) AS canonical, concat('[', {_PREFIX.replace('category', 'k.category')}, '-', d.n, ']') AS token, CASE WHEN bare AND k.head <> k.name THEN '' ELSE value END AS value, seen FROM k JOIN d ON d.partition = k.partition AND d.category = k.category AND d.head = k.head)"""


@query("M12_M13_vault", f"{_VAULT} SELECT partition, canonical, token, value FROM v")
def m12(spark, d):
    return masking.minted(_hits(spark, d)).select("partition", "canonical", "token", "value")


_HALF = lambda i: "(" + _VAULT.replace(" FROM h),", f" FROM h WHERE request % 2 = {i}),", 1) + " SELECT * FROM v)"
#: Of names that an older vault lacks: a surname whose first name is a bare one brings a token if that is new, else each new
#: full name brings one; of other kinds each name does.
_LATER = f"""WITH e AS (SELECT * FROM {_HALF(0)}), a AS ({_VAULT} SELECT * FROM v), new AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.partition = a.partition AND e.canonical = a.canonical)),
 u AS (SELECT partition, category, name, 0 AS gen, seen FROM e UNION ALL SELECT partition, category, name, 1 AS gen, seen FROM new),
 p AS (SELECT partition, gen, seen, NOT contains(name, ' ') AS bare, string_split(name, ' ')[-1] AS family FROM u WHERE category = 'person'),
 f AS (SELECT partition, family, arg_min(bare, (gen, seen)) AS bare_first, min(gen) AS gen, count(*) FILTER (gen = 1 AND NOT bare) AS fulls FROM p GROUP BY ALL),
 more AS (SELECT partition, 'Person' AS prefix, sum(CASE WHEN bare_first THEN gen ELSE fulls END) AS n FROM f GROUP BY partition UNION ALL SELECT partition, {_PREFIX}, count(*) FROM new WHERE category <> 'person' GROUP BY ALL),
 high AS (SELECT partition, {_PREFIX} AS prefix, max(cast(regexp_extract(token, '-(\\d+)\\]', 1) AS BIGINT)) AS high FROM e GROUP BY ALL)
 SELECT partition, prefix, (coalesce(high, 0) + coalesce(n, 0))::BIGINT AS highest FROM high FULL JOIN more USING (partition, prefix)"""


@query("M12_tokens_after_older_vault", _LATER)
def m12_old(spark, d):
    """The names of all texts minted after those of every second one."""
    hits = _hits(spark, d)
    old = masking.minted(hits.where("ord % 2 = 0"))
    return masking.counters(masking.minted(hits, old))


_ALIASES = "['Alex','Bela','Chris','Dana','Elia','Falk','Gero','Hedi','Ida','Jona','Kim','Lou','Mika','Noa','Ole','Pia','Quin','Rene','Sam','Toni','Ulf','Vera','Wim','Xenia','Yara','Zoe']"
_I = "cast(regexp_extract(token, '(\\d+)', 1) as int) - 1"
_ALIAS = f"{_ALIASES}[({_I}) % 26 + 1] || ' ' || chr(cast(65 + ({_I}) % 26 as int)) || '.' || CASE WHEN {_I} >= 26 THEN cast(({_I}) // 26 as string) ELSE '' END"
#: Masked texts in SQL, longer hits first; sessions; and what they are with every token replaced by its shown value.
_MASKED = f"""{_VAULT}, shown AS (SELECT partition, token, arg_min(value, (seen, canonical)) AS clear FROM v WHERE value <> '' GROUP BY partition, token),
 x AS (SELECT h.partition, h.request, h.category, h.hit, v.token, clear, CASE WHEN h.category = 'person' THEN {_ALIAS.replace('token', 'v.token')} END AS alias FROM h JOIN v ON v.partition = h.partition AND v.category = h.category AND v.name = {_CANON} JOIN shown ON shown.partition = v.partition AND shown.token = v.token),
 r AS (SELECT request, list(hit || chr(31) || token ORDER BY length(hit) DESC) AS steps, list(DISTINCT token || chr(31) || clear) AS back, list_distinct(flatten(list(list_filter([token, alias], lambda y: y IS NOT NULL)))) AS forms, count(*) FILTER (category = 'person') AS persons FROM x GROUP BY request),
 mk AS (SELECT n.partition, n.request, text, persons, coalesce(forms, []) AS forms, list_reduce([text] || coalesce(steps, []), lambda a, y: replace(a, string_split(y, chr(31))[1], string_split(y, chr(31))[2])) AS masked, coalesce(back, []) AS back FROM n LEFT JOIN r ON r.request = n.request),
 u AS (SELECT *, list_reduce([masked] || back, lambda a, y: replace(a, string_split(y, chr(31))[1], string_split(y, chr(31))[2])) AS clear FROM mk)"""


def _masked(spark, d, **how):
    return masking.masked(notes(spark, d), **how)


@query("M14_M16_masked", f"{_MASKED} SELECT request, sha256(masked) AS masked_sha256, array_to_string(list_sort(forms), ',') AS forms FROM u")
def m14(spark, d):
    rows, _ = _masked(spark, d, second_pass="off")
    return rows.select("request", F.sha2("masked", 256).alias("masked_sha256"), F.array_join(F.array_sort(F.map_keys("session")), ",").alias("forms"))


#: Bare repeats of planted names, behind the other planted text: what stands there, the name that it is, and the surname in it.
REPEATS = {4: (" klaus WEBER ging.", "klaus WEBER", "WEBER"), 7: (" Fischerei mit sabine fischer", "sabine fischer", ""), 11: (" x-LEHMANN, bernd schmidt-krause und weberin", "", "LEHMANN"), 12: (" anna  schmidt kam", "", "schmidt")}
_REPEATED = NOTES | {"text": f"concat({NOTES['text']}, CASE doc_id % 13 " + " ".join(f"WHEN {k} THEN '{v[0]}'" for k, v in REPEATS.items()) + " ELSE '' END)"}
_PART = lambda i: "CASE request % 13 " + " ".join(f"WHEN {k} THEN '{v[i]}'" for k, v in REPEATS.items()) + " ELSE '' END"


def _again_sql(when: str) -> str:
    """Masked texts after the second pass, with the names of which when holds: the whole name if it is known, else the surname."""
    known = lambda i: f"LEFT JOIN v AS n{i} ON n{i}.partition = u.partition AND n{i}.category = 'person' AND n{i}.name = lower({_PART(i)}) AND {when.format(i)}"
    return f"""{_MASKED.replace(sql_of(NOTES, 'documents'), sql_of(_REPEATED, 'documents'))} SELECT request, sha256(CASE WHEN n1.token IS NOT NULL THEN replace(masked, {_PART(1)}, n1.token) WHEN n2.token IS NOT NULL THEN replace(masked, {_PART(2)}, n2.token) ELSE masked END) AS masked_sha256,
 nullif(coalesce(persons, 0) + CASE WHEN coalesce(n1.token, n2.token) IS NOT NULL THEN 1 ELSE 0 END, 0) AS persons FROM u {known(1)} {known(2)}"""


def _again(spark, d, second_pass):
    rows = derived(table(spark, d, "documents"), _REPEATED).selectExpr("partition", "request", "cast(idx as int) AS idx", "ord", "text")
    out, _ = masking.masked(rows, second_pass=second_pass)
    return out.select("request", F.sha2("masked", 256).alias("masked_sha256"), F.element_at("counts", "person").cast("long").alias("persons"))


@query("M15_second_pass", _again_sql("true"))
def m15(spark, d):
    return _again(spark, d, "corpus")


@query("M15_second_pass_as_of", _again_sql("n{0}.seen[1] <= request"))
def m15_asof(spark, d):
    return _again(spark, d, "asof")


@query("M15_second_pass_off", _again_sql("false"))
def m15_off(spark, d):
    return _again(spark, d, "off")


@query("M16_request_sessions", f"{_MASKED}, q AS (SELECT partition, request % 50 AS request, unnest(forms) AS form FROM u) SELECT partition, request, count(DISTINCT form) AS forms FROM q GROUP BY ALL")
def m16(spark, d):
    rows, _ = _masked(spark, d)
    merged = masking.merged_sessions(rows.select("partition", (F.col("request") % 50).alias("request"), F.col("request").alias("idx"), "session"))
    return merged.select("partition", "request", F.size("session").alias("forms"))


@query("M17_alias_names", """WITH t AS (SELECT event_id, event_id % 120 AS n FROM events), a AS (SELECT *, ['Alex','Bela','Chris','Dana','Elia','Falk','Gero','Hedi','Ida','Jona','Kim','Lou','Mika','Noa','Ole','Pia','Quin','Rene','Sam','Toni','Ulf','Vera','Wim','Xenia','Yara','Zoe'] AS names FROM t)
 SELECT event_id, CASE WHEN n >= 1 THEN names[(n - 1) % 26 + 1] || ' ' || chr(cast(65 + (n - 1) % 26 as int)) || '.' || CASE WHEN n > 26 THEN cast((n - 1) // 26 as string) ELSE '' END END AS alias FROM a""")
def m17(spark, d):
    token = F.concat(F.lit("[Person-"), (F.col("event_id") % 120).cast("string"), F.lit("]"))
    return table(spark, d, "events").select("event_id", alias_name(token).alias("alias"))


#: A hit becomes one word.
_DENSE = f"""{_H}, c AS (SELECT request, count(*) AS n, sum(len(list_filter(regexp_split_to_array(hit, '\\s+'), lambda x: x <> '')) - 1) AS less FROM h GROUP BY request),
 t AS (SELECT n.request, coalesce(c.n, 0) AS tokens, len(list_filter(regexp_split_to_array(text, '[\\s\\x0B\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '')) - coalesce(less, 0) AS words FROM n LEFT JOIN c ON c.request = n.request),
 y AS (SELECT request, CASE WHEN words > 0 THEN tokens / words ELSE 0.0 END AS density FROM t)"""


#: Every whole text, and the planted one of each document once more alone, so that some are dense: their ids are shifted by
#: a number that 13 and 4 divide, which planting and partitions go by.
_ALONE = "doc_id + 13000000000000"
_DENSE_BOTH = _DENSE.replace("FROM documents", f"FROM (SELECT doc_id, text FROM documents UNION ALL SELECT {_ALONE}, '' FROM documents)")


@query("M18_token_density", f"{_DENSE_BOTH} SELECT request, round(density, 6) AS density, density > 0.35 AS too_dense FROM y")
def m18(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    both = docs.union(docs.selectExpr(_ALONE, "''"))
    rows, _ = masking.masked(derived(both, NOTES).selectExpr("partition", "request", "cast(idx as int) AS idx", "ord", "text"))
    return rows.select("request", F.round("density", 6).alias("density"), (token_density(F.col("masked")) > 0.35).alias("too_dense"))


_RULE = "CASE category WHEN 'person' THEN 'PII-001' WHEN 'mail' THEN 'PII-002' WHEN 'tel' THEN 'PII-003' WHEN 'iban' THEN 'PII-004' WHEN 'adresse' THEN 'PII-005' WHEN 'ort' THEN 'PII-006' END"


@query("M19_findings", f"{_DENSE}, r AS (SELECT request, category, concat({_RULE}, ':', count(*)) AS f FROM h GROUP BY request, category), q AS (SELECT request, list(f ORDER BY category) AS fs FROM r GROUP BY request) SELECT y.request, array_to_string(coalesce(fs, []) || CASE WHEN density > 0.02 THEN ['PII-900:1'] ELSE [] END, ',') AS findings FROM y LEFT JOIN q ON q.request = y.request")
def m19(spark, d):
    rows, _ = _masked(spark, d)
    found = masking.pii_findings(F.col("counts"), F.col("density"), Policy(max_density=0.02, on_density="abstain"))
    return rows.select("request", F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["rule_id"], f["occurrences"].cast("string"))), ",").alias("findings"))


@query("M20_unmasked", f"{_MASKED} SELECT request, sha256(clear) AS text_sha256, clear = text AS same FROM u")
def m20(spark, d):
    rows, _ = _masked(spark, d, second_pass="off")
    back = masking.unmask(F.col("masked"), F.col("session"))
    return rows.select("request", F.sha2(back, 256).alias("text_sha256"), (back == F.col("text")).alias("same"))


@query("M21_restored_from_vault", f"{_MASKED} SELECT partition, request AS id, sha256(clear) AS text_sha256 FROM u")
def m21(spark, d):
    rows, vault = _masked(spark, d, second_pass="off")
    back = masking.restored(rows.select("partition", F.col("request").alias("id"), F.col("masked").alias("text")), vault)
    return back.select("partition", "id", F.sha2("text", 256).alias("text_sha256"))


@query("M22_stream_unmasked", f"{_MASKED} SELECT request AS stream_id, clear = text AS same, sha256(clear) AS text_sha256 FROM u")
def m22(spark, d):
    from ..streaming.state import unmasked_stream

    rows, _ = _masked(spark, d, second_pass="off")
    cut = F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.length("masked") / 7)), lambda i: F.substring(F.col("masked"), (i * 7 + 1).cast("int"), F.lit(7))), lambda c: c != "")
    chunks = rows.select(F.col("request").alias("stream_id"), F.posexplode(cut).alias("seq", "chunk")).withColumn("seq", F.col("seq").cast("long"))
    out = unmasked_stream(chunks, rows.select(F.col("request").alias("stream_id"), "session"))
    whole = out.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))
    return whole.join(rows.select(F.col("request").alias("stream_id"), F.col("text").alias("clear")), "stream_id").select("stream_id", (F.col("text") == F.col("clear")).alias("same"), F.sha2("text", 256).alias("text_sha256"))


@query("M22_streamed", f"{_MASKED} SELECT request AS stream_id, clear = text AS same, sha256(clear) AS text_sha256 FROM u")
def m22_streamed(spark, d):
    """As M22, as a stream: a trigger gets a part of every stream's chunks, the early ones too, and its session with some of them."""
    rows, _ = _masked(spark, d, second_pass="off")
    size = F.greatest(F.lit(1), F.ceil(F.length("masked") / 7)).cast("int")
    rows = stored(rows.select("request", "text", "masked", "session", size.alias("n")), "masked")
    cut = F.when(F.col("masked") == "", F.array(F.lit(""))).otherwise(sevens(F.col("masked")))
    chunks = rows.select(F.col("request").alias("stream_id"), "session", "n", F.posexplode(cut).alias("seq", "chunk"))
    session = F.when(F.col("seq") == F.col("n") % 5 % F.col("n"), F.coalesce("session", F.create_map().cast("map<string,string>")))
    chunks = chunks.select("stream_id", F.col("seq").cast("long").alias("seq"), "chunk", (F.col("seq") == F.col("n") - 1).alias("last"), session.alias("session"), (F.col("seq") * 7 % 4).alias("trigger"))
    out = replayed(spark, chunks, keyed.unmasked_live, "trigger")
    whole = out.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))
    return whole.join(rows.select(F.col("request").alias("stream_id"), F.col("text").alias("clear")), "stream_id").select("stream_id", (F.col("text") == F.col("clear")).alias("same"), F.sha2("text", 256).alias("text_sha256"))


@query("S26_vault_merge", f"WITH e AS (SELECT * FROM {_HALF(0)}), o AS (SELECT * FROM {_HALF(1)}) SELECT partition, canonical, token, value FROM e UNION ALL SELECT partition, canonical, token, value FROM o WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.partition = o.partition AND e.canonical = o.canonical)")
def s26(spark, d):
    hits = _hits(spark, d)
    even, odd = masking.minted(hits.where("ord % 2 = 0")), masking.minted(hits.where("ord % 2 = 1"))
    return masking.merged_vault(even, odd).select("partition", "canonical", "token", "value")


@query("S27_vault_listing", f"{_VAULT} SELECT partition, token, category, arg_min(value, (seen, canonical)) AS value FROM v WHERE value <> '' GROUP BY partition, token, category")
def s27(spark, d):
    return masking.shown_values(masking.minted(_hits(spark, d)))


