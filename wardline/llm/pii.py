"""Personal data in whole texts, as spans with scores, in built-in expressions only.

Patterns propose spans, checksums and ranges confirm them (Luhn for cards, mod 97 for IBANs, 255 for the parts of an
address), and words just before a span raise or lower its score. Spark has no function for the positions of all
matches; splitting by a pattern gives the text between matches and extracting gives the matches, so running sums of
both lengths are the positions. The sums take time in proportion to the matches.

Patterns that start with a run of characters begin either where the last match ended or where no such character
stands before, and their repetitions are possessive. Both only spare the matcher starts and retreats that must fail,
so very long runs take linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, documents, running, text_rows

#: Lengths of IBANs by country, in the public registry's order by length. Fixed values.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT",
    26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT",
}


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: its pattern (Java), what a match must pass, its score alone, the words before it that
    change that score, and the score it needs. Base kinds are kept whatever their score."""

    name: str
    pattern: str
    score: float
    context: str
    against: str = ""
    base: bool = True
    least: float = 0.0


_IBAN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, r"e-?mail|contact|write|reply|address"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", 0.6, r"\bip\b|host|server|address|login|from", r"version|release|\bv$|section"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", 0.7, r"card|visa|master|credit|debit|payment|carte|karte|tarjeta", r"order|invoice|tracking|isbn|serial"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, r"phone|tel|call|mobile|fax|cell|handy|reach"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])", 0.9, r"iban|account|konto|bank|cuenta|compte", base=False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.3, r"ssn|social|security|tax", base=False, least=0.5),
)
#: How far before a span its context reaches, in characters.
REACH = 40


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the Luhn check."""
    doubled = lambda c, i: F.when(i % 2 == 1, F.when(c > 4, 2 * c - 9).otherwise(2 * c)).otherwise(c)
    parts = F.transform(F.split(F.reverse(digits), ""), lambda c, i: doubled(c.cast("int"), i))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(value: Column) -> Column:
    """True where an IBAN's remainder is 1: its first four characters go to the end, letters count as 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    chars = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).when(c.rlike("[A-Z]"), a * 100 + F.ascii(c) - 55).otherwise(a) % 97
    return F.aggregate(chars, F.lit(0), step) == 1


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


_SPAN = "struct<kind:string,start:int,end:int,value:string,score:double>"


def _located(kind: Kind, order: int) -> Column:
    """From the matches and the texts between them: spans of one kind that pass its checks, with scores."""
    found, gaps = F.col(f"found_{order}"), F.col(f"gaps_{order}")
    pairs = F.filter(F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value"))), lambda p: p["value"].isNotNull())

    def spans_of(ps: Column) -> Column:
        ends = running(F.transform(ps, lambda p: F.length(p["gap"]) + F.length(p["value"])), lambda a, b: a + b, F.lit(0))
        span = lambda p, end: F.struct((end - F.length(p["value"])).alias("start"), end.alias("end"), p["value"].alias("value"), F.right(p["gap"], F.lit(REACH)).alias("before"))
        return F.zip_with(ps, ends, span)

    spans = F.filter(bound(pairs, spans_of), lambda s: _valid(kind.name, s["value"]))

    def scored(s: Column) -> Column:
        score = F.lit(kind.score) + F.when(s["before"].rlike(f"(?i){kind.context}"), 0.25).otherwise(0.0)
        if kind.against:
            score = score - F.when(s["before"].rlike(f"(?i){kind.against}"), 0.3).otherwise(0.0)
        score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), score.alias("score"))

    out = F.transform(spans, scored)
    if kind.least:
        out = F.filter(out, lambda s: s["score"] >= kind.least)
    return F.coalesce(out, F.expr(f"cast(array() as array<{_SPAN}>)"))


def with_spans(df: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """df (with a non-null column text) and a column spans: array of (kind, start, end, value, score), kinds in the
    order given, then by start. Positions count code points from 0, the end is exclusive. Spans of one kind don't
    overlap; spans of two kinds may."""
    text = F.col("text")
    raw = df
    for i, k in enumerate(kinds):
        hit = text.rlike(k.pattern)
        raw = raw.withColumns({f"found_{i}": F.when(hit, F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))), f"gaps_{i}": F.when(hit, F.split(text, k.pattern, -1))})
    spans = F.concat(*[_located(k, i) for i, k in enumerate(kinds)])
    return raw.withColumn("spans", spans).drop(*[f"{x}_{i}" for i in range(len(kinds)) for x in ("found", "gaps")])


def detect(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id, text, spans for each document; narrow, without a shuffle.

    Null texts count as empty and have no span. Repeated rows get a row each; ties can't arise, as spans of a kind
    don't overlap; other columns are ignored; an empty table gives an empty one."""
    return with_spans(text_rows(docs), kinds)


def redact(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in capitals and angle brackets. Spans that overlap are replaced together,
    from the first one's start to the furthest end, by the first one's kind (the longer's of those that start
    together), so nothing of any span stays."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    reach = lambda o: running(F.transform(o, lambda s: -s["back"]), lambda a, b: F.greatest(a, b), F.lit(-1))

    def replaced(both: Column) -> Column:  # (ordered spans, furthest end so far)
        o, r = both["o"], both["r"]
        before = F.concat(F.array(F.lit(-1)), r)
        heads = F.filter(F.arrays_zip(o.alias("s"), before.alias("e")), lambda z: z["s"].isNotNull() & (z["s"]["start"] >= z["e"]))
        tails = F.filter(F.zip_with(r, F.concat(F.slice(o, 2, F.size(o)), F.array(F.lit(None).cast("struct<start:int,back:int,kind:string>"))), lambda e, n: F.when(n.isNull() | (n["start"] >= e), e)), lambda e: e.isNotNull())
        groups = F.zip_with(heads, tails, lambda h, e: F.struct(h["s"]["start"].alias("start"), e.alias("end"), h["s"]["kind"].alias("kind")))
        return bound(groups, _cut)

    def _cut(groups: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(groups, lambda g: g["end"]))
        wide = F.encode(text, "UTF-32")  # four bytes a character: any part is cut without a walk from the beginning
        part = lambda w, a, n: F.decode(F.substring(w, 4 * a + 1, 4 * n), "UTF-32")
        piece = lambda w: F.zip_with(groups, starts, lambda g, at: F.when(g.isNotNull(), F.concat(part(w, at, g["start"] - at), F.lit("<"), F.upper(g["kind"]), F.lit(">"))).otherwise(part(w, at, F.length(text))))
        return F.array_join(bound(wide, piece), "")

    return F.when(F.size(spans) == 0, text).otherwise(bound(ordered, lambda o: bound(F.struct(o.alias("o"), reach(o).alias("r")), replaced)))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced and n_chars, where there is one, counted anew. A null text stays
    null; all columns stay."""
    row = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))  # no other column's name can clash
    clean = F.when(F.col("row.text").isNotNull(), redact(F.col("text"), F.col("spans"))).alias("text")
    out = with_spans(row).select("row", clean)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[new.get(c, F.col(f"row.`{c}`")) for c in docs.columns])


def _of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [k.name for k in KINDS if k.base]
    mark = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    found = detect(documents(spark, sf_dir)).select("doc_id", "spans")
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    own = F.transform(F.filter("spans", lambda s: s["kind"].isin(base)), mark)
    return found.select(
        "doc_id", *counts, F.sha2(F.array_join(own, ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", mark), ",").alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)), 6).alias("top_score"),
    )
