"""License statements in whole texts by ordered signature rules, in built-in expressions only.

A text is first brought to lower-case words with one blank between them. One test for any of a few literals lets
through the texts that may say anything of a license; of the rules (license_rules) only those whose own keyword stands
in the text are tried. A rule's matches become intervals of words. An interval that lies inside another of the same or
a higher priority is suppressed, so 'mit license' inside 'released under the mit license' says nothing more.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, documents, running, text_rows
from .license_rules import CREATIVE_COMMONS, IDENTIFIERS, NOTICES, SENTENCES, STATEMENTS


#: The phrases of the base: words, label.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Each rule's matches hold one of these, among the words with single blanks.
GATE = (
    "licen", "lizenz", "spdx", "apache", "bsd", "gpl", "mpl 2", "cddl", "eupl", "eclipse org", "under mit", "under the mit", "terms of mit", "terms of the mit", "by mit", "by the mit",
    "to mit", "to the mit", "with mit", "with the mit", "mit no attribution", "under isc", "under the isc", "by isc", "by the isc", "of isc", "of the isc", "to isc", "to the isc", "with isc", "with the isc", "same terms as perl", "wtfpl",
    "odbl", "odc by", "cecill", "good not evil", "openrail", "cc by", "cc0", "creative commons", "creativecommons org", "permission", "redistribution", "used to endorse",
    "advertising materials", "as is without warranty", "contents of this file", "altered source", "origin of this software", "unencumbered", "you just do what", "psf is making", "openssl toolkit",
    "reserved font name", "font software", "functionality of the program", "buy me a beer", "waived all copyright", "invariant sections", "developed by the apache", "public domain", "gemeinfrei", "domaine public",
    "dominio público", "rights reserved", "rights are reserved", "rechte vorbehalten", "droits réservés", "derechos reservados", "diritti riservati", "proprietary", "may not be reproduced", "copying of this",
    "commercial use only", "personal use only", "research purposes only",
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    strength: float


def rules() -> list[Rule]:
    """All signature rules, those of the highest priority first, and the base's phrases."""
    own = [Rule(*r) for table in (IDENTIFIERS, STATEMENTS, CREATIVE_COMMONS, SENTENCES, NOTICES) for r in table]
    return sorted(own + [Rule(label, words, words, 1, 0.6) for words, label in BASE], key=lambda r: -r.priority)


def lower_ascii(text: Column) -> Column:
    """The text with A-Z in lower case, and other capitals too where that can't make an ASCII letter (of U+0130 and
    U+212A it would)."""
    rare = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    return F.when(rare, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def normal_words(lower: Column) -> Column:
    """The words of a lower-case text with one blank between them."""
    return F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _any_of(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def _blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _whole(pattern: str) -> str:
    return f"(?<![^ ])(?:{pattern})(?![^ ])"


def _cut(words: Column, pattern: str) -> tuple[Column, Column]:
    """The texts between the matches of a pattern that starts and ends with whole words, and the matches."""
    return F.split(words, _whole(pattern), -1).alias("gaps"), F.regexp_extract_all(words, F.lit(_whole(pattern)), F.lit(0)).alias("hits")


def _places(gaps: Column, hits: Column) -> Column:
    """(start, end) in words of each match: running sums of the blanks up to it."""
    pairs = F.filter(F.zip_with(gaps, hits, lambda g, v: F.struct(_blanks(g).alias("gap"), _blanks(v).alias("hit"))), lambda p: p["hit"].isNotNull())

    def places(ps: Column) -> Column:
        last = running(F.transform(ps, lambda p: p["gap"] + p["hit"]), lambda a, b: a + b, F.lit(0))
        return F.zip_with(ps, last, lambda p, at: F.struct((at - p["hit"]).alias("start"), (at + 1).alias("end")))

    return bound(pairs, places)


_DETECTION = "struct<start:int,back:int,rank:int,label:string,strength:double>"


def _detections(table: list[Rule]) -> Column:
    """All matches, in the column words, of the rules whose keyword stands in the text: by start, longer ones first, then by priority. The
    rules are one constant, which keeps the plan small; of them only those behind a keyword that is there are compiled."""


    quoted = lambda t: "'" + t + "'"
    each = [f"struct('{r.label}' AS label, array({', '.join(map(quoted, r.keyword.split('|')))}) AS keywords, '{_whole(r.pattern)}' AS pattern, {-r.priority} AS rank, double({r.strength}) AS strength)" for r in table]
    named = "filter(rules, r -> exists(r.keywords, k -> contains(words, k)) AND regexp_like(words, r.pattern))"
    cut = "split(words, r.pattern, -1) AS gaps, regexp_extract_all(words, r.pattern, 0) AS hits"
    fired = F.expr(f"transform(array(array({', '.join(each)})), rules -> transform({named}, r -> struct(r.label, r.rank, r.strength, {cut})))[0]")
    found = F.transform(fired, lambda f: F.transform(_places(f["gaps"], f["hits"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("back"), f["rank"].alias("rank"), f["label"].alias("label"), f["strength"].alias("strength"))))
    return F.array_sort(F.flatten(found))


def _resolved(detections: Column) -> Column:
    """(labels, score) after suppression: a detection inside an earlier one (by start, longest first) of at least its
    priority goes. reach[p] is the furthest end of the detections of priority p or more so far."""

    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["back"], -d["rank"]
        inside = F.element_at(acc["reach"], priority + 1) >= end
        reach = F.transform(acc["reach"], lambda x, j: F.when(j <= priority, F.greatest(x, end)).otherwise(x))
        kept = F.struct(reach.alias("reach"), F.array_union(acc["labels"], F.array(d["label"])).alias("labels"), F.greatest(acc["score"], d["strength"]).alias("score"))
        return F.when(inside, acc).otherwise(kept)

    zero = F.struct(F.array(*[F.lit(-1)] * 4).alias("reach"), F.expr("cast(array() as array<string>)").alias("labels"), F.lit(0.0).alias("score"))
    return F.aggregate(detections, zero, step)


def scan(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """A row per document: doc_id, n_words, base (array of word, label of each base phrase's places), labels (sorted,
    the base's among them), score (0 without a license).

    Narrow. Null and empty texts have no words and no labels. Equal intervals resolve to the higher priority, then
    to the label first in order. Repeated rows get a row each; other columns are ignored; an empty table gives an
    empty one."""
    words = F.col("words")
    out = text_rows(docs).select("doc_id", normal_words(lower_ascii(F.col("text"))).alias("words"))
    nothing = F.expr("cast(array() as array<struct<word:int,label:string>>)")
    base = F.concat(*[_base(words, phrase, label, nothing) for phrase, label in BASE])
    out = out.select(
        "doc_id", F.when(words == "", 0).otherwise(_blanks(words) + 1).cast("long").alias("n_words"),
        base.alias("base"), F.when(_any_of(words, GATE), _detections(table or rules())).alias("detections"),
    )
    out = out.withColumn("found", F.when(F.size("detections") > 0, _resolved(F.col("detections"))))
    own = F.coalesce(F.col("found.labels"), F.expr("cast(array() as array<string>)"))
    labels = F.array_sort(F.array_union(own, F.transform("base", lambda b: b["label"])))
    score = F.greatest(F.coalesce("found.score", F.lit(0.0)), F.when(F.size("base") > 0, 0.6).otherwise(0.0))
    return out.select("doc_id", "n_words", "base", labels.alias("labels"), F.round(score, 6).alias("score"))


def _base(words: Column, phrase: str, label: str, nothing: Column) -> Column:
    places = F.transform(_places(*_cut(words, phrase)), lambda x: F.struct(x["start"].alias("word"), F.lit(label).alias("label")))
    return F.when(F.contains(words, F.lit(phrase)), places).otherwise(nothing)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    at = F.transform("base", lambda b: b["word"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )
