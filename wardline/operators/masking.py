"""Reversible masking: a vault of tokens as sets, replacement of spans, the second pass for known names, unmasking.

messages come as (partition, request, idx, ord, text): ord is a message's place in the order in which texts are
seen; within a message tokens are minted from right to left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.personal import CATEGORIES, Policy, alias_name, canonical_column, cleared, detector, name_core, name_parts, replacer, run_keys, spliced, token_density
from .storage import numbered, stored

VAULT = "partition string, canonical string, token string, value string, category string, seq long"


def _prefix(category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for c, (p, _, _) in CATEGORIES.items() for x in (c, p)]), category)


def detected(messages: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """A row for each hit that the policy masks: the message's keys, start, end, value, category, canonical. What is
    switched off or allowed is left out after overlaps are resolved, so it still hides what it overlapped."""
    spans = detector(policy.deny, policy.chains)(F.col("text"))
    hits = messages.withColumn("s", F.explode(spans)).select("partition", "request", "idx", "ord", "s.*")
    hits = hits.withColumn("canonical", canonical_column(F.col("value")))
    on = [c for c in CATEGORIES if policy.mode(c) != "off"]
    kept = hits.where(F.col("category").isin(on))
    if policy.allow:
        kept = kept.where(~F.col("canonical").isin([" ".join(a.lower().split()) for a in policy.allow]))
    return kept


def _last_word(canonical: Column) -> Column:
    return F.element_at(F.split(canonical, " "), -1)


def spared(hits: DataFrame, queries: DataFrame, vault: DataFrame | None = None) -> DataFrame:
    """hits without the persons that their request's question asks about: those detected in the question, the last
    words of those, and known names that stand in it. queries: (partition, request, query)."""
    asked = queries.where("query is not null and query <> ''")
    found = asked.withColumn("s", F.explode(detector()(F.col("query")))).where("s.category = 'person'").select("partition", "request", canonical_column(F.col("s.value")).alias("name"))
    if vault is not None:
        known = vault.where("category = 'person'").select("partition", F.regexp_replace("canonical", r"^person\|", "").alias("name")).distinct().withColumn("word", _key_word(F.col("name")))
        words = asked.select("partition", "request", "query", F.explode(_words(F.col("query"))).alias("word"))
        spaced = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}'-]+", " "), F.lit(" "))
        met = words.join(known, ["partition", "word"]).where(F.contains(spaced(F.col("query")), F.concat(F.lit(" "), "name", F.lit(" "))))
        found = found.union(met.select("partition", "request", "name"))
    keys = found.union(found.select("partition", "request", _last_word(F.col("name")))).distinct()
    names = keys.groupBy("partition", "request").agg(F.collect_set("name").alias("asked"))
    is_asked = F.coalesce(F.array_contains("asked", F.col("canonical")) | F.array_contains("asked", _last_word(F.col("canonical"))), F.lit(False))
    return hits.join(names, ["partition", "request"], "left").where((F.col("category") != "person") | ~is_asked).drop("asked")


def _words(text: Column) -> Column:
    """The different words of a text, hyphenated ones in parts."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}']+"), lambda w: w != ""))


def _key_word(name: Column) -> Column:
    """The part of a name by which texts that may hold it are found: its last word, after any hyphen."""
    return F.try_element_at(F.filter(F.split(name, r"[^\p{L}']+"), lambda w: w != ""), F.lit(-1))


def minted(hits: DataFrame, vault: DataFrame | None = None) -> DataFrame:
    """The vault after these hits: partition, canonical ('category|name'), token, value, category, seq.

    Each name counts once, by where it was first seen. Persons who share a surname are one token if the bare surname
    came first; else each full name has its own, and a later bare surname goes with the first of them. Tokens are
    numbered within (partition, category) by first sight, on from what an older vault holds. Names are made distinct
    before anything is ordered, and the numbering spreads large partitions over tasks."""
    seen = hits.groupBy("partition", "category", "canonical").agg(F.min(F.struct("ord", (-F.col("start")).alias("back"), "value")).alias("first"))
    names = seen.select("partition", "category", F.concat_ws("|", "category", "canonical").alias("canonical"), F.col("first.ord").alias("ord"), F.col("first.back").alias("back"), F.col("first.value").alias("value"))
    old = None
    if vault is not None:
        old = vault.select("partition", "canonical", "token", "value", "category", "seq")
        names = names.join(old.select("partition", "canonical"), ["partition", "canonical"], "left_anti")
    own = F.element_at(F.split("canonical", r"\|", 2), 2)
    person = F.col("category") == "person"
    surname, bare = _last_word(own), person & (F.size(F.split(own, " ")) == 1)
    columns = ["partition", "category", "canonical", "ord", "back", "value"]
    rows = names.select(*columns, F.lit(None).cast("string").alias("token"))
    if old is not None:
        rows = rows.union(old.select("partition", "category", "canonical", (F.col("seq") - F.lit(1 << 60)).alias("ord"), F.lit(0).alias("back"), "value", "token"))
    rows = rows.withColumn("surname", F.when(person, surname).otherwise(F.col("canonical"))).withColumn("bare", bare)
    first = rows.groupBy("partition", "category", "surname").agg(
        F.min(F.struct("ord", "back", "canonical", "bare", "token")).alias("first"), F.min(F.when(~F.col("bare"), F.struct("ord", "back", "canonical", "token"))).alias("full"),
    )
    rows = rows.join(first, ["partition", "category", "surname"])
    leader = F.when(~person, F.struct("canonical", "token")).when(F.col("first.bare"), F.struct("first.canonical", "first.token"))
    leader = leader.when(F.col("bare"), F.struct(F.col("full.canonical"), F.col("full.token"))).otherwise(F.struct("canonical", "token"))
    rows = rows.withColumn("leader", leader.cast("struct<canonical:string,token:string>"))
    new = rows.where("token is null and leader.token is null")
    groups = new.groupBy("partition", "category", F.col("leader.canonical").alias("head")).agg(F.min(F.struct("ord", "back")).alias("at"))
    groups = numbered(groups.select("partition", "category", "head", "at.ord", "at.back"), ["partition", "category"], ["ord", "back", "head"])
    if old is not None:
        highest = old.groupBy("partition", "category").agg(F.max(F.regexp_extract("token", r"-([0-9]+)\]$", 1).cast("long")).alias("high"))
        groups = groups.join(highest, ["partition", "category"], "left").withColumn("n", F.col("n") + F.coalesce("high", F.lit(0)))
    tokens = groups.select("partition", "category", F.col("head"), F.format_string("[%s-%d]", _prefix(F.col("category")), "n").alias("fresh"))
    named = rows.withColumn("head", F.col("leader.canonical")).join(tokens, ["partition", "category", "head"], "left")
    token = F.coalesce("token", F.col("leader.token"), "fresh")
    alias = person & F.col("bare") & (F.col("head") != F.col("canonical"))
    shown = F.when(alias, "").otherwise(F.col("value"))
    return named.select("partition", "canonical", token.alias("token"), shown.alias("value"), "category", F.col("ord").cast("long").alias("seq"))


def shown_values(vault: DataFrame) -> DataFrame:
    """(partition, token, value, category): of each token the first entry that has a value."""
    return vault.where("value <> ''").groupBy("partition", "token", "category").agg(F.min_by("value", F.struct("seq", "canonical")).alias("value")).select("partition", "token", "value", "category")


def merged_vault(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Two vaults as one: of each canonical the first entry stands, older ones first."""
    both = older.withColumn("gen", F.lit(0)).unionByName(newer.withColumn("gen", F.lit(1)))
    return both.groupBy("partition", "canonical").agg(F.min_by(F.struct("token", "value", "category", "seq"), F.struct("gen", "seq", "token")).alias("e")).select("partition", "canonical", "e.*")


def counters(vault: DataFrame) -> DataFrame:
    """The highest number in use for each prefix of a partition."""
    n = F.regexp_extract("token", r"^\[(\w+)-([0-9]+)\]$", 2).cast("long")
    return vault.groupBy("partition", F.regexp_extract("token", r"^\[(\w+)-", 1).alias("prefix")).agg(F.max(n).alias("highest"))


def masked(messages: DataFrame, policy: Policy = Policy(), vault: DataFrame | None = None, queries: DataFrame | None = None, second_pass: str = "corpus") -> tuple[DataFrame, DataFrame]:
    """(messages with masked text, counts, density and the map back; the vault after them).

    second_pass: 'corpus' replaces every name of the partition wherever it stands in any message; 'asof' only names
    first seen up to that message; 'off' none. Names meet messages by an equi-join of whole names with the messages' runs of
    as many words, so a message meets the names that stand in it and no others. Null and empty texts pass unmasked."""
    messages = messages.withColumn("text", F.coalesce("text", F.lit("")))
    hits = detected(messages, policy)
    if policy.keep_asked and queries is not None:
        hits = spared(hits, queries, vault)
    hits = stored(hits, "hits")
    book = stored(minted(hits, vault), "vault")
    shown = lambda token: F.coalesce(alias_name(token), token) if policy.mode("person") == "alias" else token
    placed = hits.withColumn("canonical", F.concat_ws("|", "category", "canonical")).join(book.select("partition", "canonical", "token"), ["partition", "canonical"])
    key = ["partition", "request", "idx"]
    spans = placed.groupBy(*key).agg(
        F.collect_list(F.struct("start", "end", shown(F.col("token")).alias("shown"))).alias("spans"), F.collect_set("token").alias("tokens"), F.collect_list("category").alias("categories"),
    )
    out = messages.join(spans, key, "left").withColumn("masked", spliced()("text", "spans"))
    if second_pass != "off" and policy.mode("person") != "off":
        names = book.where("category = 'person'").select("partition", F.regexp_replace("canonical", r"^person\|", "").alias("name"), "token", "seq")
        if policy.allow:
            names = names.where(~F.col("name").isin([" ".join(a.lower().split()) for a in policy.allow]))
        names = names.withColumn("run", name_core(F.col("name")))
        sizes = sorted(r.n for r in names.select(name_parts(F.col("run")).alias("n")).distinct().where("n > 0").collect())  # different numbers of words
        runs = out.select(*key, "ord", F.explode(run_keys(sizes)("masked")).alias("run"))
        met = runs.join(names, ["partition", "run"])
        if second_pass == "asof":
            met = met.where("seq <= ord")
        known = met.groupBy(*key).agg(F.collect_set(F.struct("name", shown(F.col("token")).alias("shown"), "token")).alias("known"))
        out = out.join(known, key, "left").withColumn("again", replacer()("masked", F.col("known")))
        out = out.withColumn("masked", F.coalesce("again.text", "masked"))
        found = F.filter("known", lambda k: F.array_contains("again.found", k["name"]))
        more = F.coalesce(F.transform(found, lambda k: k["token"]), F.array().cast("array<string>"))
        out = out.withColumn("tokens", F.array_distinct(F.concat(F.coalesce("tokens", F.array().cast("array<string>")), more)))
        out = out.withColumn("categories", F.concat(F.coalesce("categories", F.array().cast("array<string>")), F.transform(more, lambda _: F.lit("person"))))
    used = out.select(*key, F.explode("tokens").alias("token")).join(shown_values(book), ["partition", "token"])
    pairs = used.groupBy(*key).agg(F.collect_list(F.struct("token", "value")).alias("pairs"))
    out = out.join(pairs, key, "left")
    names_ = F.coalesce("categories", F.array().cast("array<string>"))
    counted = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(names_)), lambda c: F.struct(c, F.size(F.filter(names_, lambda x: x == c)))))
    return out.select(
        *key, "ord", "text", "masked", counted.alias("counts"), token_density(F.col("masked")).alias("density"), session_map(F.col("pairs")).alias("session"),
    ), book


def session_map(pairs: Column) -> Column:
    """Token and alias form -> clear value, from (token, value) pairs."""
    own = F.coalesce(pairs, F.expr("cast(array() as array<struct<token:string,value:string>>)"))
    entries = F.flatten(F.transform(own, lambda p: F.filter(F.array(F.struct(p["token"].alias("k"), p["value"].alias("v")), F.struct(alias_name(p["token"]).alias("k"), p["value"].alias("v"))), lambda e: e["k"].isNotNull())))
    return F.map_from_entries(entries)


def pii_findings(counts: Column, density: Column, policy: Policy = Policy()) -> Column:
    """Findings of masking in the order of category names, and PII-900 where tokens are too dense."""
    from ..functions.scan import finding

    own = [F.when(F.coalesce(F.element_at(counts, F.lit(c)), F.lit(0)) > 0, finding(r, "pii", s, 0.0, F.element_at(counts, F.lit(c)))) for c, (_, r, s) in sorted(CATEGORIES.items())]
    abstain = policy.on_density == "abstain"
    dense = F.when(density > policy.max_density, finding("PII-900", "pii", "high" if abstain else "low", 1.0 if abstain else 0.0, 1))
    return F.filter(F.array(*own, dense), lambda f: f.isNotNull())


def unmask(text: Column, session: Column) -> Column:
    """Every known form replaced by its clear value, longest first; unknown tokens stay. One walk over the text, whatever the
    number of forms."""
    return cleared()(text, F.map_entries(session))


def restored(texts: DataFrame, vault: DataFrame) -> DataFrame:
    """texts (partition, id, text) with tokens restored from the partition's vault: only tokens that a text holds
    are joined."""
    found = texts.select("partition", "id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\w+-[0-9]+\]"), F.lit(0)))).alias("token"))
    pairs = found.join(shown_values(vault), ["partition", "token"]).groupBy("partition", "id").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("session"))
    return texts.join(pairs, ["partition", "id"], "left").select("partition", "id", unmask(F.col("text"), F.col("session")).alias("text"))


def merged_sessions(maps: DataFrame) -> DataFrame:
    """(partition, request, idx, session) -> one map a request; of equal keys the earliest message's value stands."""
    rows = maps.select("partition", "request", "idx", F.explode("session").alias("k", "v"))
    first = rows.groupBy("partition", "request", "k").agg(F.min_by("v", "idx").alias("v"))
    return first.groupBy("partition", "request").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("session"))
