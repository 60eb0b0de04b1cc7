"""Queries over all rows against brute force."""

import hashlib

import regex

from wardline.functions.personal import canonical
from wardline.operators import cache
from wardline.plans import registry
from wardline.plans.fixtures import messages, notes


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_canonical_forms_of_all_texts(spark, sf):
    rows = notes(spark, sf).select("request", "text").collect()
    assert any(len(r.text) >= 400 for r in rows) and any(not r.text.isascii() for r in rows)
    got = registry.QUERIES["M11_canonical_form"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted((r.request, _sha(canonical(r.text))) for r in rows)


def test_signatures_of_all_messages(spark, sf):
    rows = messages(spark, sf).select("request", "idx", "text").collect()
    assert any(not r.text.isascii() for r in rows)
    want = [(r.request, r.idx, _sha(",".join(sorted({t.lower() for t in regex.findall(cache.TERMS, r.text)} - set(cache.FUNCTION_WORDS))))) for r in rows]
    got = registry.QUERIES["C02_entity_signature"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_every_vector_is_looked_up_and_an_entry(spark, sf):
    rows = {r.vec_id: r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}

    def near(i):
        others = [j for j in rows if j != i and rows[j].label == rows[i].label]
        return any(sum(a * b for a, b in zip(rows[i].embedding, rows[j].embedding)) >= 0.3 * (sum(a * a for a in rows[i].embedding) * sum(b * b for b in rows[j].embedding)) ** 0.5 for j in others)

    want = {i: "exact" if i % 4 == 0 and i + 1 in rows else "semantic" if near(i) else "miss" for i in rows}
    assert {r.lookup_id: r.kind for r in registry.QUERIES["C06_hit_kinds"](spark, sf).collect()} == want
    assert registry.QUERIES["C12_statistics"](spark, sf).first().lookups == len(rows)


def test_both_halves_are_in_the_merged_vault(spark, sf):
    from wardline.plans.privacy import _hits

    got = {(r.partition, r.canonical) for r in registry.QUERIES["S26_vault_merge"](spark, sf).collect()}
    hits = _hits(spark, sf).select("partition", "category", "canonical").distinct().collect()
    assert got == {(r.partition, f"{r.category}|{r.canonical}") for r in hits}
