"""The pipeline's near-duplicates against all pairs."""

import random

import corpus_pipeline as p
from wardline.llm import near_copies, simhash


def _all_pairs(rows):
    sets = {}
    for i, text in rows:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {i: root(i) for i in sets}


def _changed(n=40):
    """Texts of 200 words, and copies of each with words changed: similarities of about 0.95 to 0.75."""
    r, rows = random.Random(7), []
    for i in range(n):
        words = [f"w{r.randrange(5000)}" for _ in range(200)]
        rows.append((10 * i, " ".join(words)))
        for k, changes in enumerate((1, 2, 3, 4, 5, 6), 1):
            copy = list(words)
            for at in r.sample(range(len(copy)), changes):
                copy[at] = "changed"
            rows.append((10 * i + k, " ".join(copy)))
    return rows


def test_copies_with_changed_words_are_found(spark):
    rows = _changed()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _all_pairs(rows)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == want
    kept = sorted(r.doc_id for r in p.near_duplicates(spark, docs, "").collect())
    assert kept == sorted(set(want.values()))
    assert len(set(want.values())) < len({r.component_id for r in simhash.near_duplicates(docs).collect()})


def test_large_groups_are_dealt_in_parts(spark, sf, monkeypatch):
    monkeypatch.setattr(near_copies, "PART", 3)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    base = " ".join(f"b{i}" for i in range(100))
    rows += [(1000 + i, f"{base} {' '.join(f't{j}' for j in range(i))}") for i in range(0, 60, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == _all_pairs(rows)


def test_odd_rows(spark, odd, none):
    got = near_copies.near_copies(odd).collect()
    assert len(got) == odd.count() and {r.doc_id: r.component_id for r in got}[10] == 1
    assert near_copies.near_copies(none).count() == 0


def test_fingerprints_at_most_four_bits_apart_are_compared(spark):
    r, sims = random.Random(3), []
    for _ in range(30):
        base = r.getrandbits(64)
        sims += [base] + [base ^ sum(1 << b for b in r.sample(range(64), k)) for k in (0, 1, 3, 4, 5, 9)]
    rows = [(i, s - (1 << 64) if s >> 63 else s) for i, s in enumerate(sims)]

    def joined(pairs):
        low = list(range(len(sims)))

        def root(i):
            while low[i] != i:
                i = low[i]
            return i

        for a, b in pairs:
            x, y = sorted((root(a), root(b)))
            low[y] = x
        return [root(i) for i in low]

    close = [tuple(x) for x in near_copies._close(spark.createDataFrame(rows, "fp long, sim long")).collect()]
    near = [(a, b) for a in range(len(sims)) for b in range(a) if (sims[a] ^ sims[b]).bit_count() <= 4]
    assert joined(close) == joined(near)
    assert all((sims[a] ^ sims[b]).bit_count() <= 4 and a < b for a, b in close)


def test_joins_with_hot_keys_make_no_rows_but_the_result(spark):
    from pyspark.sql import functions as F
    from wardline.llm.common import stored
    from wardline.llm.graph import spread_join

    rows = spark.range(1000).select(F.when(F.col("id") < 200, 7).otherwise(F.col("id")).alias("g"), F.col("id").alias("fp"))
    sizes = stored(rows.groupBy("g").agg(F.count("*").alias("n")).where("g % 3 = 1"))
    got = spread_join(rows, sizes, ["g"], 1000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(sizes, "g").collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Join Inner") == 2
