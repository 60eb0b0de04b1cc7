"""Every query with SQL against DuckDB; every other one gives rows with named columns, the same ones when it runs again."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from wardline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return f"{float(v):.6f}" if hasattr(v, "__float__") else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    want = duck.execute(registry.ORACLE_SQL[name])
    names, rows = [d[0] for d in want.description], want.fetchall()
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    mine = sorted([_plain(r[c]) for c in order] for r in got.collect())
    assert mine == sorted([_plain(r[names.index(c)]) for c in order] for r in rows)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_without_sql(spark, sf, name):
    """What these return is tested by golden rows and properties in test_operators.py and test_whole_queries.py."""
    got = registry.QUERIES[name](spark, sf)
    rows = got.collect()
    assert rows and len(set(got.columns)) == len(got.columns) and all(any(v is not None for v in r) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, registry.QUERIES[name](spark, sf).collect()))


def test_guards_attachments_and_dense_texts_all_occur(spark, sf):
    rules = ",".join(r.rules for r in registry.QUERIES["G01_decisions"](spark, "/root/testdata/sf0.01").collect())  # 20 requests are too few
    assert all(r in rules for r in ("GW-001", "GW-003", "MAL-001", "PII-900", "PII-001", "INJ-", "DLP-"))
    assert {r.guard for r in registry.QUERIES["P07_count_guard"](spark, sf).collect()} == {"GW-001", "GW-003", None}
    assert {r.too_large for r in registry.QUERIES["P06_size_guard"](spark, sf).collect()} == {True, False}
    assert {r.too_dense for r in registry.QUERIES["M18_token_density"](spark, sf).collect()} == {True, False}


def test_densities_are_of_all_whole_texts(spark, sf, duck):
    from wardline.plans import privacy

    whole = duck.execute(f"{privacy._DENSE} SELECT request, round(density, 6) FROM y").fetchall()
    got = {r.request: r.density for r in registry.QUERIES["M18_token_density"](spark, sf).collect()}
    assert len(whole) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(abs(got[k] - v) < 1e-6 for k, v in whole)


def test_exact_lookups_hit_miss_and_expire(spark, sf):
    got = registry.QUERIES["C03_exact_lookup"](spark, sf).collect()
    assert {r.hit for r in got} == {True, False} and len(got) == spark.read.parquet(f"{sf}/events.parquet").count()
    assert all(int(r.response.split()[1]) != r.lookup_id for r in got if r.hit)


def test_second_passes_differ(spark, sf):
    rows = {n: {r.request: (r.masked_sha256, r.persons) for r in registry.QUERIES[f"M15_second_pass{n}"](spark, sf).collect()} for n in ("", "_as_of", "_off")}
    differ = lambda a, b: sum(rows[a][k] != rows[b][k] for k in rows[a])
    assert differ("", "_off") > differ("_as_of", "_off") > 0 and differ("", "_as_of") > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries())
