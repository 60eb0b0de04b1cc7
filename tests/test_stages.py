"""Every stage of a decision takes effect."""

from pyspark.sql import functions as F

from wardline.operators import decide
from wardline.plans.registry import screening


def test_attachments_are_the_first_stage(spark):
    rows = spark.createDataFrame([(i, "t", "m", 0, "user", "a calm note") for i in range(4)], "request int, tenant string, model string, idx int, role string, text string")
    files = [(0, 0, b"MZ\x90\x00", "application/octet-stream"), (1, 0, b"plain words", "text/plain"), (2, 0, b"x" * 900, "text/plain")]
    files = decide.attached(spark.createDataFrame(files, "request int, ord int, bytes binary, media_type string"))
    got = {r.request: r for r in decide.decided(rows, max_bytes=500, attachments=files).collect()}
    assert [f.rule_id for f in got[0].findings][0] == "MAL-001" and got[0].content == "a calm note" and got[0].forwarded is None
    assert [got[i].disposition for i in range(4)] == ["block", "allow", "block", "allow"]
    assert [f.rule_id for f in got[2].findings] == ["GW-001"]
    assert {r.request for r in decide.admitted(rows, files, max_bytes=500).collect()} == {1, 3}


def test_queries_block_attachments_and_mask_names(spark, sf, monkeypatch):
    def planted(spark, d):
        own = [(1, "t", "m", 0, "user", "Herr Anna Schmidt kam heute mit vielen anderen Leuten aus der Stadt zu uns."), (2, "t", "m", 0, "user", "max.muster@firma.de"), (4, "t", "m", 0, "user", "Bernd Schmidt blieb.")]
        return spark.createDataFrame(own, "request long, tenant string, model string, idx int, role string, text string")

    all_rules = {r.rule_id for r in screening._decided(spark, sf).select(F.explode("findings.rule_id").alias("rule_id")).collect()}
    assert "MAL-001" in all_rules
    monkeypatch.setattr(screening, "_requests", planted)
    got = {r.request: r for r in screening._decided(spark, sf).collect()}
    assert "Schmidt" not in got[1].forwarded[0].content and "PII-001" in [f.rule_id for f in got[1].findings]
    assert got[2].disposition == "block" and "PII-900" in [f.rule_id for f in got[2].findings]
