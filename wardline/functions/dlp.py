"""Redaction by rules in order, each on what the one before it left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogue import DLP_RULES, DlpRule
from .scan import finding


def literal_replacement(text: str) -> str:
    """A replacement that stands for itself in a Java regular expression."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def redacted(df: DataFrame, text: str = "text", rules: list[DlpRule] | None = None) -> DataFrame:
    """df with dlp_text, dlp_findings, dlp_score, dlp_modified. allow reports, redact replaces, block adds 1.0 and
    leaves the text. A null text counts as empty."""
    out = df.withColumn("dlp_text", F.coalesce(F.col(text), F.lit("")))
    rules = DLP_RULES if rules is None else rules
    for i, r in enumerate(rules):
        out = out.withColumn(f"_n{i}", F.regexp_count("dlp_text", F.lit(r.java())))
        if r.action == "redact":
            out = out.withColumn("dlp_text", F.when(F.col(f"_n{i}") > 0, F.regexp_replace("dlp_text", r.java(), literal_replacement(r.replacement))).otherwise(F.col("dlp_text")))
    listed = F.array(*[finding(r.rule_id, "dlp", r.severity, 1.0 if r.action == "block" else 0.0, F.col(f"_n{i}")) for i, r in enumerate(rules)])
    out = out.withColumn("dlp_findings", F.filter(listed, lambda f: f["occurrences"] > 0))
    changed = [F.col(f"_n{i}") > 0 for i, r in enumerate(rules) if r.action == "redact"]
    modified: Column = F.lit(False)
    for c in changed:
        modified = modified | c
    score = F.aggregate("dlp_findings", F.lit(0.0), lambda a, f: a + f["weight"])
    return out.withColumn("dlp_score", score).withColumn("dlp_modified", modified).drop(*[f"_n{i}" for i in range(len(rules))])
