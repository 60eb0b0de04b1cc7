"""Sanitizing and scoring of texts: hidden characters, rules, findings, risk and disposition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogue import DEFAULT_RULES, MULTIPLIERS, SEVERITIES, TRUSTED_SOURCES, UNTRUSTED_SOURCES, Rule
from .surface import surfaces

#: Characters that hide: format and control characters (but tab, line feed, return), variation selectors, fillers,
#: blanks that look like nothing, line and paragraph separators. Java and RE2 read this alike.
HIDDEN = (
    r"[\p{Cf}\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"
    r"\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}\x{34F}\x{180E}\x{2028}\x{2029}]"
)
STRONG = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}\x{E0000}-\x{E007F}]"
FINDING = "struct<rule_id:string,category:string,severity:string,weight:double,occurrences:int>"
SIZE_LIMIT = 200_000


def finding(rule_id: str, category: str, severity, weight, occurrences) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(category).alias("category"), lit(severity).alias("severity"),
        lit(weight).cast("double").alias("weight"), lit(occurrences).cast("int").alias("occurrences"),
    )


def no_findings() -> Column:
    return F.expr(f"cast(array() as array<{FINDING}>)")


def sanitized(text: Column) -> Column:
    return F.regexp_replace(text, HIDDEN, "")


def hidden_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HIDDEN))


def source_trust(source: Column, user_created: Column | None = None, trusted=TRUSTED_SOURCES, untrusted=UNTRUSTED_SOURCES, unknown: str = "untrusted") -> Column:
    key = F.lower(source)
    by_type = F.when(key.isin(*trusted), "trusted").when(key.isin(*untrusted), "untrusted").otherwise(unknown)
    return by_type if user_created is None else F.when(user_created, "trusted").otherwise(by_type)


def role_trust(role: Column, cap_system: bool = False) -> Column:
    """System text is trusted (neutral under the cap), user and assistant text neutral, tool text untrusted."""
    return F.when(role == "system", "neutral" if cap_system else "trusted").when(role == "tool", "untrusted").otherwise("neutral")


def multiplier(trust: Column) -> Column:
    return F.when(trust == "trusted", MULTIPLIERS["trusted"]).when(trust == "untrusted", MULTIPLIERS["untrusted"]).otherwise(MULTIPLIERS["neutral"])


def _counted(rule: Rule, text: Column, lower: Column) -> Column:
    """Matches of a rule. Texts without any of its stems don't meet its pattern; letters that fold to ASCII only under
    Unicode rules (long s, Kelvin) let every text through."""
    count = F.regexp_count(text, F.lit(rule.java()))
    if not rule.stems:
        return count
    maybe = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(s)) for s in (*rule.stems, "\u017f", "\u212a")])
    return F.when(maybe, count).otherwise(0)


def raw_score(findings: Column) -> Column:
    """Weights added in the order of the findings, so that thresholds see the same double everywhere."""
    return F.aggregate(findings, F.lit(0.0), lambda a, f: a + f["weight"])


def risk(raw: Column, trust: Column) -> Column:
    return F.least(F.lit(1.0), raw * multiplier(trust))


def scan(df: DataFrame, text: str = "text", trust: str = "trust", rules: list[Rule] | None = None, normalize: bool = True, size_limit: int = SIZE_LIMIT) -> DataFrame:
    """df with cleaned, findings, raw_score, risk_score, was_modified. Narrow; a null text counts as empty.

    A rule is tried on the sanitized text; where that has no match and the rule isn't for secrets, on the detection
    surface if it differs; then, loosened, on letter-spaced text without its blanks. normalize=False leaves out the
    last two and with them the Python helper."""
    rules = DEFAULT_RULES if rules is None else rules
    content = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_removed", hidden_count(content)).withColumn("_strong", content.rlike(STRONG)).withColumn("cleaned", sanitized(content))
    lower = F.col("_lower")
    out = out.withColumn("_lower", F.lower("cleaned"))
    if normalize:
        out = out.withColumn("_surfaces", surfaces(F.col("cleaned")))
    counts = []
    for r in rules:
        plain = _counted(r, F.col("cleaned"), lower)
        later = F.lit(0)
        if normalize and r.category != "secret":
            top = F.col("_surfaces.surface")
            seen = F.when(top.isNotNull(), _counted(r, top, top)).otherwise(0)
            loose = F.when(F.col("_surfaces.compact").isNotNull(), F.regexp_count("_surfaces.compact", F.lit(r.relaxed()))).otherwise(0) if r.relaxed() else F.lit(0)
            later = F.when(F.col("_surfaces.surface").isNull() & F.col("_surfaces.compact").isNull(), 0).otherwise(F.when(seen > 0, seen).otherwise(loose))
        counts.append(F.struct(plain.alias("plain"), F.when(plain > 0, 0).otherwise(later).alias("later")))
    out = out.withColumn("_counts", F.array(*counts))
    ruled = [finding(r.rule_id, r.category, r.severity, r.weight, F.col("_counts")[i]["plain"] + F.col("_counts")[i]["later"]) for i, r in enumerate(rules)]
    evaded = F.size(F.filter("_counts", lambda c: c["later"] > 0))
    hidden = finding("SAN-002", "sanitization", "high", 0.35, F.col("_removed"))
    plain_hidden = finding("SAN-001", "sanitization", "low", 0.15, F.col("_removed"))
    listed = F.array(
        F.when(F.col("_strong"), hidden).otherwise(plain_hidden), *ruled, finding("SAN-003", "injection", "high", 0.25, evaded),
        finding("ANO-001", "anomaly", "low", 0.2, (F.length("cleaned") > size_limit).cast("int")),
    )
    out = out.withColumn("findings", F.filter(listed, lambda f: f["occurrences"] > 0))
    out = out.withColumn("raw_score", raw_score(F.col("findings"))).withColumn("risk_score", risk(F.col("raw_score"), F.col(trust)))
    return out.withColumn("was_modified", F.col("_removed") > 0).drop("_removed", "_strong", "_lower", "_surfaces", "_counts")


def disposition(findings: Column, raw: Column, trust: Column, modified: Column, threshold: float = 0.7, suppressed: tuple[str, ...] = ()) -> Column:
    """(disposition, risk): weights of suppressed rules are taken off the raw score before trust weighs it."""
    less = F.aggregate(F.filter(findings, lambda f: f["rule_id"].isin(*suppressed)), F.lit(0.0), lambda a, f: a + f["weight"]) if suppressed else F.lit(0.0)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw - less) * multiplier(trust))
    return F.struct(F.when(score >= threshold, "block").when(modified, "allow_modified").otherwise("allow").alias("disposition"), score.alias("risk_score"))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1
