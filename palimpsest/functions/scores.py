"""Confidence, triage, impact and other scores as expressions. Truthy chains skip zero and '' as well as null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the impact factors; they add up to 1.05 and are kept so.
IMPACT_WEIGHTS = {"directness": "0.20", "legal_severity": "0.25", "scope": "0.20", "regulatory_urgency": "0.10", "operational_urgency": "0.10", "response_cost": "0.20"}
CHANGED_WORDS = ("changed", "updated", "new", "modified", "added")
#: Number of an impact label, and weight of a forced level.
LEVEL_NUMBERS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
FORCED_SCORES = {"High": 4.5, "Medium": 3.0, "Low": 2.0}


def truthy(*values: Column) -> Column:
    """The first number that is neither null nor zero, else 0.0."""
    return F.coalesce(*(F.nullif(v.cast("double"), F.lit(0.0)) for v in values), F.lit(0.0))


def adjusted_confidence(base: Column, adversarial: Column, has_numbers: Column) -> Column:
    c = F.coalesce(adversarial, base, F.lit(0.5))
    return F.when(F.coalesce(has_numbers, F.lit(False)), F.least(c + 0.1, F.lit(1.0))).otherwise(c)


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.8, "HIGH").when(c >= 0.5, "MEDIUM").when(c >= 0.4, "LOW").otherwise("UNCERTAIN")


def passes_confidence(changed: Column, c: Column) -> Column:
    return F.when(changed, c >= 0.5).otherwise(c >= 0.55)


def triage(changed: Column, status: Column, c: Column) -> Column:
    """actionable, pending or dropped."""
    word = F.lower(F.coalesce(status, F.lit("")))
    positive = F.coalesce(changed, F.lit(False)) | word.isin(*CHANGED_WORDS)
    return F.when(word == "inconclusive", "pending").when(positive & (c >= 0.7), "actionable").when(positive & (c >= 0.5), "pending").otherwise("dropped")


def impact_score(factors: dict[str, Column]) -> Column:
    """Weighted sum in exact decimals; missing factors count zero."""
    terms = [F.coalesce(factors[k].cast("decimal(5,2)"), F.lit(0).cast("decimal(5,2)")) * F.lit(w).cast("decimal(5,2)") for k, w in IMPACT_WEIGHTS.items() if k in factors]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def impact_level(score: Column) -> Column:
    return F.when(score >= 4, "High").when(score >= 2.5, "Medium").otherwise("Low")


def forced_level(feedback: Column) -> Column:
    """The first of High, Medium, Low that the feedback names."""
    word = F.lower(F.coalesce(feedback, F.lit("")))
    return F.when(word.contains("high"), "High").when(word.contains("medium"), "Medium").when(word.contains("low"), "Low")


def forced_score(level: Column) -> Column:
    return F.when(level == "High", 4.5).when(level == "Medium", 3.0).when(level == "Low", 2.0)


def months_left(effective: Column, as_of: Column) -> Column:
    days = F.datediff(F.try_to_timestamp(effective, F.lit("yyyy-MM-dd")).cast("date"), as_of)
    return F.when(days.isNotNull(), F.greatest(F.round(days / 30, 2), F.lit(0.0)))


def urgency_band(months: Column) -> Column:
    return F.when(months >= 12, 1).when(months >= 6, 2).when(months >= 3, 3).when(months > 1, 4).when(months.isNotNull(), 5)


def scope_band(share: Column) -> Column:
    return F.when(share >= 0.7, 5).when(share >= 0.5, 4).when(share >= 0.3, 3).when(share >= 0.1, 2).otherwise(1)


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def leading_number(t: Column) -> Column:
    return F.nullif(F.regexp_extract(t.cast("string"), r"^\s*(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def gap(current: Column, required: Column) -> Column:
    return leading_number(current) - leading_number(required)


def page_complexity(has_table: Column, h_lines: Column, v_lines: Column) -> Column:
    return F.when(has_table, F.least(F.lit(0.5) + h_lines * v_lines / 1000, F.lit(1.0))).otherwise(F.lit(0.1))


def page_route(complexity: Column, has_table: Column) -> tuple[Column, Column]:
    """(model, dpi)"""
    return F.when(complexity >= 0.3, "large").otherwise("mini"), F.when(has_table | (complexity >= 0.3), 300).otherwise(150)


def level_number(label: Column) -> Column:
    word = F.upper(F.coalesce(label, F.lit("")))
    return F.when(word == "HIGH", 3).when(word == "MEDIUM", 2).otherwise(1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def pseudo_embedding(text: Column, size: int = 1024) -> Column:
    """Bytes of the SHA-256 digest over 255, repeated to ``size``."""
    digest = F.sha2(text, 256)
    one = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)
    return F.flatten(F.array_repeat(one, size // 32))
