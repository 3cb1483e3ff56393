"""Rules that rows must keep, as columns that are true where they do: mappings, strategies, impact scores, and API values.

Some rules ask what only a reader can tell (is the strategy feasible, is the
reasoning sound). Of these, what the row itself and its history tell is checked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import scores


def _given(*columns: Column) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & c.isNotNull()
    return ok


def mapping_rules(applies: Column, required: Column, current: Column, gap: Column, category: Column, kind: Column, condition: Column, evidence: Column) -> dict[str, Column]:
    """M2: nothing is required of what does not apply. M3: a gap is current less required. M4: a required value stands in the evidence. M5: all fields are there."""
    number = lambda c: c.cast("double")
    complete = _given(applies, category, kind, condition) & (~applies | required.isNotNull())
    return {
        "M2": applies | (required.isNull() & current.isNull() & gap.isNull()),
        "M3": gap.isNull() | (F.abs(number(current) - number(required) - number(gap)) < 1e-9),
        "M4": required.isNull() | F.contains(F.coalesce(evidence, F.lit("")), required.cast("string")),
        "M5": complete,
    }


def strategy_rules(feature: Column, level: Column, summary: Column, known: Column) -> dict[str, Column]:
    """S1: it is for a feature that is known to need one. S4: all fields are there and not blank."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return {"S1": F.array_contains(known, feature), "S4": filled(feature) & filled(level) & filled(summary)}


def impact_rules(factors: dict[str, Column], weighted: Column, reasoning: Column) -> dict[str, Column]:
    """I2: directness is 0 or 1, other factors lie in 1 to 5, and the weighted score is their sum. I4: all fields are there."""
    ranged = factors["directness"].isin(0, 1)
    for name, value in factors.items():
        ranged = ranged if name == "directness" else ranged & value.between(1, 5)
    summed = F.abs(scores.impact_score(factors).cast("double") - weighted) < 0.005
    return {"I2": ranged & summed, "I4": _given(*factors.values(), weighted) & (F.trim(F.coalesce(reasoning, F.lit(""))) != "")}


def words_of(body: Column) -> Column:
    """The distinct words of a text, lower-cased, without marks."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(body, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def grounded_mapping(kind: Column, condition: Column, text: Column, kinds: tuple[str, ...]) -> dict[str, Column]:
    """M1: the requirement is of a known kind, and every word of its condition stands in the regulation's text."""
    return {"M1": F.coalesce(kind.isin(*kinds), F.lit(False)) & (F.size(F.array_except(words_of(condition), words_of(text))) == 0)}


#: Kinds of product, and words that a step begins with or holds.
PRODUCT_WORDS = {"liquid": ("liquid", "flavour", "액상"), "device": ("device", "battery", "기기"), "packaging": ("packaging", "pack", "포장"), "labeling": ("label", "labeling", "라벨")}
ACTIONS = ("reduce", "replace", "add", "remove", "change", "test", "register", "submit", "train", "bring", "review", "검토", "변경", "제출")


def strategy_fit(summary: Column, product_kinds: Column, history: Column, actions: tuple[str, ...] = ACTIONS, least: float = 0.2) -> dict[str, Column]:
    """S2: it names no kind of product that is not the product's. S3: it says what to do. S5: where the feature has earlier strategies, it is like one of them.

    ``product_kinds``: array<string> of ``PRODUCT_WORDS``. ``history``: array<string> of earlier strategies, null or empty where there are none.
    """
    said = words_of(summary)
    foreign = F.lit(False)
    for kind, names in PRODUCT_WORDS.items():
        foreign = foreign | (F.arrays_overlap(said, F.array(*map(F.lit, names))) & ~F.array_contains(product_kinds, kind))

    def alike(earlier: Column) -> Column:
        other = words_of(earlier)
        return F.coalesce(F.try_divide(F.size(F.array_intersect(said, other)), F.size(F.array_union(said, other))), F.lit(0.0)) >= least

    known = F.coalesce(F.size(history), F.lit(0)) > 0
    return {"S2": ~foreign, "S3": F.arrays_overlap(said, F.array(*map(F.lit, actions))), "S5": ~known | F.coalesce(F.exists(history, alike), F.lit(False))}


def impact_fit(reasoning: Column, sources: Column, difficulty: Column, urgency: Column, cost: Column, least_words: int = 5) -> dict[str, Column]:
    """I1: the reasoning has some length and a word of each of its sources (regulation, strategy, mapping). I3: a hard strategy has no low urgency or cost, a simple one no extreme ones.

    ``sources``: array<string>. ``difficulty``: High, Medium or Low; ``urgency`` and ``cost`` lie in 1 to 5.
    """
    said = words_of(reasoning)
    based = F.forall(sources, lambda s: F.arrays_overlap(said, words_of(s)))
    hard, simple = F.lower(difficulty) == "high", F.lower(difficulty) == "low"
    coherent = ~(hard & (F.least(urgency, cost) <= 1)) & ~(simple & (F.greatest(urgency, cost) >= 5))
    return {"I1": (F.size(said) >= least_words) & F.coalesce(based, F.lit(False)), "I3": F.coalesce(coherent, F.lit(True))}


def user_name(name: Column, least: int = 3) -> Column:
    return F.length(F.coalesce(name, F.lit(""))) >= least


def api_score(score: Column) -> Column:
    """A score of an API row: within 0 and 1, rounded to three places; null if it is not."""
    return F.when(score.between(0, 1), F.round(score, 3))


def api_rules(code: Column, name: Column, url: Column, longest_name: int = 100, longest_url: int = 255) -> dict[str, Column]:
    return {
        "code": F.length(code) == 2,
        "name": F.length(name).between(1, longest_name),
        "url": F.length(F.coalesce(url, F.lit(""))) <= longest_url,
    }


def next_stage(valid: Column, restart: Column, retries: Column) -> Column:
    """Where a validated run goes: on after two retries, on where nothing is to be restarted, else back to that stage."""
    known = {"change_detection": "detect_changes", "map_products": "map_products", "generate_strategy": "generate_strategy", "score_impact": "score_impact"}
    back = F.lit("ok")
    for name, stage in known.items():
        back = F.when(restart == name, stage).otherwise(back)
    return F.when((F.coalesce(retries, F.lit(0)) >= 2) | F.coalesce(valid, F.lit(True)) | restart.isNull(), "ok").otherwise(back)
