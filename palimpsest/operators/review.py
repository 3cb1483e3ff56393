"""Human review: offline keyword rules in place of a model's intent and target, with its defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def route(messages: DataFrame, body: str, is_question: Column, targets: dict[str, list[str]], default: str = "map_products") -> DataFrame:
    """``intent`` and ``target`` of each message: the first target one of whose words is in it."""
    low = F.lower(F.col(body))
    target = F.lit(default)
    for name, words in reversed(targets.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        target = F.when(hit, name).otherwise(target)
    return messages.withColumn("intent", F.when(is_question, "question").otherwise("modify")).withColumn("target", target)


def answer_context(changes: DataFrame, items: DataFrame, strategies: DataFrame, key: str) -> DataFrame:
    """First three changes, five applying items and three strategies of each document, as lists."""
    firsts = lambda df, c, n, name: df.groupBy(key).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", c))), 1, n), lambda x: x[c]).alias(name))
    return firsts(changes, "section_ref", 3, "changes").join(firsts(items.filter("applies"), "feature", 5, "items"), key, "full").join(firsts(strategies, "strategy", 3, "strategies"), key, "full")
