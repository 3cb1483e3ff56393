"""Entity graphs of documents: nodes, edges, density."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.frames import first_wins


def nodes(entities: DataFrame, document: str) -> DataFrame:
    """Entities once for each (lower name, type), the first kept."""
    return first_wins(entities.withColumn("_name", F.lower("name")), [document, "_name", "type"], "pos").drop("_name")


def typed_edges(entities: DataFrame, document: str, source: str, target: str, relation: str) -> DataFrame:
    """Every entity of one type with every one of the other within a document."""
    a = entities.filter(F.col("type") == source).select(document, F.col("name").alias("source"))
    b = entities.filter(F.col("type") == target).select(document, F.col("name").alias("target"))
    return a.join(b, document).select(document, "source", "target", F.lit(relation).alias("relation"))


def context_edges(entities: DataFrame, document: str) -> DataFrame:
    """Consecutive entities of one context are related."""
    context = F.coalesce(F.nullif("context", F.lit("")), F.lit("unknown"))
    w = Window.partitionBy(document, context).orderBy("pos")
    return entities.withColumn("target", F.lead("name").over(w)).filter("target is not null").select(document, F.col("name").alias("source"), "target", F.lit("related_to").alias("relation"))


def edges(entities: DataFrame, document: str) -> DataFrame:
    return typed_edges(entities, document, "Organization", "Regulation", "enforces").unionByName(typed_edges(entities, document, "Regulation", "Chemical", "regulates")).unionByName(context_edges(entities, document))


def summary(entities: DataFrame, links: DataFrame, document: str) -> DataFrame:
    """Nodes by name, directed edges without parallels, and m / (n (n - 1)), 0 for one node."""
    n = entities.groupBy(document).agg(F.countDistinct("name").alias("n_nodes"))
    m = links.groupBy(document).agg(F.countDistinct("source", "target").alias("n_edges"))
    both = n.join(m, document, "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return both.withColumn("density", F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(F.lit(0.0)))
