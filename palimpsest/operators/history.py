"""Strategies of earlier runs: what is kept of a run, how it is found again, and what is reused of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import scores
from palimpsest.operators import retrieval

NO_PRODUCTS = "(no mapped products)"


def run_text(summary: Column, products: Column) -> Column:
    """The text that stands for a regulation and its products, of a stored run and of a query alike."""
    named = F.filter(products, lambda p: p.isNotNull())
    shown = F.when(F.size(named) > 0, F.array_join(named, ", ")).otherwise(F.lit(NO_PRODUCTS))
    return F.concat(F.lit("Regulation: "), F.trim(summary), F.lit("\nProducts: "), shown)


def history_rows(runs: DataFrame) -> DataFrame:
    """(run_id, text, products, n_products, strategies) of runs that have a strategy.

    ``runs``: run_id, summary, products array<string>, strategies array<string>.
    """
    kept = runs.filter(F.size(F.coalesce("strategies", F.array().cast("array<string>"))) > 0)
    products = F.filter("products", lambda p: p.isNotNull())
    return kept.select("run_id", run_text(F.col("summary"), F.col("products")).alias("text"), products.alias("products"), F.size(products).alias("n_products"), "strategies")


def search_history(queries: DataFrame, history: DataFrame, limit: int = 10, alpha: float = 0.7) -> DataFrame:
    """(query_id, point_id, score): stored runs like each query's ``text``, dense and sparse ranks fused."""
    vectors = queries.select("query_id", scores.pseudo_embedding(F.col("text")).alias("embedding"))
    points = history.select(F.col("run_id").alias("point_id"), scores.pseudo_embedding(F.col("text")).alias("embedding"))
    words = retrieval.tokens(queries, "query_id", "text").withColumnRenamed("n", "query_n")
    stored = retrieval.occurrences(history.withColumnRenamed("run_id", "point_id"), "point_id", "text")
    return retrieval.hybrid_search(vectors, words, points, stored, limit, alpha).select("query_id", "point_id", "score")


def reused_strategies(found: DataFrame, history: DataFrame) -> DataFrame:
    """(query_id, strategies): distinct strategies of the runs found, the best run's first."""
    rows = found.join(history.select(F.col("run_id").alias("point_id"), F.posexplode("strategies").alias("at", "strategy")), "point_id")
    rows = rows.withColumn("strategy", F.trim("strategy")).filter("strategy <> ''")
    best = rows.groupBy("query_id", "strategy").agg(F.min(F.struct((-F.col("score")).alias("s"), "point_id", "at")).alias("place"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "strategy"))), lambda x: x["strategy"])
    return best.groupBy("query_id").agg(ordered.alias("strategies"))
