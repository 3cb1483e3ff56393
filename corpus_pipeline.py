"""The corpus pipeline: five stages, each one operator of ``palimpsest.llm``.

A stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept. All but the last return the columns of ``documents``, and any others that
the input has; each stage's result is written as Parquet and read again before
the next, so no stage holds the lineage of another and a lost executor repeats
one stage at most. What is not read any more is removed.

Null texts count as empty. Every stage takes rows without a doc_id, repeated
rows, empty tables and columns of any name; what it makes of them is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, mixing, neardup, tokens, toxicity
from palimpsest.llm.runtime import Tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go.

    Each row is scored by its own text: repeated rows share a fate, empty texts
    get the score of a text without windows, and without labelled rows of both
    classes none goes.
    """
    model = toxicity.train(toxicity.labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least doc_id stays, once.

    Of rows of one doc_id the first in order of text stays (null first). A text
    without words is like no other and stays, and so does every row without a
    doc_id, which has no class.
    """
    classes = neardup.near_duplicates(docs)
    gone = classes.filter("class_id <> doc_id").select(F.col("doc_id").alias("id"))
    again = classes.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("id"))
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    # by shuffle at every size: what goes grows with the corpus
    left = row.join(gone.hint("merge"), "id", "left_anti")
    if again.isEmpty():
        return left.select("row.*")
    first = Window.partitionBy("id").orderBy(F.col("row.text").asc_nulls_first())
    repeated = left.join(again, "id", "left_semi").withColumn("n", F.row_number().over(first)).filter("n = 1")
    return left.join(again, "id", "left_anti").select("row.*").unionByName(repeated.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each judged by its own text; null and empty texts hold none."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the raked source, language and register shares.

    Null source and language are values of their own; rows of one doc_id, and
    all rows without one, share a random number.
    """
    return mixing.sample_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in shards; the result is the index read from them, rows without a doc_id first."""
    return tokens.token_output(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_token_ids),
]

#: Compression distance, sketches and tokenisers are outside SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    tables = Tables(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = tables.put(name, stage(spark, docs, sf_dir))
        if before:
            tables.drop(before)
        before = name
    return docs
