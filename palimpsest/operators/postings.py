"""An inverted index in order of impact, and exact top k that skips its blocks.

A token's postings stand in order of weight, greatest first, in blocks of
``BLOCK``; a block tells its greatest weight, and so does a segment of
``SEGMENT`` blocks. A score is the sum over shared tokens of query weight times
point weight, both positive.

A search takes three steps, all joins on tokens, segments and points:

1. Points in the first block of each of a query's tokens are scored. The k-th
   best of them, theta, is a floor: no point below it is among the k best.
2. What may stay unread of a query's lists must add up to less than theta, for
   then a point met nowhere is below it. ``SKIP`` of theta goes to whole tokens,
   those of least greatest contribution first; up to ``UNREAD`` of it goes to the
   tails of all others, in proportion to their greatest contributions. So of each token
   only the head of its list matters, weights of ``need`` and more: segments
   and blocks below are not joined.
3. What was read adds up to a bound for each point met: known contributions, and
   for every token not met the greatest contribution that was left unread. Points whose
   bound reaches theta are scored in full from the postings, and ranked.

Nothing is lost: results equal those of scoring every point. Segments have
bounded size, so a token that every point holds is many keys of the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from palimpsest.operators.frames import top_per
from palimpsest.sources.store import work_folder

BLOCK, SEGMENT = 128, 64
#: Points of each query that are scored for theta, as a multiple of k.
SEEDS = 4
#: Parts of theta that tokens read nowhere, and all that is unread, may add up to.
SKIP, UNREAD = 0.3, 0.6
#: What rounding of sums may take from a bound.
SLACK = 1e-9


def _in_blocks(size: int, segment: int):
    """Blocks of rows that come in order of (token, weight descending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, held = TaskContext.get().partitionId(), 0, None

        def close(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            nonlocal block
            first, offsets = pa.array(starts[:-1]), pa.array(starts.astype(np.int32))
            number = np.arange(block, block + len(first))
            block += len(first)
            lists = [pa.ListArray.from_arrays(offsets, rows.column(c)) for c in ("point_id", "weight")]
            columns = [rows.column("token").take(first), pa.array((part << 32) + number // segment), pa.array(number.astype(np.int32)), rows.column("weight").take(first), pa.array(np.diff(starts).astype(np.int32)), *lists]
            return pa.RecordBatch.from_arrays(columns, ["token", "segment", "block", "most", "size", "points", "weights"])

        for batch in batches:
            if len(batch):
                rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                token = rows.column("token")
                change = np.append(True, pc.not_equal(token[1:], token[:-1]).to_numpy(zero_copy_only=False))
                at = np.arange(len(rows))
                starts = np.flatnonzero((at - np.maximum.accumulate(np.where(change, at, 0))) % size == 0)
                # the last block may go on
                if len(starts) > 1:
                    yield close(rows.slice(0, int(starts[-1])), starts)
                held = rows.slice(int(starts[-1]))
        if held is not None:
            yield close(held, np.array([0, len(held)]))

    return run


class Index:
    """A written index: ``postings`` (token, point_id, weight), ``blocks``, and ``terms`` with the segments of each token."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @classmethod
    def build(cls, points: DataFrame, folder: str | None = None, block: int = BLOCK, segment: int = SEGMENT) -> Index:
        """``points``: token, point_id, n (a positive weight), one row for each token of a point."""
        spark = points.sparkSession
        index = cls(spark, folder or work_folder(spark, "postings"))
        points.select("token", "point_id", F.col("n").cast("double").alias("weight")).filter("token is not null and point_id is not null and weight > 0").write.parquet(f"{index.folder}/postings")
        held = index.table("postings")
        ids = held.schema["point_id"].dataType
        fields = [("token", StringType()), ("segment", LongType()), ("block", IntegerType()), ("most", DoubleType()), ("size", IntegerType()), ("points", ArrayType(ids)), ("weights", ArrayType(DoubleType()))]
        order = [F.col("token"), F.col("weight").desc(), F.col("point_id")]
        held.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_in_blocks(block, segment), StructType([StructField(*f) for f in fields])).write.parquet(f"{index.folder}/blocks")
        segments = index.table("blocks").groupBy("token", "segment").agg(F.max("most").alias("most"), F.count(F.lit(1)).alias("blocks"), F.min("block").alias("block"))
        terms = segments.groupBy("token").agg(F.max("most").alias("most"), F.sum("blocks").alias("blocks"), F.min(F.struct("segment", "block")).alias("first"), F.collect_list(F.struct("segment", "most")).alias("segments"))
        terms.write.parquet(f"{index.folder}/terms")
        return index

    def scored(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """(query_id, point_id, score) of pairs, from all shared tokens."""
        due = pairs.select("query_id", "point_id").join(queries, "query_id")
        return due.join(self.table("postings"), ["token", "point_id"]).groupBy("query_id", "point_id").agg(F.sum(F.col("query_n") * F.col("weight")).alias("score"))

    def plan(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> dict[str, DataFrame]:
        """The frames of a search: ``tokens`` of queries with their needs, ``read`` postings, ``met`` points with bounds, and the ``found``.

        ``queries``: query_id, token, query_n, one row for each token of a query.
        ``allowed``: point_id of the points that a filter lets through.
        """
        queries = queries.select("query_id", "token", F.col("query_n").cast("double").alias("query_n")).filter("query_n > 0")
        within = lambda df: df if allowed is None else df.join(allowed.select("point_id"), "point_id", "left_semi")
        asked = queries.join(self.table("terms"), "token").withColumn("top", F.col("query_n") * F.col("most"))
        where = work_folder(self.spark, "asked")
        asked.write.parquet(where)
        asked = self.spark.read.parquet(where)
        blocks = self.table("blocks")
        posting = F.explode(F.arrays_zip(F.col("points").alias("point_id"), F.col("weights").alias("weight"))).alias("p")

        heads = asked.select("query_id", "token", "query_n", F.col("first.segment").alias("segment"), F.col("first.block").alias("block"))
        seeds = heads.join(blocks, ["token", "segment", "block"]).select("query_id", "query_n", posting).select("query_id", "p.point_id", (F.col("query_n") * F.col("p.weight")).alias("s"))
        seeds = top_per(within(seeds.groupBy("query_id", "point_id").agg(F.sum("s").alias("s"))), ["query_id"], [F.desc("s"), F.asc("point_id")], SEEDS * k)
        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"))
        theta = self.scored(seeds, queries).withColumn("n", F.row_number().over(ranked)).filter(F.col("n") == k).select("query_id", (F.col("score") * (1 - SLACK)).alias("theta"))
        where = work_folder(self.spark, "theta")
        theta.write.parquet(where)
        theta = self.spark.read.parquet(where)

        order = Window.partitionBy("query_id").orderBy("top", "token").rowsBetween(Window.unboundedPreceding, 0)
        of_query = Window.partitionBy("query_id")
        tokens = asked.join(theta, "query_id", "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)))
        tokens = tokens.withColumn("skipped", F.sum("top").over(order) <= F.col("theta") * SKIP)
        total = lambda which: F.coalesce(F.sum(F.when(which, F.col("top"))).over(of_query), F.lit(0.0))
        part = (F.col("theta") * UNREAD - total(F.col("skipped"))) / total(~F.col("skipped"))
        # the greatest contribution of what is not read
        tokens = tokens.withColumn("rest", F.when(F.col("skipped"), F.col("top")).otherwise(F.least(F.lit(1.0), part) * F.col("top")))
        tokens = tokens.withColumn("need", F.when(~F.col("skipped"), F.col("rest") / F.col("query_n") * (1 - SLACK)))
        due = tokens.select("query_id", "token", "query_n", "need", "rest", F.explode(F.filter("segments", lambda s: s["most"] >= F.col("need"))).alias("s")).select("query_id", "token", "query_n", "need", "rest", "s.segment")
        read = due.join(blocks.withColumnRenamed("most", "greatest"), ["token", "segment"]).filter("greatest >= need")
        met = read.select("query_id", "query_n", "need", "rest", posting).filter("p.weight >= need")
        met = within(met.select("query_id", "p.point_id", (F.col("query_n") * F.col("p.weight") - F.col("rest")).alias("gain")))
        unmet = tokens.groupBy("query_id").agg(F.sum("rest").alias("unmet"), F.max("theta").alias("theta"))
        met = met.groupBy("query_id", "point_id").agg(F.sum("gain").alias("gain")).join(unmet, "query_id").withColumn("survives", F.col("gain") + F.col("unmet") * (1 + SLACK) >= F.col("theta"))
        best = self.scored(met.filter("survives"), queries)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("point_id"))
        found = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return {"tokens": tokens, "read": read, "met": met, "found": found}

    def search(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, point_id, score, rank): the k best points of each query; ties go to the smaller point_id."""
        return self.plan(queries, k, allowed)["found"].select("query_id", "point_id", "score", "rank")

    def effort(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """What a search of each query takes: blocks of its tokens, blocks read and skipped, points met and points scored in full."""
        plan = self.plan(queries, k, allowed)
        held = plan["tokens"].groupBy("query_id").agg(F.count(F.lit(1)).alias("tokens"), F.sum("blocks").alias("blocks"), F.sum(F.col("skipped").cast("long")).alias("tokens_skipped"))
        read = plan["read"].groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks_read"))
        met = plan["met"].groupBy("query_id").agg(F.count(F.lit(1)).alias("points_met"), F.sum(F.col("survives").cast("long")).alias("points_scored"))
        zero = {c: 0 for c in ("blocks_read", "points_met", "points_scored")}
        return held.join(read, "query_id", "left").join(met, "query_id", "left").fillna(zero).withColumn("blocks_skipped", F.col("blocks") - F.col("blocks_read"))
