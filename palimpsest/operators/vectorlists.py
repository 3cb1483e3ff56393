"""Inverted lists of vectors: cosine top k from the lists near a query, exact or at a recall that is measured.

Centroids are fitted (spherical k-means) on a bounded sample, the ``SAMPLE``
points of least hash; every point is then put into the list of its nearest
centroid, and in it into a ring by its angle to the centroid. Two angles to one
centroid differ by no more than the angle between query and point, so a search
that has found k points within an angle need only look at rings within that
angle of the query's own.

An exact search probes the nearest lists, those of ``FIRST`` times k points, whole,
takes the k-th best score so far, and then those rings of all other lists that can
reach it: two rounds, and the result is that of comparing all points. An
approximate one probes as many lists as ``calibrated`` finds to hold a given
recall on a bounded number of queries. Where the k-th best is far away, as among
random vectors of many dimensions, no bound helps, and an exact search compares all.

Lists are put together on shelves of ``CHUNK`` points, a larger list is dealt into
parts, so a third of all points at one place are many keys. A query goes once to
each part of a shelf with lists that it probes, and is compared there list by
list; k rows come back from a part, not one for each point.
A search for which no index is written compares all (``compared``).
Points without a direction (null, empty or all zero) are in no list and are never
found; queries without one find nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from palimpsest.functions import scores
from palimpsest.sources.store import work_folder

#: Points that centroids are fitted on, most lists, points of a shelf's part, and queries that a recall is measured on.
SAMPLE, LISTS, CHUNK, CALIBRATION = 10_000, 1024, 16_384, 200
#: An exact search probes lists of so many times k points first.
FIRST = 8
#: Rings of one radian.
RINGS = 64
#: Scores are rounded to six places; bounds allow for that.
ROUNDING = 2e-6


def directions(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of those rows that have a direction, and which rows these are."""
    width = int(np.bincount(column.value_lengths().fill_null(0).to_numpy()).argmax()) if len(column) else 0
    good = (column.value_lengths().fill_null(0).to_numpy() == width) & (width > 0)
    at = np.flatnonzero(good)
    rows = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), width)
    size = np.sqrt((rows * rows).sum(axis=1))
    some = np.isfinite(size) & (size > 0)
    return rows[some] / size[some][:, None], at[some]


def fit(vectors: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors."""
    draw = np.random.default_rng(seed)
    centroids = vectors[draw.permutation(len(vectors))[:lists]]
    for _ in range(rounds):
        own = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        size = np.sqrt((sums * sums).sum(axis=1))
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-12)[:, None], centroids)
    return centroids


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, at = directions(batch.column("embedding"))
            if len(at):
                near = unit @ centroids.T
                own = np.argmax(near, axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(at)), own], -1, 1))
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(own.astype(np.int32)), pa.array(angle)], [*rows.schema.names, "list", "angle"])

    return run


def _order(centroids: np.ndarray):
    """For each query every list, its place by nearness, and its angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, at = directions(batch.column("embedding"))
            for lo in range(0, len(at), 256):
                angle = np.arccos(np.clip(unit[lo : lo + 256] @ centroids.T, -1, 1))
                order = np.argsort(angle, axis=1, kind="stable")
                n, m = order.shape
                rows = batch.take(pa.array(np.repeat(at[lo : lo + 256], m)))
                yield pa.RecordBatch.from_arrays([rows.column("query_id"), pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(m, dtype=np.int32), n)), pa.array(np.take_along_axis(angle, order, axis=1).ravel())], ["query_id", "list", "place", "angle"])

    return run


class Lists:
    """A written index: ``members`` (the points with list and ring), ``lists`` (centroids) and ``rings`` (sizes)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @classmethod
    def build(cls, points: DataFrame, folder: str | None = None, lists: int | None = None, sample: int = SAMPLE) -> Lists:
        """``points``: point_id, embedding, and any other columns, which a filter may use. About the square root of their number of lists, ``LISTS`` at most."""
        spark = points.sparkSession
        index = cls(spark, folder or work_folder(spark, "lists"))
        some = points.select("embedding").orderBy(F.xxhash64("point_id"), F.xxhash64("embedding")).limit(sample).toArrow()
        unit, _ = directions(some.column("embedding").combine_chunks()) if some.num_rows else (np.zeros((0, 1)), None)
        if lists is None:
            n = some.num_rows if some.num_rows < sample else points.count()
            lists = min(LISTS, max(1, round(math.sqrt(n))))
        centroids = fit(unit, lists) if len(unit) else np.zeros((0, 1))
        fields = StructType([*points.schema.fields, StructField("list", IntegerType()), StructField("angle", DoubleType())])
        assigned = points.mapInArrow(_assign(centroids), fields) if len(unit) else spark.createDataFrame([], fields)
        assigned = assigned.withColumn("norm", F.sqrt(scores.dot(F.col("embedding"), F.col("embedding")))).withColumn("ring", F.floor(F.col("angle") * RINGS).cast("int"))
        assigned.repartitionByRange("list", "ring", F.xxhash64("point_id")).sortWithinPartitions("list", "ring").write.parquet(f"{index.folder}/members")
        index.table("members").groupBy("list", "ring").agg(F.count(F.lit(1)).alias("size")).coalesce(1).write.parquet(f"{index.folder}/rings")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{index.folder}/lists")
        return index

    def probes(self, queries: DataFrame) -> DataFrame:
        """(query_id, list, place, angle, before, low, high) of each query and list, written: points of nearer lists, and the list's rings."""
        centroids = np.array([r["centroid"] for r in self.table("lists").orderBy("list").collect()])  # one row a list
        kinds = StructType([queries.schema["query_id"], *StructType.fromDDL("list int, place int, angle double").fields])
        rows = queries.select("query_id", "embedding").mapInArrow(_order(centroids), kinds) if len(centroids) else self.spark.createDataFrame([], kinds)
        sizes = self.table("rings").groupBy("list").agg(F.sum("size").alias("size"), F.min("ring").alias("low"), F.max("ring").alias("high"))
        nearer = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        where = work_folder(self.spark, "probes")
        rows.join(F.broadcast(sizes), "list").withColumn("before", F.coalesce(F.sum("size").over(nearer), F.lit(0))).drop("size").write.parquet(where)  # one row a list
        return self.spark.read.parquet(where)

    def shelves(self) -> list[tuple[int, int, int]]:
        """List, shelf and parts: lists put together up to ``CHUNK`` points; a larger one is a shelf of several parts."""
        out, shelf, held = [], -1, CHUNK + 1
        for r in self.table("rings").groupBy("list").agg(F.sum("size").alias("size")).orderBy("list").collect():  # one row a list
            if held + r["size"] > CHUNK:
                shelf, held = shelf + 1, 0
            held += r["size"]
            out.append((r["list"], shelf, math.ceil(r["size"] / CHUNK)))
        return out

    def met(self, probes: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """(query_id, point_id, score) of each query with points of the rings ``low`` to ``high`` of its probed lists: the k best of each shelf's part."""
        rows = self.shelves()
        shelves = lambda: F.broadcast(self.spark.createDataFrame(rows, "list int, shelf int, parts int"))
        n = max(1, math.ceil(queries.count() / QUERY_BLOCK))
        members = self.table("members") if where is None else self.table("members").filter(where)
        points = members.select("point_id", "embedding", "list", "ring").join(shelves(), "list").withColumn("part", F.expr("cast(pmod(xxhash64(point_id), parts) as int)")).drop("parts")
        points = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        due = probes.join(shelves(), "list").groupBy("query_id", "shelf").agg(F.max("parts").alias("parts"), F.collect_list(F.struct("list", "low", "high")).alias("due"))
        asked = due.join(queries.select("query_id", "embedding"), "query_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        asked = asked.select("query_id", "embedding", "shelf", "part", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int").alias("block"), *(F.col(f"due.{c}").alias(c) for c in ("list", "low", "high")))
        keys = ["shelf", "part", "block"]
        schema = StructType([queries.schema["query_id"], members.schema["point_id"], StructField("score", DoubleType())])
        return points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_probed(k), schema).withColumn("score", F.round("score", 6))

    def plan(self, queries: DataFrame, k: int, where: Column | None = None) -> dict[str, DataFrame]:
        """``probes`` with ``round`` (1, 2, or null where a list is skipped) and the rings due, and the exact ``found``."""
        probes, first = self.probes(queries), F.col("before") < FIRST * k
        folder = work_folder(self.spark, "near")
        best(self.met(probes.filter(first), queries, k, where), k).write.parquet(folder)
        near = self.spark.read.parquet(folder)
        floor = near.filter(F.col("rank") == k).select("query_id", F.acos(F.greatest(F.lit(-1.0), F.col("score") - ROUNDING)).alias("within"))
        due = probes.join(floor, "query_id", "left")
        ring = lambda angle: F.floor((angle) * RINGS).cast("int")
        low = F.when(first | F.col("within").isNull(), F.col("low")).otherwise(F.greatest("low", ring(F.col("angle") - F.col("within") - ROUNDING)))
        high = F.when(first | F.col("within").isNull(), F.col("high")).otherwise(F.least("high", ring(F.col("angle") + F.col("within") + ROUNDING)))
        due = due.withColumn("low_", low).withColumn("high", high).drop("low").withColumnRenamed("low_", "low")
        due = due.withColumn("round", F.when(first, 1).when(F.col("low") <= F.col("high"), 2))
        more = self.met(due.filter(F.col("round") == 2), queries, k, where)
        return {"probes": due, "found": best(near.select("query_id", "point_id", "score").unionByName(more), k)}

    def search(self, queries: DataFrame, k: int, where: Column | None = None, probed: int | None = None) -> DataFrame:
        """(query_id, point_id, score, rank): exact, or from the ``probed`` nearest lists of each query."""
        if probed is None:
            return self.plan(queries, k, where)["found"]
        return best(self.met(self.probes(queries).filter(F.col("place") < probed), queries, k, where), k)

    def calibrated(self, queries: DataFrame, k: int, recall: float = 0.95) -> int:
        """The least number of lists to probe that holds ``recall`` of the k best, measured on the ``CALIBRATION`` queries of least hash."""
        some = queries.orderBy(F.xxhash64("query_id")).limit(CALIBRATION)
        plan = self.plan(some, k)
        own = plan["found"].join(self.table("members").select("point_id", "list"), "point_id")
        places = own.join(plan["probes"], ["query_id", "list"]).groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy("place").collect()  # one row a list
        total, seen = sum(r["n"] for r in places), 0
        for r in places:
            seen += r["n"]
            if seen >= recall * total:
                return r["place"] + 1
        return 1


#: Queries and points that are compared in one task at a time.
QUERY_BLOCK, POINT_BLOCK = 8192, 32_768
#: Most queries that are sent to all tasks, and points that these are compared with at a time.
FEW, SLICE = 1000, 2048


def _nearest(k: int):
    """The k best points of a block for each query of another; equals by their rounded scores go to the smaller point_id."""

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        p, at = directions(points.column("embedding").combine_chunks())
        q, of = directions(queries.column("embedding").combine_chunks())
        kept = []
        if len(at) and len(of) and p.shape[1] == q.shape[1]:
            ids = points.column("point_id").combine_chunks().take(pa.array(at))
            # places in order of id, so equals need no look at ids
            order = pc.sort_indices(ids).to_numpy()
            p, at = p[order], at[order]
            for lo in range(0, len(of), 128):
                score = q[lo : lo + 128] @ p.T
                least = np.partition(score, len(at) - k, axis=1)[:, len(at) - k] if len(at) > k else np.full(len(score), -2.0)
                row, place = np.nonzero(score >= least[:, None] - ROUNDING)
                found = score[row, place]
                near = np.lexsort((place, -np.round(found, 6), row))
                rank = np.arange(len(near)) - np.searchsorted(row, row[near])
                near = near[rank < k]
                kept.append((of[lo + row[near]], at[place[near]], found[near]))
        row, place, found = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": queries.column("query_id").take(pa.array(row)), "point_id": points.column("point_id").take(pa.array(place)), "score": pa.array(found)})

    return run


def _leading(row: np.ndarray, place: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Where the k best of each row are; equals by their rounded scores go to the smaller place."""
    near = np.lexsort((place, -np.round(score, 6), row))
    rank = np.arange(len(near)) - np.searchsorted(row[near], row[near])
    return near[rank < k]


def _probed(k: int):
    """The k best points of a shelf's part for each query, list by list; equals by their rounded scores go to the smaller point_id."""

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        p, at = directions(points.column("embedding").combine_chunks())
        q, of = directions(queries.column("embedding").combine_chunks())
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        held, n, floor = [none], 0, np.full(queries.num_rows, -2.0)

        def settle() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            row, place, score = (np.concatenate(x) for x in zip(*held, strict=True))
            keep = _leading(row, place, score, k)
            row, place, score = row[keep], place[keep], score[keep]
            # the k-th best of a query that has so many
            full = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
            floor[row[full]] = score[full]
            return row, place, score

        if len(at) and len(of) and p.shape[1] == q.shape[1]:
            # places in order of id, so equals need no look at ids
            ids = points.column("point_id").combine_chunks()
            order = pc.sort_indices(ids.take(pa.array(at))).to_numpy()
            p, at = p[order], at[order]
            own, ring = points.column("list").to_numpy()[at], points.column("ring").to_numpy()[at]
            # the lists due, of all queries one after the other
            lists = queries.column("list").combine_chunks()
            asks = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            due, low, high = (queries.column(c).combine_chunks().flatten().to_numpy() for c in ("list", "low", "high"))
            unit = np.full(len(lists), -1)
            unit[of] = np.arange(len(of))
            for one in np.unique(own):
                mine, which = np.flatnonzero(own == one), np.flatnonzero((due == one) & (unit[asks] >= 0))
                here, rings = p[mine], ring[mine]
                least, most = rings.min(), rings.max()
                step = max(1, (1 << 20) // len(mine))
                for lo in range(0, len(which), step):
                    some = which[lo : lo + step]
                    who = asks[some]
                    score = q[unit[who]] @ here.T
                    if (low[some] > least).any() or (high[some] < most).any():
                        score[(rings < low[some][:, None]) | (rings > high[some][:, None])] = -3.0
                    bound = np.maximum(floor[who], np.partition(score, len(mine) - k, axis=1)[:, len(mine) - k] if len(mine) > k else -2.0)
                    row, place = np.nonzero(score >= np.maximum(bound, -2.0)[:, None] - ROUNDING)
                    held.append((who[row], mine[place], score[row, place]))
                    n += len(row)
                    if n > 1 << 20:
                        held[:] = [settle()]
                        n = len(held[0][0])
        row, place, score = settle()
        return pa.table({"query_id": queries.column("query_id").take(pa.array(row)), "point_id": points.column("point_id").take(pa.array(at[place])), "score": pa.array(score)})

    return run


def _met_by(queries: pa.Table, k: int):
    """The k best points of every ``SLICE`` for each of a few queries; queries of each width by themselves."""
    widths = queries.column("embedding").combine_chunks().value_lengths().fill_null(0)
    sides = [queries.filter(pc.equal(widths, w)) for w in pc.unique(widths) if w.as_py()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                points = pa.Table.from_batches([batch.slice(lo, SLICE)])
                size = points.column("embedding").combine_chunks().value_lengths().fill_null(0)
                for side in sides:
                    width = len(side.column("embedding")[0])
                    yield from _nearest(k)(points.filter(pc.equal(size, width)), side).to_batches()

    return run


def compared(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(query_id, point_id, score, rank): every query with every point, block by block; each pair of blocks is one group, and gives k rows a query.

    One search of many vectors takes less this way than an index of them; work
    grows with queries times points, rows moved with each side times the blocks
    of the other. ``FEW`` queries and less go to the points, which stay where they are.
    """
    queries = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    points = points.select("point_id", F.col("embedding").cast("array<double>").alias("embedding"))
    width = lambda rows: rows.filter("size(embedding) > 0").withColumn("width", F.size("embedding"))
    schema = StructType([queries.schema["query_id"], points.schema["point_id"], StructField("score", DoubleType())])
    some = queries.limit(FEW + 1).toArrow()
    if some.num_rows <= FEW:
        found = points.mapInArrow(_met_by(some, k), schema)
        return best(found.withColumn("score", F.round("score", 6)), k)
    n, m = max(1, math.ceil(queries.count() / QUERY_BLOCK)), max(1, math.ceil(points.count() / POINT_BLOCK))
    block = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = width(points).withColumn("part", block("point_id", m)).withColumn("block", every(n))
    right = width(queries).withColumn("block", block("query_id", n)).withColumn("part", every(m))
    keys = ["width", "part", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest(k), schema)
    return best(found.withColumn("score", F.round("score", 6)), k)


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best points of each query; ties go to the smaller point_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("point_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
