"""Inverted index and inverted lists against scoring every point."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import catalog
from palimpsest.operators import postings, retrieval, vectorlists
from palimpsest.operators.postings import Index
from palimpsest.operators.vectorlists import Lists

BIG = "/root/testdata/sf0.1"


def skewed(seed, points, tokens, ties):
    """Bags of tokens with one that every point holds and a few very long points."""
    r = random.Random(seed)
    bags = {}
    for p in range(points):
        n = 400 if p % 97 == 5 else r.randint(1, 30)
        bags[p] = Counter(f"t{int(r.paretovariate(0.6)) % tokens}" for _ in range(n))
        bags[p]["all"] = r.randint(1, 3) if ties else 1 + p % 50
    return bags


def best_of(bags, asked, k, keep=lambda p: True):
    out = set()
    for q, words in asked.items():
        found = sorted((-sum(n * bag[t] for t, n in words.items() if t in bag), p) for p, bag in bags.items() if keep(p) and words.keys() & bag.keys())
        out |= {(q, p, float(-s), i + 1) for i, (s, p) in enumerate(found[:k])}
    return out


def rows(bags, spark, ident, n):
    return spark.createDataFrame([(i, t, c) for i, bag in bags.items() for t, c in bag.items()], f"{ident} long, token string, {n} long")


@pytest.mark.parametrize("ties", [False, True])
def test_index_equals_scoring_every_point(spark, ties):
    bags, asked = skewed(1, 900, 120, ties), skewed(2, 25, 120, ties)
    asked[99] = Counter({"nowhere": 3})
    index = Index.build(rows(bags, spark, "point_id", "n"), block=8, segment=3)
    queries = rows(asked, spark, "query_id", "query_n")
    for k in (1, 10, 2000):
        assert {tuple(r) for r in index.search(queries, k).collect()} == best_of(bags, asked, k)
    allowed = spark.range(0, 900, 7).withColumnRenamed("id", "point_id")
    assert {tuple(r) for r in index.search(queries, 5, allowed).collect()} == best_of(bags, asked, 5, lambda p: p % 7 == 0)


def test_blocks_are_in_order_and_bounded(spark):
    bags = skewed(3, 600, 50, False)
    index = Index.build(rows(bags, spark, "point_id", "n"), block=8, segment=3)
    held = defaultdict(list)
    for b in index.table("blocks").orderBy("token", "segment", "block").collect():
        assert b["most"] == max(b["weights"]) and b["size"] == len(b["points"]) <= 8
        held[b["token"]] += list(zip((-w for w in b["weights"]), b["points"], strict=True))
    assert all(x == sorted(x) for x in held.values())
    assert {(t, p, -w) for t, x in held.items() for w, p in x} == {(t, p, float(n)) for p, bag in bags.items() for t, n in bag.items()}
    sizes = index.table("blocks").groupBy("token", "segment").count().agg(F.max("count")).first()[0]
    assert sizes <= 3 and index.table("blocks").filter("token = 'all'").select("segment").distinct().count() > 20


def test_blocks_are_skipped(spark):
    bags, asked = skewed(4, 1500, 200, False), skewed(5, 12, 200, False)
    index = Index.build(rows(bags, spark, "point_id", "n"), block=8, segment=3)
    effort = index.effort(rows(asked, spark, "query_id", "query_n"), 5).collect()
    total, read = sum(r["blocks"] for r in effort), sum(r["blocks_read"] for r in effort)
    assert len(effort) == 12 and read + sum(r["blocks_skipped"] for r in effort) == total and read < total / 2
    assert all(5 <= r["points_scored"] <= r["points_met"] for r in effort)


def test_weights_that_are_no_integers(spark):
    r = random.Random(7)
    bags = {p: {f"t{r.randrange(30)}": r.random() for _ in range(6)} for p in range(300)}
    asked = {q: {f"t{i}": r.random() for i in range(q, q + 9)} for q in range(8)}
    frame = lambda x, ident, n: spark.createDataFrame([(i, t, c) for i, bag in x.items() for t, c in bag.items()], f"{ident} long, token string, {n} double")
    found = Index.build(frame(bags, "point_id", "n"), block=4, segment=2).search(frame(asked, "query_id", "query_n"), 7).collect()
    want = {(q, i): (p, s) for q, p, s, i in best_of(bags, asked, 7)}
    assert {(r["query_id"], r["rank"]): r["point_id"] for r in found} == {k: p for k, (p, _) in want.items()}
    assert all(r["score"] == pytest.approx(want[r["query_id"], r["rank"]][1]) for r in found)


def test_nothing_to_find(spark):
    points, queries = spark.createDataFrame([], "point_id long, token string, n long"), spark.createDataFrame([(1, "a", 2)], "query_id long, token string, query_n long")
    assert Index.build(points).search(queries, 3).collect() == []
    some = spark.createDataFrame([(1, None, 2), (None, "a", 1), (2, "a", 0), (3, "a", 5)], points.schema)
    assert [tuple(r) for r in Index.build(some).search(queries, 3).collect()] == [(1, 3, 10.0, 1)]


def clusters(n, dims, seed):
    g = np.random.default_rng(seed)
    middle = g.normal(size=(9, dims))
    own = np.where(np.arange(n) % 3 == 0, 0, g.integers(0, 9, n))
    return middle[own] + 0.3 * g.normal(size=(n, dims))


def plain_nearest(vectors, asked, k, keep=lambda p: True):
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    out = {}
    for q in asked:
        s = np.round(unit @ unit[q], 6)
        out[q] = [p for _, p in sorted((-s[p], p) for p in range(len(vectors)) if keep(p))[:k]]
    return out


def found_of(frame):
    by = defaultdict(list)
    for r in frame.orderBy("query_id", "rank").collect():
        by[r["query_id"]].append(r["point_id"])
    return dict(by)


def points_of(spark, vectors):
    return spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(vectors)], "point_id long, embedding array<double>, label int")


def test_exact_search_equals_comparing_all(spark, monkeypatch):
    """A list with a third of all points in several chunks, filters, and few points."""
    monkeypatch.setattr(vectorlists, "CHUNK", 5)
    vectors = clusters(900, 16, 1)
    points = points_of(spark, vectors)
    queries = points.filter("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "embedding")
    index = Lists.build(points, lists=30, sample=300)
    assert index.table("rings").agg(F.sum("size")).first()[0] == 900 and index.table("rings").agg(F.max("size")).first()[0] > 5
    asked = range(0, 900, 20)
    assert found_of(index.search(queries, 10)) == plain_nearest(vectors, asked, 10)
    assert found_of(index.search(queries, 5, F.col("label") == 1)) == plain_nearest(vectors, asked, 5, lambda p: p % 4 == 1)
    assert found_of(index.search(queries, 400, F.col("label") == 1)) == plain_nearest(vectors, asked, 400, lambda p: p % 4 == 1)
    due = index.plan(queries, 10)["probes"]
    compared = due.filter("round is not null").select("list", F.explode(F.sequence("low", "high")).alias("ring")).join(index.table("rings"), ["list", "ring"]).agg(F.sum("size")).first()[0]
    assert due.filter("round is null").count() > 0 and compared < 0.8 * 900 * len(asked)


def test_k_rows_come_back_from_a_shelf(spark, monkeypatch):
    monkeypatch.setattr(vectorlists, "CHUNK", 100)
    points = points_of(spark, clusters(600, 8, 2))
    queries = points.filter("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "embedding")
    index = Lists.build(points, lists=12)
    met = index.met(index.probes(queries), queries, 3).groupBy("query_id").count().collect()
    assert len(met) == 30 and all(3 <= r["count"] <= 3 * 24 for r in met)


def test_points_without_a_direction(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [0.6, 0.8]), (6, [3.0, 0.0])]
    points = spark.createDataFrame(rows, "point_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, embedding array<double>")
    assert [tuple(r) for r in Lists.build(points).search(queries, 3).orderBy("rank").collect()] == [(1, 1, 1.0, 1), (1, 6, 1.0, 2), (1, 5, 0.6, 3)]
    assert Lists.build(points.filter("point_id > 99")).search(queries, 3).collect() == []


def test_recall_of_probed_lists(spark):
    """Every twentieth vector of the table as a query, against comparing all."""
    import pandas as pd

    e = pd.read_parquet(f"{BIG}/embeddings.parquet")
    vectors, ids = np.array(e.embedding.tolist(), float), e.vec_id.tolist()
    place = {v: i for i, v in enumerate(ids)}
    want = plain_nearest(vectors, [place[v] for v in ids if v % 20 == 0], 10)
    found = found_of(catalog.queries()["dense_lists_topk"](spark, BIG))
    hits = [len({place[p] for p in found[q]} & set(want[place[q]])) for q in found]
    assert len(found) == len(want) == 100 and sum(hits) >= 0.9 * 10 * len(want)


def test_written_indexes_serve_hybrid_searches(spark):
    vectors, bags = clusters(300, 8, 3), skewed(6, 300, 60, False)
    points = points_of(spark, vectors)
    tokens = rows(bags, spark, "point_id", "n")
    asked = points.filter("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "embedding")
    words = rows({q: bags[q] for q in range(0, 300, 20)}, spark, "query_id", "query_n")
    lists, index = Lists.build(points, lists=12), Index.build(tokens, block=8, segment=3)
    for where in (None, F.col("label") < 2):
        once = {tuple(r) for r in retrieval.hybrid_search(asked, words, points, tokens, 5, filters=where).select("query_id", "point_id", "score").collect()}
        assert once == {tuple(r) for r in retrieval.hybrid_search(asked, words, lists, index, 5, filters=where).select("query_id", "point_id", "score").collect()} and len(once) == 75


def test_effort_of_the_registered_searches(spark):
    data = "/root/testdata/sf0.01"
    effort = catalog.queries()["sparse_effort"](spark, data).collect()
    assert {r["query_id"] for r in effort} == {0, 20} and all(r["blocks"] == r["blocks_read"] + r["blocks_skipped"] and r["blocks_skipped"] > 0 for r in effort)
    probes = catalog.queries()["dense_probes"](spark, data).collect()
    assert len(probes) == 25 and len({r["first"] + r["after"] + r["skipped"] for r in probes}) == 1
    assert all(10 <= r["compared"] <= r["points"] == 500 for r in probes)
    assert postings.SKIP < postings.UNREAD < 1
