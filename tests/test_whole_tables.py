"""Queries over whole tables against plain versions."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from palimpsest import catalog

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def read():
    import pandas as pd

    return lambda name: pd.read_parquet(f"{DATA}/{name}.parquet")


def rows(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in catalog.queries()[name](spark, DATA).collect())


def first(scored, k):
    """(query, point) -> score and rank of the k best."""
    by, out = defaultdict(list), {}
    for (q, p), s in scored.items():
        by[q].append((-s, p))
    for q, found in by.items():
        out |= {(q, p): (-s, i + 1) for i, (s, p) in enumerate(sorted(found)[:k])}
    return out


def plain_dense(e, keep=lambda label: True):
    v = np.array(e.embedding.tolist(), float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids, at = e.vec_id.tolist(), [j for j, x in enumerate(e.label) if keep(x)]
    return {(ids[i], ids[j]): round(float(v[i] @ v[j]), 6) for i in range(len(ids)) if ids[i] % 20 == 0 for j in at}


def plain_sparse(docs, items):
    bags = {d: Counter(t.lower().split()) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    asked = {i: Counter(t.lower().split()) for i, t in zip(items.item_id, items.text, strict=True) if i % 20 == 0}
    scored = {(i, d): float(sum(n * bag[w] for w, n in q.items() if w in bag)) for i, q in asked.items() for d, bag in bags.items()}
    return {k: s for k, s in scored.items() if s}


def close(found, want):
    """Same best scores for each query in order; points may change places where scores are equal after rounding."""
    by = lambda x: {q: sorted((s for (r, _), (s, *_) in x.items() if r == q), reverse=True) for q in {k[0] for k in x}}
    got, due = by(found), by(want)
    return got.keys() == due.keys() and all(got[q] == pytest.approx(due[q], abs=2e-6) for q in due)


def test_dense_search_of_all_queries(spark, read):
    e = read("embeddings")
    for name, k, keep in (("dense_topk", 10, lambda x: True), ("filtered_nearest", 5, lambda x: x == 1)):
        found = {(q, p): (s,) for q, p, s in rows(spark, name, "query_id", "point_id", "score")}
        scored = plain_dense(e, keep)
        assert close(found, first(scored, k)) and len({q for q, _ in found}) == (e.vec_id % 20 == 0).sum()
        assert all(abs(scored[p] - s) < 2e-6 for p, (s,) in found.items())


def test_sparse_search_of_all_documents(spark, read):
    docs, items = read("documents"), read("benchmark")
    found = {(q, p): (s, r) for q, p, s, r in rows(spark, "sparse_topk", "query_id", "point_id", "score", "rank")}
    assert found == first(plain_sparse(docs, items), 10)
    assert max(p for _, p in found) >= 500


def test_hybrid_search_of_all(spark, read):
    dense, sparse = first(plain_dense(read("embeddings")), 20), first(plain_sparse(read("documents"), read("benchmark")), 20)
    fused = {k: (0.7 / (dense[k][1] + 60) if k in dense else 0) + (0.3 / (sparse[k][1] + 60) if k in sparse else 0) for k in dense.keys() | sparse.keys()}
    found = {(q, p): (s,) for q, p, s in rows(spark, "hybrid_rrf", "query_id", "point_id", "score")}
    assert close(found, first(fused, 10))


def plain_matches(docs, least):
    """(source, new, old, score) of all documents, and the greedy choice among them."""
    pairs, chosen = [], []
    for source, group in docs.sort_values("doc_id").groupby("source"):
        bags = [(d, set(re.split(r"\s+", t.lower()))) for d, t in zip(group.doc_id, group.text, strict=True)]
        taken = set()
        for new, a in bags[::2]:
            found = sorted((-len(a & b) / len(a | b), old) for old, b in bags[1::2] if len(a & b) / len(a | b) >= least)
            pairs += [(source, new, old, round(-s, 6)) for s, old in found]
            free = [(s, old) for s, old in found if old not in taken]
            if free:
                taken.add(free[0][1])
                chosen.append((source, new, free[0][1]))
    return sorted(pairs), sorted(chosen)


def test_documents_of_any_length_are_matched(spark, read):
    docs = read("documents")
    assert rows(spark, "jaccard_candidates", "source", "new_id", "old_id", "score") == plain_matches(docs, 0.3)[0]
    found = rows(spark, "jaccard_greedy_match", "source", "new_id", "old_id")
    assert found == plain_matches(docs, 0.1)[1]
    long_ = set(docs.doc_id[docs.n_chars >= 1500])
    assert any(new in long_ and old in long_ for _, new, old in found)


def test_every_document_is_held_against_the_one_before(spark, read):
    from palimpsest.plans import runs

    want = set()
    for source, group in read("documents").sort_values("doc_id").groupby("source"):
        ids, texts = group.doc_id.tolist(), group.text.tolist()
        for i in range(len(ids)):
            for side, k in (("new", i), ("old", i - 1)):
                if k >= 0:
                    want |= {(f"{source}/{i + 1}", side, ids[k] * runs.LINES + n, line) for n, line in enumerate(texts[k].split("\n"))}
    found = [tuple(r) for r in runs._pairs(spark, DATA).select("pair_id", "side", "block_id", "body").collect()]
    assert len(found) == len(want) and set(found) == want
    pairs = {r[0] for r in rows(spark, "change_detection_run", "pair_id")}
    assert pairs <= {w[0] for w in want} and len(pairs) > 0.9 * len({w[0] for w in want})


def test_all_parts_are_mapped(spark, read):
    found = rows(spark, "product_mapping_run", "product_id", "feature", "point_id")
    some = {(f, p) for i, f, p in found if i == 1}
    assert len(found) == len(set(found)) and some
    assert set(found) == {(i, f, p) for i in read("part").p_partkey for f, p in some}


def test_all_customers_and_orders(spark, read):
    orders, by = read("orders"), defaultdict(list)
    for c, o, d in zip(orders.o_custkey, orders.o_orderkey, orders.o_orderdate, strict=True):
        by[c].append((d, o))
    ids = sorted(read("customer").c_custkey)
    found = {(c, o, n) for c, o, n in rows_any(spark, "eager_children", "c_custkey", "o_orderkey", "n")}
    assert found == {(c, o, max(1, len(by[c]))) for c in ids for o in ([o for _, o in by[c]] or [None])}
    want = set()
    for made in by.values():
        for d, o in made:
            earlier = [x for x in made if (x[0].month, x[0].day) < (d.month, d.day)]
            want |= {(o, max(earlier)[1])} if earlier else set()
    assert set(rows_any(spark, "legacy_month_day", "o_orderkey", "found_id")) == want


def rows_any(spark, name, *columns):
    return [tuple(r[c] for c in columns) for r in catalog.queries()[name](spark, DATA).collect()]


def test_all_documents_have_a_role_and_a_verdict(spark, read):
    ids = read("documents").doc_id.tolist()
    prior = read("labels").groupby("doc_id").quality.min().to_dict()
    assert set(rows_any(spark, "prior_verdicts", "doc_id", "prior")) == {(d, prior.get(d)) for d in ids}
    old = [d for d in ids if d % 4 >= 2]
    want = set()
    for c in (d for d in ids if d % 4 < 2):
        tests = (lambda k, c=c: k % 2 == 0 and k % 30 == c % 11, lambda k, c=c: k % 400 == c % 40, lambda k, c=c: k % 17 == c % 17)
        best = [(p + 1, k) for p, t in enumerate(tests) for k in old if t(k)]
        want |= {(c, min(best)[1], min(best)[0])} if best else set()
    assert set(rows_any(spark, "change_match_priority", "change_id", "candidate", "priority")) == want


def test_all_parts_and_suppliers(spark, read):
    part, nation = read("part"), read("nation")
    keys = {(n, x.lower()) for n, x in zip(nation.n_nationkey, nation.n_name, strict=True)} | {(100 + k, x.split(" ")[0]) for k, x in zip(part.p_partkey, part.p_name, strict=True)}
    word = lambda x, i: (x.split(" ") + [""] * 3)[i]
    names = {word(x, 1) for x in part.p_name} | {word(x, 2) for x in part.p_type} | {"an"}
    plain = lambda x: re.sub("[ .-]", "_", x.lower())
    hints = {(i, k, f) for i, k in keys for f in names if plain(f) in plain(k) or plain(k) in plain(f)}
    assert set(rows_any(spark, "feature_hints", "change_id", "keyword", "feature")) == hints
    assert set(rows_any(spark, "unknown_requirements", "change_id", "keyword")) == keys - {(i, k) for i, k, _ in hints}
    suppliers = read("supplier")
    nodes = set(rows_any(spark, "entity_nodes", "doc", "name"))
    assert {(k % 5, n) for k, n in zip(suppliers.s_suppkey, suppliers.s_name, strict=True)} <= nodes
    edges = rows_any(spark, "entity_graph", "doc", "source", "target")
    assert {t for _, _, t in edges} >= set(suppliers.s_name)
    count = {d: len({e for e in edges if e[0] == d}) for d in range(5)}
    assert {d: n for d, n in rows_any(spark, "graph_density", "doc", "n_edges")} == count
