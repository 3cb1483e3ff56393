"""Passage removal against a plain version that counts every window of every text."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import relative
from tests.llm.conftest import SCHEMA, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window=35):
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        spans = [(i, next((j for j in range(i, len(w)) if not gone[j]), len(w))) for i in range(len(w)) if gone[i] and (i == 0 or not gone[i - 1])]
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), tuple(spans), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(frame):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], tuple((s["start"], s["end"]) for s in r["spans"]), hashlib.sha256(r["kept"].encode()).hexdigest()) for r in relative.remove_repeats(frame).collect()), key=repr)


def edited(text, n, seed):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.random():.6f}"
    return " ".join(words)


def passages():
    r = random.Random(9)
    shared = [prose(700 + i, 90) for i in range(4)]
    texts = [prose(i, r.randint(0, 80)) + "\n" + " ".join(r.choice(shared).split()[r.randint(0, 50) :][: r.randint(20, 70)]) + " \t" + prose(900 + i, r.randint(0, 40)) for i in range(80)]
    family = prose(77, 260)
    texts += [edited(family, k, 50 * k + j) for k in (0, 1, 3, 9, 20) for j in range(4)]
    texts += [family.replace(" ", "\n"), family.upper(), prose(78, 34), prose(78, 34), prose(79, 35), prose(79, 35) + " x", "a b c " * 40, "a " * 34, "b " * 35, "c " * 36, " ".join(["x"] * 40), None, "", " \n ", "Ünï 漢字 ﬀ " * 20]
    # two halves that each stand elsewhere: windows over the seam are no repeats, or repeats in a third text
    a, b = prose(80, 50), prose(81, 50)
    return [*texts, a, b, f"{a} {b}", f"{b} {a}", " ".join(f"{a} {b}".split()[20:80])]


def test_passages(make):
    texts = passages()
    assert found(make(texts)) == plain(list(enumerate(texts)))


def test_hot_grams_over_many_blocks(make, monkeypatch):
    """Small limits, as they reach the workers in what is pickled for them."""
    texts = passages()
    want = plain(list(enumerate(texts)))
    original = relative._shared

    def spread(batches):
        relative.HOT = 3
        return original(batches)

    monkeypatch.setattr(relative, "_shared", spread)
    assert found(make(texts).repartition(1)) == want


@pytest.mark.parametrize("seed", range(6))
def test_parsing_against_all_pairs(seed):
    """Contexts of few words, so that factors of every length and place occur."""
    r = random.Random(seed)
    rows = set()
    while len(rows) < 150:
        left, right = r.randint(0, relative.SPAN - 1), r.randint(relative.GRAM, relative.WINDOW)
        if left + right < relative.WINDOW:
            continue
        base = [1 + (k * 7) % 5 for k in range(relative.WIDE)]
        for _ in range(r.choice((0, 1, 1, 2))):
            base[r.randrange(relative.WIDE)] = r.randint(6, 8)
        at = relative.SPAN - 1
        rows.add((r.randint(1, 2), left, left + right, tuple(base[at - left : at + right])))
    rows = sorted(rows)
    matrix = np.zeros((len(rows), relative.WIDE), np.uint64)
    for i, (_, left, size, words) in enumerate(rows):
        matrix[i, relative.SPAN - 1 - left : relative.SPAN - 1 - left + size] = words
    group, left, size = (np.array([x[k] for x in rows]) for k in range(3))
    known = np.array([r.random() < 0.1 for _ in rows])
    got = relative.parse(group.astype(np.uint64), left, size, matrix, known)
    windows = lambda x: {(x[0], t, x[3][x[1] - t : x[1] - t + relative.WINDOW]): t for t in range(max(0, relative.WINDOW - (x[2] - x[1])), x[1] + 1)}
    count = Counter(w for x in rows for w in windows(x))
    for i, x in enumerate(rows):
        if not known[i]:
            assert {t for w, t in windows(x).items() if count[w] > 1} == set(np.flatnonzero(got[i]).tolist())


def test_long_texts_in_pieces(monkeypatch):
    words = np.random.default_rng(3).integers(0, 40, 5000).astype(np.uint64)
    row = np.repeat([0, 1, 2], [1800, 20, 3180])
    windows = lambda parts: {(int(p), s) for p, a, b in parts for s in range(a, b + 1)}
    whole = windows(zip(*relative.anchors(words, row)[:3], strict=True))
    monkeypatch.setattr(relative, "PIECE", 700)
    assert windows(zip(*relative.anchors(words, row)[:3], strict=True)) == whole and len(whole) == 1800 + 3180 - 2 * 34


def test_odd_rows(spark, odd_rows, none):
    rows = odd_rows + [odd_rows[3], odd_rows[5], (None, "no id " * 30, None, None, 1, "c", "r")]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain([r[:2] for r in rows])
    assert found(none) == []
    assert found(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").withColumn("kept", F.lit("x"))) == plain([(1, None), (2, "")])


def test_whole_table(spark):
    from palimpsest.llm.relative import op12_substring_dedup

    data = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want = {(d, n, k, h) for d, n, k, _, h in plain(rows)}
    assert {tuple(r) for r in op12_substring_dedup(spark, data).collect()} == want
