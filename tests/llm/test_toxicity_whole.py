"""Scores against a plain scorer, and what they are worth on held-out rows."""

import math
import zlib

import numpy as np
import pandas as pd
import pytest
import zstandard

from palimpsest.llm import toxicity

DATA = "/root/testdata/{}"


def labelled(size):
    folder = DATA.format(size)
    docs = pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    marks = pd.read_parquet(f"{folder}/labels.parquet").groupby("doc_id").toxic.max().reset_index()
    rows = marks.merge(docs, on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id])
    return rows[~held], rows[held]


def length(dictionary, window):
    settings = zstandard.ZstdCompressionParameters.from_level(3, min_match=6, write_content_size=False, write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings).compress(window))


def plain_score(model, text):
    words, distances, at = (text or "").lower().encode().split(), [], 0
    while at < len(words):
        window = b" "
        while at < len(words) and len(window) <= toxicity.WINDOW:
            window += words[at] + b" "
            at += 1
        distances.append(length(model.ordinary, window) - length(model.toxic, window))
    if not distances:
        features = [0.0] * 5
    else:
        best = sorted(distances)[-3:]
        features = [max(distances), sum(best) / 3, sum(distances) / len(distances), math.log(1 + sum(d >= toxicity.HIT for d in distances)), math.log(1 + len(distances))]
    z = model.weights[0] + sum(w * (f - m) / s for w, f, m, s in zip(model.weights[1:], features, model.mean, model.scale, strict=True))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def sample(rows):
    return [(int(i), t, int(y)) for i, t, y in zip(rows.doc_id, rows.text, rows.toxic, strict=True) if len(t) <= toxicity.MAX_CHARS]


def test_scores_are_those_of_a_plain_scorer(spark):
    train, held = labelled("sf0.01")
    model = toxicity.train(sample(train))
    texts = [t for t in held.text.tolist() if len(t) < 4000][:40] + [None, "", "a", "  \n ", "one two three four five six seven eight"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(docs, model).collect()}
    for i, t in enumerate(texts):
        assert found[i] == pytest.approx(plain_score(model, t), abs=1e-9)


def test_held_out_rows_are_told_apart():
    train, held = labelled("sf0.1")
    scores = toxicity.train(sample(train)).scorer().scores(held.text.tolist())
    rank, y = pd.Series(scores).rank().to_numpy(), held.toxic.to_numpy()
    n, m = y.sum(), (1 - y).sum()
    auc = (rank[y == 1].sum() - n * (n + 1) / 2) / (n * m)
    print("AUC", auc)
    assert auc >= 0.75
