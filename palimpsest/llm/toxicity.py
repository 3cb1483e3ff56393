"""Toxicity by compression distance to two zstandard dictionaries.

Training, on the driver, over a bounded sample of labelled rows (``MAX_TOXIC``
and ``MAX_ORDINARY`` rows by hash order of doc_id, of at most ``MAX_CHARS``
code points each and ``MAX_TOTAL`` for a class; corpus texts are scored whole).
The sample is halved by hash: one
half makes the dictionaries, the other calibrates, so that no threshold is set
on text that a dictionary has seen.

Texts with equal words and label are taken once. Of the ordinary texts of the
first half, ``MAX_COMMON`` make the ordinary dictionary.

1. Byte 6-grams without an inner space whose document frequency in toxic texts
   is far above that in ordinary texts mark the passages to learn from.
2. ``zstandard.train_dictionary`` makes one dictionary from windows of ordinary
   texts, and one from the marked passages of toxic texts. The toxic one is
   put behind a copy of the ordinary one, so that a window compresses shorter
   with it only for what toxic texts add, not because it lacks common prose.
3. Every text is cut into windows of whole words. The difference of a window's
   two compressed lengths is its distance; maximum, mean of the three largest,
   mean, number above ``HIT`` and number of windows go into a logistic score
   fitted on the second half, moved so that 0.5 is the threshold of best F1.

Scoring reads text alone and needs no shuffle. Null and empty texts get the
score of a text without windows. Without labelled rows of both classes every
text gets score 0. Labels of one doc_id are merged by their maximum.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from palimpsest.llm.runtime import drop_caches, prepare

MAX_TOXIC, MAX_ORDINARY, MAX_CHARS = 3000, 6000, 50_000
#: Code points of all texts of a class in the sample.
MAX_TOTAL = 30_000_000
#: Ordinary texts of the first half that the ordinary dictionary is trained on; the marked passages come from all.
MAX_COMMON = 1500
GRAM = 6
WINDOW, HIT = 24, 5
ORDINARY_BYTES, TOXIC_BYTES = 8192, 2048
HELD_OUT_MOD = 5


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)

    def scorer(self) -> Scorer:
        return Scorer(self)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters.from_level(3, min_match=GRAM, write_content_size=False, write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings)


def plain(text: str | None) -> bytes:
    """Lower-cased words in UTF-8 with one space before, between and after."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    return b" " + b" ".join(words) + b" " if words else b""


def windows(body: bytes, size: int = WINDOW) -> Iterator[bytes]:
    at, n, find = 0, len(body), body.find
    while at < n - 1:
        end = find(b" ", at + size)
        end = n - 1 if end < 0 else end
        yield body[at : end + 1]
        at = end


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.pair = (_compressor(model.ordinary).compress, _compressor(model.toxic).compress) if model.toxic else None

    def features(self, text: str | None) -> list[float]:
        ordinary, toxic = self.pair
        d = [len(ordinary(w)) - len(toxic(w)) for w in windows(plain(text))]
        n = len(d)
        if not n:
            return [0.0] * 5
        top = sorted(d)[-3:]
        hits = sum(x >= HIT for x in d)
        return [float(top[-1]), sum(top) / 3, sum(d) / n, float(np.log1p(hits)), float(np.log1p(n))]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        m = self.model
        if self.pair is None or not m.weights:
            return np.zeros(len(texts))
        x = (np.array([self.features(t) for t in texts], float).reshape(-1, 5) - m.mean) / m.scale
        return 1 / (1 + np.exp(-np.clip(x @ np.array(m.weights[1:]) + m.weights[0], -30, 30)))


def _grams(body: bytes) -> np.ndarray:
    raw = np.frombuffer(body, np.uint8).astype(np.uint64)
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    packed, inner = np.zeros(n, np.uint64), np.zeros(n, bool)
    for i in range(GRAM):
        packed = packed << np.uint64(8) | raw[i : i + n]
        if 0 < i < GRAM - 1:
            inner |= raw[i : i + n] == 32
    packed[inner] = 0
    return packed


def _document_frequency(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = [np.unique(_grams(b)) for b in bodies]
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)


def _marked(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """Grams whose document frequency is far higher in toxic texts."""
    grams, count = _document_frequency(toxic)
    others, other_count = _document_frequency(ordinary)
    base = np.zeros(len(grams))
    if len(others):
        at = np.minimum(np.searchsorted(others, grams), len(others) - 1)
        same = others[at] == grams
        base[same] = other_count[at[same]]
    n, m = len(toxic), max(1, len(ordinary))
    expected = (base + 1) * n / m
    strong = (count >= 5) & ((count - expected) / np.sqrt(expected + 0.5) > 8) & (count / n > 8 * (base + 2) / m) & (grams > 0)
    return grams[strong]


def _passages(body: bytes, marked: np.ndarray) -> list[bytes]:
    hit = np.isin(_grams(body), marked)
    if not hit.any():
        return []
    edge = np.zeros(len(body) + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + GRAM, -1)
    covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    flips = np.flatnonzero(covered[1:] != covered[:-1])
    return [body[a:b] for a, b in zip(flips[::2], flips[1::2], strict=True)]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """COVER training; too few samples for it are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=GRAM, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(sample: list[tuple[int, str | None, int]], max_common: int = MAX_COMMON) -> Model:
    """A model from (doc_id, text, toxic) rows; a function of the rows, not of their order. Equal texts of one label count once."""
    seen: set[tuple[bytes, bool]] = set()
    halves: tuple[tuple[list, list], tuple[list, list]] = (([], []), ([], []))
    for doc_id, text, toxic in sorted(sample, key=lambda r: (zlib.crc32(b"order%d" % r[0]), r[0])):
        body = plain(text)
        key = (hashlib.sha256(body).digest(), bool(toxic))
        if body and key not in seen:
            seen.add(key)
            halves[zlib.crc32(b"half%d" % doc_id) % 2][int(bool(toxic))].append((text, body))
    (ordinary, toxic), calibration = halves
    if not ordinary or not toxic or not calibration[0] or not calibration[1]:
        return Model()
    bodies = [b for _, b in toxic], [b for _, b in ordinary]
    marked = _marked(*bodies)
    passages = [p for b in bodies[0] for p in _passages(b, marked)]
    if not passages:
        passages = [w for b in bodies[0] for w in windows(b, 64)]
    packs = [b"".join(passages[i : i + 16]) for i in range(0, len(passages), 16)]
    common = _dictionary([w for b in bodies[1][:max_common] for w in windows(b, 256)], ORDINARY_BYTES)
    model = Model(common, common + _dictionary(packs, TOXIC_BYTES))
    scorer = model.scorer()
    y = np.array([0] * len(calibration[0]) + [1] * len(calibration[1]), float)
    x = np.array([scorer.features(t) for part in calibration for t, _ in part])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    w = _fit_logistic((x - mean) / scale, y)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale]) @ w
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f1))
    cut = (z[order][best] + z[order][min(best + 1, len(y) - 1)]) / 2
    w[0] -= cut
    model.weights, model.mean, model.scale = w.tolist(), mean.tolist(), scale.tolist()
    return model


def held_out(column) -> F.Column:
    return F.crc32(column.cast("string").cast("binary")) % HELD_OUT_MOD == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, max_chars: int = MAX_CHARS) -> list[tuple[int, str | None, int]]:
    """At most max_toxic + max_ordinary labelled rows that are not held out, by hash order of doc_id."""
    merged = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") <= max_chars)
    known = texts.select("doc_id", F.length("text").alias("size")).join(merged, "doc_id")
    chosen = []
    for toxic, n in ((1, max_toxic), (0, max_ordinary)):
        total = 0
        for r in known.filter(F.col("toxic") == toxic).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(n).collect():
            total += r["size"]
            if total > MAX_TOTAL:
                break
            chosen.append(r)
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r["doc_id"], int(r["toxic"])) for r in chosen], "doc_id long, toxic int")
    return [(r["doc_id"], r["text"], r["toxic"]) for r in texts.join(F.broadcast(ids), "doc_id").collect()]


def _score(model: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        scorer = model.scorer()
        for batch in batches:
            scores = scorer.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores, pa.float64())], [*names, "toxic_score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``toxic_score``, which replaces a column of that name; only ``text`` is read for it."""
    prepare(docs.sparkSession)
    base = docs.drop("toxic_score")
    schema = StructType([*base.schema.fields, StructField("toxic_score", DoubleType())])
    return base.mapInArrow(_score(model, base.columns), schema)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns as they are."""
    prepare(docs.sparkSession)
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        scorer = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(batch.column(where).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows and score every row of ``docs``."""
    return score(docs, train(labelled_sample(docs, labels)))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
