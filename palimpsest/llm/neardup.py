"""Near-duplicate classes by ProbMinHash signatures, banding and verification.

A text is the bag of its five-word shingles (words are runs of bytes other than
space and 09-0D); the weight of a shingle is the number of its occurrences.
Similarity is the probability Jaccard index of two bags,

    J(x, y) = sum over i in both of 1 / sum over j of max(x_j / x_i, y_j / y_i),

which is the plain Jaccard index where no shingle repeats. A text of one to
four words has one shingle, its words. A text without words is like no other.

1. Signature: each shingle sends points of an exponential process of rate equal
   to its weight to the registers, one register after the other in an order of
   its own. The least point of each register and its shingle make the
   signature; two signatures agree in a register with probability J. A shingle
   stops as soon as its next point is above the largest register of its text.
2. Texts of equal word sequence are collapsed to the least doc_id.
3. Bands of registers give bucket keys; only buckets of two texts and more go
   on. In each bucket every text is compared with one leader, the text whose
   buckets hold most texts. Leaders are ordered, so a text's best leader, and
   that one's own, is a label: texts of one label are known to be connected.
4. Buckets that still hold several labels are open. Texts of different labels
   are compared there: as pairs in buckets of at most ``SMALL`` texts, block by
   block in larger ones, blocks being bounded in texts and in shingles. So no
   link is lost that could join two classes, and no bucket is expanded into
   more than a fixed number of pairs. A large bucket's blocks are dealt by a
   salt that grows with their number.
5. Classes are the connected components of the labels under all links found;
   the class id is the least doc_id.

Intermediate tables lie in a folder of their own in the shared folder and are
removed once nothing reads them; those that the result reads stay.

Null text counts as empty. Rows of one doc_id get the same class, the least of
those of their texts; a row without doc_id gets none. Extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import textbytes as tb
from palimpsest.llm.graph import components
from palimpsest.llm.runtime import Tables, drop_caches, narrow, one_text_per_id, prepare, release, shuffle_width

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS = 128
BANDS, ROWS = 21, 6
#: Open buckets of at most so many texts are compared as pairs, each pair once for all its buckets.
SMALL = 16
#: Texts, and distinct shingles, of a block of the comparison of larger ones; blocks of one salt.
BLOCK, BLOCK_SHINGLES, SALTED = 64, 1 << 17, 32
_STEP = np.array([pow(tb.BASE, 7 * j + 3, 1 << 64) for j in range(SHINGLE)], dtype=np.uint64)
SKETCH = "doc_id long, hi long, lo long, size int, bands array<long>"


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    starts, ends, row = tb.words(data, off)
    return tb.span_hashes(tb.prefix(data), starts, ends), row


def shingles(data: np.ndarray, off: np.ndarray, hashed: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row with their counts, ordered by row, and the number of words of each row."""
    n = len(off) - 1
    hashes, row = hashed or word_hashes(data, off)
    words = np.bincount(row, minlength=n)
    m = max(0, len(hashes) - SHINGLE + 1)
    whole = row[:m] == row[SHINGLE - 1 :] if m else np.zeros(0, bool)
    value = np.zeros(m, np.uint64)
    for j in range(SHINGLE):
        value += hashes[j : j + m] * _STEP[j]
    value, owner = tb.mix(value[whole]), row[:m][whole]
    short = np.flatnonzero((words > 0) & (words < SHINGLE))
    if len(short):
        first = np.searchsorted(row, short)
        sums = np.zeros(len(short), np.uint64)
        for j in range(SHINGLE - 1):
            inside = j < words[short]
            sums[inside] += hashes[first[inside] + j] * _STEP[j]
        value, owner = np.concatenate([value, tb.mix(sums ^ tb.U(0xA5A5A5A5A5A5A5A5))]), np.concatenate([owner, short])
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return value[at], owner[at], np.diff(np.append(at, len(value))), words


def _exponential(seed: np.ndarray) -> np.ndarray:
    return -np.log(((tb.mix(seed) >> tb.U(11)).astype(np.float64) + 0.5) * 2.0**-53)


def signatures(value: np.ndarray, owner: np.ndarray, weight: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """(rows, registers) of the shingle that reached each register first; 0 where a row has none.

    The k-th of m points of a shingle comes after a pause of rate
    weight * (m - k) / m: points of m exponential clocks in order of time. Its
    register is the k-th of an order that the shingle fixes.
    """
    least = np.full(rows * registers, np.inf)
    holder = np.zeros(rows * registers, np.uint64)
    seed = tb.mix(value ^ tb.U(0x51ED270B0F9D3C21))
    first = (seed >> tb.U(7)) % tb.U(registers)
    stride = (seed >> tb.U(23)) % tb.U(registers) | tb.U(1)
    base = owner.astype(np.int64) * registers
    rate = weight.astype(np.float64)
    time = np.zeros(len(value))
    live = np.arange(len(value))
    for k in range(registers):
        time[live] += _exponential(seed[live] + tb.U((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) / (rate[live] * (registers - k) / registers)
        worst = least.reshape(rows, registers).max(axis=1)
        live = live[time[live] < worst[owner[live]]]
        if not len(live):
            break
        slot = base[live] + ((first[live] + tb.U(k) * stride[live]) % tb.U(registers)).astype(np.int64)
        np.minimum.at(least, slot, time[live])
        won = least[slot] == time[live]
        holder[slot[won]] = value[live[won]]
    return holder.reshape(rows, registers)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signature), tb.U(b + 1))
        for r in range(rows):
            key = tb.mix(key * tb.U(tb.BASE) + signature[:, b * rows + r])
        out[:, b] = key
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Print of the word sequence, distinct shingles and bucket keys; null where a row has no words or no id."""
    drop_caches()
    for batch in batches:
        data, off = tb.utf8(batch.column("text"))
        known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        for lo, hi in tb.chunks(off):
            part, cut_off = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            hashes, row = word_hashes(part, cut_off)
            value, owner, weight, words = shingles(part, cut_off, (hashes, row))
            keys = band_keys(signatures(value, owner, weight, hi - lo))
            first = np.searchsorted(row, np.arange(hi - lo + 1))
            up, down = tb.powers(len(hashes) + 1)
            prints = []
            for salt in (1, 0xB5297A4D3F84D5B5):
                sums = np.zeros(len(hashes) + 1, np.uint64)
                np.cumsum(tb.mix(hashes * tb.U(salt)) * up[: len(hashes)], dtype=np.uint64, out=sums[1:])
                prints.append(tb.mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]]).view(np.int64))
            gone = ~((words > 0) & known[lo:hi])
            ends = np.concatenate([[0], np.cumsum(~gone * BANDS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[~gone].ravel().view(np.int64)), mask=pa.array(gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array(prints[0], mask=gone), pa.array(prints[1], mask=gone), pa.array(np.bincount(owner, minlength=hi - lo).astype(np.int32)), lists], ["doc_id", "hi", "lo", "size", "bands"]
            )


def probability_jaccard(va: np.ndarray, wa: np.ndarray, vb: np.ndarray, wb: np.ndarray) -> float:
    """Exact index of two bags whose values are in ascending order.

    For a shared shingle with weights p and q the inner sum takes x_j / p where
    x_j / y_j is above p / q and y_j / q elsewhere, so with the shingles in
    order of x_j / y_j it is two prefix sums; no pair of shingles is formed.
    """
    if not len(va) or not len(vb):
        return 0.0
    every = np.union1d(va, vb)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, va)] = wa
    y[np.searchsorted(every, vb)] = wb
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    if x.max() == 1 and y.max() == 1:
        return float(both.sum() / len(every))
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    ratio, x, y, both = ratio[order], x[order], y[order], both[order]
    y_before = np.concatenate([[0.0], np.cumsum(y)])
    x_after = np.concatenate([[0.0], np.cumsum(x)])
    at = np.searchsorted(ratio, ratio[both], "right")
    total = (x_after[-1] - x_after[at]) / x[both] + y_before[at] / y[both]
    return float((1 / total).sum())


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    value, _, weight, _ = shingles(raw, np.array([0, len(raw)]))
    return value, weight


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, held = None, None
    for batch in batches:
        b = batch.column("b").to_numpy()
        alike = np.zeros(len(b))
        for i, (ta, text) in enumerate(zip(batch.column("text_a"), batch.column("text_b"), strict=True)):
            if name != b[i]:
                name, held = b[i], _bag(text.as_py())
            alike[i] = probability_jaccard(*_bag(ta.as_py()), *held)
        kept = [n for n in batch.schema.names if n not in ("text_a", "text_b")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(alike)], [*kept, "similarity"])


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b of doc_ids, other columns of numbers) with their similarity. Both joins are on ids; one very common b is split by Spark."""
    found = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    schema = ", ".join(f"{n} long" for n in pairs.columns) + ", similarity double"
    return found.select(*pairs.columns, "text_a", "text_b").mapInArrow(_compare, schema)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            value, weight = _bag(text)
            out.append(value.astype("<u8").tobytes() + weight.astype("<u8").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(out, pa.binary())], ["rep", "bag"])


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between texts of different classes in two blocks of one bucket, one for each pair of classes."""

    def read(items: pa.StructArray) -> tuple[list, list, list, list]:
        bags = [np.frombuffer(x, "<u8").reshape(2, -1) for x in items.field("bag").to_pylist()]
        return items.field("rep").to_pylist(), items.field("root").to_pylist(), [b[0] for b in bags], [b[1] for b in bags]

    for batch in batches:
        found: list[tuple[int, int, float]] = []
        for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
            ra, ca, va, wa = read(left.values)
            rb, cb, vb, wb = read(right.values)
            size_a, size_b = np.array([len(v) for v in va]), np.array([len(v) for v in vb])
            both = np.intersect1d(np.concatenate(va), np.concatenate(vb))
            shared = np.zeros((len(va), len(vb)), np.float32)
            ends = []
            for vs, size in ((va, size_a), (vb, size_b)):
                at = np.searchsorted(both, flat := np.concatenate(vs))
                at[at == len(both)] = 0
                hit = both[at] == flat if len(both) else np.zeros(len(flat), bool)
                ends.append((np.repeat(np.arange(len(vs)), size)[hit], at[hit]))
            for lo in range(0, len(both), 4096):
                grids = []
                for (row, at), n in zip(ends, (len(va), len(vb)), strict=True):
                    grid = np.zeros((n, min(4096, len(both) - lo)), np.float32)
                    some = (at >= lo) & (at < lo + 4096)
                    grid[row[some], at[some] - lo] = 1
                    grids.append(grid)
                shared += grids[0] @ grids[1].T
            once_a, once_b = np.array([w.max() == 1 for w in wa]), np.array([w.max() == 1 for w in wb])
            plain = shared / (size_a[:, None] + size_b[None] - shared)
            # without repeated shingles this is the index itself; with them it is computed
            maybe = (plain >= THRESHOLD) | ((shared > 0) & ~(once_a[:, None] & once_b[None]))
            maybe &= np.array(ca)[:, None] != np.array(cb)[None]
            known: set[tuple[int, int]] = set()
            for i, j in zip(*np.nonzero(maybe), strict=True):
                pair = (min(ca[i], cb[j]), max(ca[i], cb[j]))
                if pair not in known:
                    alike = float(plain[i, j]) if once_a[i] and once_b[j] else probability_jaccard(va[i], wa[i], vb[j], wb[j])
                    if alike >= THRESHOLD:
                        known.add(pair)
                        found.append((max(ra[i], rb[j]), min(ra[i], rb[j]), alike))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], ["a", "b", "similarity"])


def _small(placed: DataFrame) -> DataFrame:
    """(a, b) of different labels in buckets of at most ``SMALL`` texts, without the pairs of a bucket's leader, which are compared before."""
    few = placed.filter((F.col("n") > 2) & (F.col("n") <= SMALL)).groupBy("key").agg(F.collect_list(F.struct("score", (-F.col("rep")).alias("order"), "rep", "label")).alias("held"))
    leader = F.array_max("held")["rep"]
    rest = F.filter("held", lambda x: x["rep"] != leader)
    pairs = F.transform(rest, lambda x: F.transform(F.filter(rest, lambda y: (y["rep"] < x["rep"]) & (y["label"] != x["label"])), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b"))))
    return few.select(F.inline(F.flatten(pairs))).distinct()


def _large(placed: DataFrame, texts: DataFrame, tables: Tables) -> DataFrame | None:
    """Links across labels in larger buckets, each text against all of other labels in its bucket; None where no bucket is open.

    Texts go in blocks: large classes have blocks of their own, small ones
    share blocks. Rows are pairs of blocks, never of texts, and a pair of
    blocks of one class is not formed.
    """
    many, few = placed.filter(F.col("n") > SMALL), narrow(tables.spark)
    classes = tables.put("classes", many.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("w")), tasks=few)
    parts = lambda c, w: F.greatest(F.ceil(c / BLOCK), F.ceil(w / BLOCK_SHINGLES))
    big = F.col("c") >= BLOCK // 4
    mixed = classes.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum(F.when(~big, F.col("c"))).alias("m"), F.sum(F.when(~big, F.col("w"))).alias("v"), F.sum(F.when(big, parts(F.col("c"), F.col("w")))).alias("own_blocks"))
    shared = F.coalesce(parts(F.col("m"), F.col("v")), F.lit(0))
    mixed = tables.put("mixed", mixed.filter("k > 1").select("key", shared.alias("shared"), F.ceil((F.coalesce("own_blocks", F.lit(0)) + shared) / SALTED).alias("salts")), tasks=few)
    if mixed.isEmpty():
        return None
    shaped = tables.put("shaped", classes.join(mixed, "key").select("key", "label", F.when(big, F.col("label")).alias("own"), F.when(big, parts(F.col("c"), F.col("w"))).otherwise(F.col("shared")).alias("parts"), "salts"), tasks=few)
    number = F.pmod(F.xxhash64("rep"), F.col("parts")).alias("number")
    open_ = tables.put("open", many.select("key", "rep", "label").join(shaped, ["key", "label"]).select("key", "own", number, "salts", "rep", "label"), tasks=few)
    bags = texts.join(open_.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text").mapInArrow(_pack, "rep long, bag binary")
    block = F.collect_list(F.struct("rep", F.col("label").alias("root"), "bag")).alias("texts")
    blocks = tables.put("blocks", open_.join(bags, "rep").groupBy("key", "own", "number").agg(F.first("salts").alias("salts"), block))
    left = blocks.select("key", F.pmod(F.xxhash64("own", "number"), F.col("salts")).alias("salt"), F.coalesce("own", F.lit(-(1 << 63))).alias("o"), F.col("number").alias("i"), F.col("own").alias("own_i"), F.col("texts").alias("left"))
    right = blocks.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.coalesce("own", F.lit(-(1 << 63))).alias("p"), F.col("number").alias("j"), F.col("own").alias("own_j"), F.col("texts").alias("right"))
    ordered = (F.col("o") < F.col("p")) | ((F.col("o") == F.col("p")) & (F.col("i") <= F.col("j")) & F.col("own_i").isNull() & F.col("own_j").isNull())
    return left.join(right, ["key", "salt"]).filter(ordered).select("left", "right").mapInArrow(_cross, "a long, b long, similarity double").select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_join_links): the class of each row of ``docs``, and the links used to join the class that end at the row's text. Similar texts of one class that other links have joined are not counted.

    The driver sees counts alone.
    """
    spark = prepare(docs.sparkSession)
    every = one_text_per_id(docs, id_col, text_col)
    tables, few = Tables(spark, "near"), narrow(spark)
    sketch = tables.put("sketch", every.mapInArrow(_sketch, SKETCH))
    same = tables.put("same", sketch.filter("hi is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    slots = same.select("rep", "size", F.explode("bands").alias("key"))
    sizes = tables.put("sizes", slots.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), tasks=few)
    held = tables.put("held", slots.join(sizes, "key").groupBy("rep").agg(F.max("size").alias("size"), F.sum("n").alias("score"), F.collect_list(F.struct("key", "n")).alias("slots")))
    # every text that is compared shares a bucket: these are set apart once, and all comparisons read them
    # by shuffle at every size: what shares a bucket grows with the corpus
    texts = tables.put("texts", every.join(held.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi"))
    tables.drop("sizes")

    open_ = held.select("rep", "score", F.explode("slots.key").alias("key"))
    lead = tables.put("lead", open_.groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("order"))).alias("least")).select("key", (-F.col("least.order")).alias("leader"), F.col("least.score").alias("rank")), tasks=few)
    pairs = open_.join(lead, "key").filter("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b"), "rank").distinct()
    near = tables.put("led", compare(pairs, texts).filter(F.col("similarity") >= THRESHOLD).select("a", "b", "rank"))
    best = tables.put("best", near.groupBy("a").agg(F.max(F.struct("rank", (-F.col("b")).alias("order"))).alias("top")).select(F.col("a").alias("rep"), (-F.col("top.order")).alias("label")), tasks=few)
    labels = tables.put("labels", best.join(best.select(F.col("rep").alias("label"), F.col("label").alias("above")), "label", "left").select("rep", F.coalesce("above", "label").alias("label")), tasks=few)
    placed = tables.put("placed", held.join(labels, "rep", "left").select("rep", "size", "score", F.coalesce("label", "rep").alias("label"), F.inline("slots")))
    tables.drop("lead", "best")
    release(spark)

    links = [near.select("a", "b"), tables.put("small", compare(_small(placed), texts).filter(F.col("similarity") >= THRESHOLD).select("a", "b"))]
    large = _large(placed, texts, tables)
    if large is not None:
        # Spark splits a bucket of many blocks among many tasks, which find few links each
        links.append(tables.put("large", large, tasks=max(few, shuffle_width(spark))))
    tables.drop("texts", "placed", "classes", "mixed", "shaped", "open", "blocks")
    release(spark)
    links = reduce(DataFrame.union, links)

    end = lambda name, to: labels.select(F.col("rep").alias(name), F.col("label").alias(to))
    crossing = links.join(end("a", "u"), "a", "left").join(end("b", "v"), "b", "left").select(F.coalesce("u", "a").alias("u"), F.coalesce("v", "b").alias("v")).filter("u <> v").distinct()
    merged = tables.put("merged", components(crossing, "u", "v").select(F.col("node").alias("label"), "root"), tasks=few)
    marked = held.select("rep").join(labels, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label")).join(merged, "label", "left").select("rep", F.coalesce("root", "label").alias("root"), F.lit(0).alias("n"))
    ends = links.select(F.explode(F.array("a", "b")).alias("rep"), F.lit(None).cast("long").alias("root"), F.lit(1).alias("n"))
    reps = tables.put("reps", marked.union(ends).groupBy("rep").agg(F.max("root").alias("root"), F.sum("n").cast("long").alias("n_join_links")), tasks=few)
    least = tables.put("least", reps.groupBy("root").agg(F.min("rep").alias("class_id")), tasks=few)
    classes = tables.put("found", same.select("hi", "lo", "rep").join(reps.join(least, "root"), "rep", "left").select("hi", "lo", F.coalesce("class_id", "rep").alias("class_id"), "n_join_links"), tasks=few)
    known = sketch.select("doc_id", "hi", "lo").join(classes, ["hi", "lo"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_join_links").alias("n_join_links"))
    found = tables.put("classes", sketch.select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_join_links", F.lit(0)).cast("long").alias("n_join_links")), tasks=few)
    tables.drop("sketch", "same", "held", "led", "labels", "small", "large", "merged", "reps", "least", "found")
    return found


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
