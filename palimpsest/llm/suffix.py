"""Removal of repeated byte strings by a sparse, range-partitioned suffix array.

A byte goes if a string of ``LENGTH`` (100) bytes over it also starts earlier
(smaller doc_id, or the same document and an earlier start). Strings lie within
a document, may overlap, and are judged on the input.

Not every suffix has to be sorted. Of the 24-byte grams in a 100-byte window
the one of least hash is its anchor, which depends on the window's bytes alone:
equal windows have equal anchors at equal distance. So only suffixes that start
at anchors are candidates, one in about forty, and of these only those whose
gram occurs again.

1. Anchors are dealt by gram hash in packed blocks; grams that occur once drop
   out. Grams that repeat within a map task are combined there, so a very
   common passage sends one anchor for each task, not for each document.
2. Splitters sampled from the leading 8 bytes of the remaining suffixes define
   ranges. Each document sends its anchors' contexts (the bytes of all windows
   of an anchor, at most 176) to the range of the anchor's suffix.
3. A range sorts its suffixes by multikey quicksort, eight bytes a key. The
   common prefix with either neighbour bounds how far a window can repeat;
   windows within that bound are matched by 64-bit hash at each distance from
   the anchor, and every one but the first in (doc_id, start) order is a repeat
   if its bytes are those of the first. Were they not, the range would be
   matched by bytes alone.
4. Where one leading key fills more than one range, its suffixes are spread
   over them, and the first of each window in a range is compared across the
   range boundaries by a keyed minimum; the key is two independent hashes.
5. Repeats of a document are united to runs and cut from its bytes.

Null text counts as empty. A row without doc_id has no order and is left as it
is. Equal rows are one document given twice: neither repeats the other, and
both get the same result. Different texts of one doc_id stand one after the
other in order of text, and no string crosses from one to the next; positions
count through them, so a text that repeats one before it in its id goes. Any
document length works: long texts are worked on in overlapping pieces. An
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import textbytes as tb
from palimpsest.llm.runtime import cut, one_text_per_id, prepare, release, shuffle_width

LENGTH = 100
GRAM = 24
SPAN = LENGTH - GRAM + 1
WIDE = LENGTH + SPAN - 1
#: Bytes worked on at once; a position in a piece takes 20 bits.
PIECE = 1 << 19
SAMPLE = 256
#: Anchors that a range is made for.
RANGE = 200_000
#: Rows that the sort orders by all their keys at once.
FEW = 512
PACKED = "kind int, bucket int, doc_id long, lead long, pack binary"
FOUND, KNOWN, LEAD = 0, 1, 2


def _pieces(off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, first byte, last byte + 1); a row above PIECE comes in parts that overlap by LENGTH - 1."""
    for lo, hi in tb.chunks(off, PIECE):
        a, b = int(off[lo]), int(off[hi])
        if b - a <= 2 * PIECE:
            yield lo, hi, a, b
        else:
            for s in range(a, b - LENGTH + 1, PIECE):
                yield lo, hi, s, min(b, s + PIECE + LENGTH - 1)


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, first and last window start, and gram hash of each anchor, in order of position."""
    n = len(data) - LENGTH + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, np.zeros(0, np.uint64)
    grams = tb.gram_hashes(data, GRAM)
    low = tb.slide_min(grams & ~tb.U(0xFFFFF) | np.arange(len(grams), dtype=np.uint64), SPAN)
    edge = np.zeros(n + 1, np.int64)
    ends, starts = off[1:], off[:-1]
    np.add.at(edge, np.clip(starts, 0, n), 1)
    np.add.at(edge, np.clip(np.maximum(ends - LENGTH + 1, starts), 0, n), -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    if not len(at):
        return empty, empty, empty, np.zeros(0, np.uint64)
    pos = (low[at] & tb.U(0xFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    return pos[head], at[head], at[tail], grams[pos[head]]


def _lead(data: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a signed number in byte order."""
    out = np.zeros(len(pos), np.uint64)
    for j in range(8):
        out = out << tb.U(8) | data[pos + j].astype(np.uint64)
    return (out ^ tb.U(1 << 63)).view(np.int64)


def _rows(kind: int, bucket: np.ndarray, doc: np.ndarray, lead: np.ndarray, packs: list[bytes]) -> pa.RecordBatch:
    n = len(bucket)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(bucket, np.int32)), pa.array(np.asarray(doc, np.int64)), pa.array(np.asarray(lead, np.int64)), pa.array(packs, pa.binary())], ["kind", "bucket", "doc_id", "lead", "pack"])


def _by_document(docs: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(docs):
        order = np.lexsort((pos, docs))
        docs, pos = docs[order], pos[order]
        head = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        raw, ends = pos.astype("<u4"), np.append(head[1:], len(docs))
        zero = np.zeros(len(head), np.int64)
        yield _rows(KNOWN, docs[head] & 0x7FFFFFFF, docs[head], zero, [raw[a:b].tobytes() for a, b in zip(head, ends, strict=True)])


def _send_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                yield from one(batch.slice(lo, 4096))

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, off = tb.utf8(batch.column("text"))
        ids, shift = batch.column("doc_id").to_numpy(), batch.column("shift").to_numpy()
        parts = []
        for lo, hi, a, b in _pieces(off):
            own = np.clip(off[lo : hi + 1], a, b) - a
            pos, _, _, gram = anchors(data[a:b], own)
            row = np.searchsorted(own, pos, "right") - 1
            parts.append((gram, row + lo, pos + a - off[row + lo] + shift[row + lo], _lead(data[a:b], pos) if len(pos) else np.zeros(0, np.int64)))
        if not parts:
            return
        gram, row, pos, lead = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, row, gram))
        gram, row, pos, lead = gram[order], row[order], pos[order], lead[order]
        first = np.append(True, gram[1:] != gram[:-1])[: len(gram)]
        many = np.append(~first[1:], False)[: len(gram)] & first
        sampled = tb.mix(tb.mix(ids[row].astype(np.uint64)) + pos.astype(np.uint64)) % tb.U(SAMPLE) == 0
        yield from _by_document(ids[row[~first]], pos[~first])
        extra = lead[~first & sampled]
        if len(extra):
            yield _rows(LEAD, np.arange(len(extra)) % buckets, np.zeros(len(extra)), extra, [b""] * len(extra))
        gram, row, pos, lead, many, sampled = (x[first] for x in (gram, row, pos, lead, many, sampled))
        bucket = (gram >> tb.U(40)) % tb.U(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        packs, to = [], []
        for k in range(buckets):
            at = order[cuts[k] : cuts[k + 1]]
            if len(at):
                used, index = np.unique(row[at], return_inverse=True)
                s = np.flatnonzero(sampled[at])
                sizes = np.array([len(at), len(used), len(s)], "<u4")
                packs.append(b"".join(x.tobytes() for x in (sizes, ids[used].astype("<i8"), (gram[at] >> tb.U(16)).astype("<u4"), (gram[at] & tb.U(0xFFFF)).astype("<u2"), index.astype("<u2"), pos[at].astype("<u4"), many[at], s.astype("<u4"), lead[at][s].astype("<i8"))))
                to.append(k)
        if to:
            yield _rows(FOUND, to, np.zeros(len(to)), np.zeros(len(to)), packs)

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Packs of one bucket after the other, as rows come in order of bucket."""
    held, packs = None, []
    for batch in batches:
        for bucket, pack in zip(batch.column("bucket").to_pylist(), batch.column("pack").to_pylist(), strict=True):
            if bucket != held and packs:
                yield held, packs
                packs = []
            held = bucket
            packs.append(pack)
    if packs:
        yield held, packs


def _keep_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of grams that occur twice and more. Rows come in order of (kind, bucket)."""
    rest: list[pa.RecordBatch] = []

    def found() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            other = batch.filter(pa.array(kind != FOUND))
            if len(other):
                rest.append(other)
            yield batch.filter(pa.array(kind == FOUND))

    for _, packs in _buckets(found()):
        while rest:
            yield rest.pop()
        parts = []
        for pack in packs:
            n, m, k = (int(x) for x in np.frombuffer(pack, "<u4", 3))
            at = 12

            def take(form: str, count: int) -> np.ndarray:
                nonlocal at
                out = np.frombuffer(pack, form, count, at)  # noqa: B023
                at += out.nbytes
                return out

            ids, high, low, index, pos, many, s, lead = take("<i8", m), take("<u4", n), take("<u2", n), take("<u2", n), take("<u4", n), take("?", n), take("<u4", k), take("<i8", k)
            leads = np.zeros(n, np.int64)
            leads[s] = lead
            mark = np.zeros(n, bool)
            mark[s] = True
            parts.append((high.astype(np.uint64) << tb.U(16) | low, ids[index], pos, many, mark, leads))
        gram, doc, pos, many, mark, leads = (np.concatenate(x) for x in zip(*parts, strict=True))
        shared = pd.Series(gram).duplicated(keep=False).to_numpy() | many
        yield from _by_document(doc[shared], pos[shared])
        some = leads[shared & mark]
        if len(some):
            yield _rows(LEAD, np.zeros(len(some)), np.zeros(len(some)), some, [b""] * len(some))
    yield from rest


def _send_contexts(splitters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                yield from one(batch.slice(lo, 512))

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, off = tb.utf8(batch.column("text"))
        ids, shift = batch.column("doc_id").to_numpy(), batch.column("shift").to_numpy()
        wanted = np.zeros(len(data) + 1, bool)
        for i, packs in enumerate(batch.column("packs").to_pylist()):
            own = np.frombuffer(b"".join(packs), "<u4").astype(np.int64) - shift[i]
            wanted[off[i] + own[(own >= 0) & (own < off[i + 1] - off[i])]] = True
        squeeze = zstandard.ZstdCompressor(level=1).compress
        parts = []
        for lo, hi, a, b in _pieces(off):
            piece = data[a:b]
            own = np.clip(off[lo : hi + 1], a, b) - a
            pos, first, last, _ = anchors(piece, own)
            keep = wanted[a + pos] if len(pos) else np.zeros(0, bool)
            pos, first, last = pos[keep], first[keep], last[keep]
            if not len(pos):
                continue
            row = np.searchsorted(own, pos, "right") - 1 + lo
            size = last - first + LENGTH
            ends = np.cumsum(size)
            body = piece[np.repeat(first - (ends - size), size) + np.arange(ends[-1])]
            lead = _lead(piece, pos)
            left, right = np.searchsorted(splitters, lead, "left"), np.searchsorted(splitters, lead, "right")
            spread = right - left >= 2
            to = np.where(spread, left + (tb.mix(ids[row].astype(np.uint64)) % (right - left + 1).astype(np.uint64)).astype(np.int64), right)
            parts.append((to, ids[row], first + a - off[row] + shift[row], pos - first, size, spread, ends, body))
        for to, doc, first, left, size, spread, ends, body in parts:
            order = np.argsort(to, kind="stable")
            used, cuts = np.unique(to[order], return_index=True)
            packs = []
            for at in np.split(order, cuts[1:]):
                some = size[at]
                stop = np.cumsum(some)
                bytes_ = body[np.repeat(ends[at] - some - (stop - some), some) + np.arange(stop[-1])]
                packs.append(squeeze(b"".join(x.tobytes() for x in (np.array([len(at)], "<u4"), doc[at].astype("<i8"), first[at].astype("<u4"), left[at].astype("u1"), some.astype("u1"), spread[at], bytes_))))
            yield _rows(FOUND, used, np.zeros(len(used)), np.zeros(len(used)), packs)

    return run


def multikey_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``keys`` and, for each row in it, how many leading keys it shares with the row before.

    Multikey quicksort: a range is parted in three by one key of a pivot row;
    rows below and above it are parted again by the same key, equal ones by
    the next. Ranges of at most ``FEW`` rows are ordered by all keys left.
    """
    n, depth = keys.shape
    order = np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        lo, hi, d = todo.pop()
        if hi - lo < 2 or d == depth:
            continue
        rows = order[lo:hi]
        if hi - lo <= FEW:
            order[lo:hi] = rows[np.lexsort(keys[rows, d:].T[::-1])]
            continue
        value = keys[rows, d]
        pivot = np.sort(value[:: len(value) // 63])[31]
        below, above = value < pivot, value > pivot
        i, j = lo + int(below.sum()), hi - int(above.sum())
        order[lo:hi] = np.concatenate([rows[below], rows[~below & ~above], rows[above]])
        todo += [(lo, i, d), (i, j, d + 1), (j, hi, d)]
    same = np.zeros(n, np.int64)
    tied = np.ones(max(0, n - 1), bool)
    for d in range(depth):
        tied &= keys[order[1:], d] == keys[order[:-1], d]
        if not tied.any():
            break
        same[1:] += tied
    return order, same


def _first_of(values: np.ndarray) -> np.ndarray:
    """For each value the place where it stands first."""
    codes, every = pd.factorize(values)
    first = np.empty(len(every), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return first[codes]


def _unequal(grid: np.ndarray, refs: np.ndarray) -> bool:
    """Whether some window that was matched differs in a byte from the one it was matched with; ``refs`` is (context, distance)."""
    some = refs >= 0
    head, tail = some.copy(), some.copy()
    head[:, 1:] &= refs[:, 1:] != refs[:, :-1]
    tail[:, :-1] &= refs[:, :-1] != refs[:, 1:]
    who, near = np.nonzero(head)
    far = np.nonzero(tail)[1]
    for lo in range(0, len(who), 8192):
        a, t0, t1 = who[lo : lo + 8192], near[lo : lo + 8192], far[lo : lo + 8192]
        differ = np.zeros((WIDE + 1, len(a)), np.int16)
        np.cumsum(grid[:, a] != grid[:, refs[a, t0]], axis=0, dtype=np.int16, out=differ[1:])
        each = np.arange(len(a))
        if (differ[SPAN - 1 - t0 + LENGTH, each] != differ[SPAN - 1 - t1, each]).any():
            return True
    return False


def repeats_in_range(
    doc: np.ndarray, first: np.ndarray, left: np.ndarray, size: np.ndarray, spread: np.ndarray, body: np.ndarray, by_bytes: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs (doc, first start, last start) of repeated windows, and (both hashes, doc, start) of open first windows of spread keys."""
    given = doc, first, left, size, spread, body
    none = np.zeros(0, np.int64)
    n = len(doc)
    order = np.lexsort((first + left, doc))
    offset = np.cumsum(size) - size
    doc, first, left, size, spread, offset = (x[order].astype(np.int64) if x.dtype != bool else x[order] for x in (doc, first, left, size, spread, offset))
    own = np.ones(n, bool)
    own[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1]) | (left[1:] != left[:-1]) | (size[1:] != size[:-1])
    if not own.all():
        doc, first, left, size, spread, offset = (x[own] for x in (doc, first, left, size, spread, offset))
        n = len(doc)
    grid = np.zeros((WIDE, n), np.uint8)
    for a in range(0, n, 4096):
        b = min(a + 4096, n)
        owner = np.repeat(np.arange(a, b), size[a:b])
        stop = np.cumsum(size[a:b])
        inner = np.arange(stop[-1]) - np.repeat(stop - size[a:b], size[a:b])
        grid[SPAN - 1 - left[owner] + inner, owner] = body[offset[owner] + inner]
    words = -(-LENGTH // 8)
    keys = np.zeros((n, words), np.uint64)
    for j in range(LENGTH):
        keys[:, j // 8] |= grid[SPAN - 1 + j].astype(np.uint64) << tb.U(56 - 8 * (j % 8))
    rank, same = multikey_order(keys)
    near = np.maximum(same, np.append(same[1:], 0))
    # a neighbour that shares k whole keys agrees on fewer than 8 bytes more
    reach = np.empty(n, np.int64)
    reach[rank] = np.minimum(near * 8 + 7, LENGTH)
    reach[spread] = LENGTH
    low = np.maximum(left - (size - LENGTH), LENGTH - reach)
    alive = np.flatnonzero((low <= left) & ((reach >= GRAM) | spread))
    if not len(alive):
        return none, none, none, (none, none, none)
    doc, first, left, low, spread, grid = doc[alive], first[alive], left[alive], low[alive], spread[alive], np.ascontiguousarray(grid[:, alive])
    value = tb.BYTE_VALUE
    other, dealt = tb.mix(tb.BYTE_VALUE), np.flatnonzero(spread)
    place = np.zeros(len(alive), np.int64)
    place[dealt] = np.arange(len(dealt))
    roll, roll2 = np.zeros(len(alive), np.uint64), np.zeros(len(dealt), np.uint64)
    for j in range(LENGTH - 1, -1, -1):
        roll = roll * tb.U(tb.BASE) + value[grid[SPAN - 1 + j]]
        roll2 = roll2 * tb.U(tb.BASE) + other[grid[SPAN - 1 + j, dealt]]
    top = tb.U(pow(tb.BASE, LENGTH, 1 << 64))
    again = np.zeros((SPAN + 2, len(alive)), bool)
    refs = np.full((len(alive), SPAN), -1, np.int32)
    opened = []
    for t in range(SPAN):
        if t:
            new, old = grid[SPAN - 1 - t], grid[SPAN - 1 - t + LENGTH]
            roll = roll * tb.U(tb.BASE) + value[new] - value[old] * top
            roll2 = roll2 * tb.U(tb.BASE) + other[new[dealt]] - other[old[dealt]] * top
        at = np.flatnonzero((low <= t) & (t <= left))
        if len(at):
            salt = tb.U(t * 0x2545F4914F6CDD1D & (1 << 64) - 1)
            hashed = tb.mix(roll[at] + salt)
            if by_bytes:
                windows = np.ascontiguousarray(grid[SPAN - 1 - t : SPAN - 1 - t + LENGTH, at].T).view(f"V{LENGTH}").ravel()
                _, head, group = np.unique(windows, return_index=True, return_inverse=True)
                ref = head[group]
            else:
                ref = _first_of(hashed)
            twin = ref != np.arange(len(at))
            again[t + 1, at] = twin
            refs[at[twin], t] = at[ref[twin]]
            lone = ~twin & spread[at]
            if lone.any():
                second = tb.mix(roll2[place[at[lone]]] + salt)
                key = np.ascontiguousarray(np.stack([hashed[lone], second], axis=1)).view("V16").ravel()
                opened.append((key, doc[at[lone]], first[at[lone]] + left[at[lone]] - t))
    if not by_bytes and _unequal(grid, refs):
        return repeats_in_range(*given, by_bytes=True)
    step = again[1:].astype(np.int8) - again[:-1].astype(np.int8)
    who, begin = np.nonzero(step.T == 1)
    _, end = np.nonzero(step.T == -1)
    base = first[who] + left[who]
    return doc[who], base - (end - 1), base - begin, tuple(np.concatenate(x) for x in zip(*opened, strict=True)) if opened else (none, none, none)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats of one range after the other. Rows come in order of bucket."""
    expand = zstandard.ZstdDecompressor().decompress
    for _, packs in _buckets(batches):
        columns = []
        for squeezed in packs:
            pack = expand(squeezed)
            n = int(np.frombuffer(pack, "<u4", 1)[0])
            columns.append((np.frombuffer(pack, "<i8", n, 4), np.frombuffer(pack, "<u4", n, 4 + 8 * n), np.frombuffer(pack, "u1", n, 4 + 12 * n), np.frombuffer(pack, "u1", n, 4 + 13 * n), np.frombuffer(pack, "?", n, 4 + 14 * n), np.frombuffer(pack, "u1", -1, 4 + 15 * n)))
        doc, first, left, size, spread, body = (np.concatenate(x) for x in zip(*columns, strict=True))
        del columns
        who, lo, hi, (key, odoc, start) = repeats_in_range(doc, first.astype(np.int64), left.astype(np.int64), size.astype(np.int64), spread, body)
        for d, a, b, keys in ((who, lo, hi, None), (odoc, start, start, key)):
            if len(d):
                told = pa.nulls(len(d), pa.binary()) if keys is None else pa.array(keys.tolist(), pa.binary())
                yield pa.RecordBatch.from_arrays([told, pa.array(d), pa.array(a), pa.array(b)], ["key", "doc_id", "lo", "hi"])


def with_shift(texts: DataFrame) -> DataFrame:
    """Adds ``shift``: where a row's text begins among the different texts of its doc_id, 0 where there is one."""
    body = F.coalesce("text", F.lit(""))
    marked = texts.withColumn("mark", F.xxhash64(body))
    several = marked.groupBy("doc_id").agg(F.min("mark").alias("least"), F.max("mark").alias("most")).filter("least < most").select("doc_id")
    several = cut(several)
    if several.isEmpty():
        return texts.withColumn("shift", F.lit(0).cast("long"))
    before = Window.partitionBy("doc_id").orderBy("body").rowsBetween(Window.unboundedPreceding, -1)
    once = marked.join(several, "doc_id", "left_semi").select("doc_id", "mark", body.alias("body")).distinct()
    shifts = cut(once.select("doc_id", "mark", F.coalesce(F.sum(F.octet_length("body")).over(before), F.lit(0)).cast("long").alias("shift")))
    return marked.join(shifts, ["doc_id", "mark"], "left").select("doc_id", "text", F.coalesce("shift", F.lit(0).cast("long")).alias("shift"))


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(doc_id, lo, hi): runs of starts of 100-byte windows that also start earlier. ``texts`` has doc_id, text and shift."""
    spark = prepare(texts.sparkSession)
    width = shuffle_width(spark)
    long_enough = texts.filter(F.octet_length("text") >= LENGTH)
    shared = cut(long_enough.mapInArrow(_send_anchors(width), PACKED).repartition(width, "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_keep_shared, PACKED))
    anchors_left = shared.filter(F.col("kind") == KNOWN).agg(F.sum(F.octet_length("pack"))).first()[0] or 0
    ranges = max(width, -(-anchors_left // (4 * RANGE)))
    # as many numbers as there are ranges
    shares = [i / ranges for i in range(1, ranges)]
    found = shared.filter(F.col("kind") == LEAD).agg(F.percentile_approx("lead", shares, max(10_000, 20 * ranges)).alias("s")).first()["s"] if shares else None
    release(spark)
    splitters = np.array(found or [], np.int64)
    wanted = shared.filter(F.col("kind") == KNOWN).groupBy("doc_id").agg(F.collect_list("pack").alias("packs"))
    contexts = long_enough.join(wanted, "doc_id").select("doc_id", "text", "shift", "packs").mapInArrow(_send_contexts(splitters), PACKED)
    del shared, wanted
    matched = cut(contexts.repartition(ranges, "bucket").sortWithinPartitions("bucket").mapInArrow(_match, "key binary, doc_id long, lo long, hi long"))
    del contexts
    release(spark)
    across = matched.filter("key is not null").select("key", "doc_id", "lo")
    least = across.groupBy("key").agg(F.min(F.struct("doc_id", "lo")).alias("least"))
    late = across.join(least, "key").filter(F.struct("doc_id", "lo") > F.col("least")).select("doc_id", "lo", F.col("lo").alias("hi"))
    return matched.filter("key is null").select("doc_id", "lo", "hi").union(late)


def _cut_out(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, gone, spans, digests, kept_bytes = batch.column("doc_id"), [], [], [], [], []
            for text, shift, los, his in zip(*(batch.column(n).to_pylist() for n in ("text", "shift", "lo", "hi")), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                n, removed, runs = len(raw), 0, 0
                if los:
                    starts, stops = np.array(los) - shift, np.array(his) - shift + LENGTH
                    own = (starts >= 0) & (stops <= n)
                    edge = np.zeros(n + 1, np.int32)
                    np.add.at(edge, starts[own], 1)
                    np.add.at(edge, stops[own], -1)
                    drop = np.cumsum(edge[:-1]) > 0
                    removed, runs = int(drop.sum()), int((drop & ~np.append(False, drop[:-1])).sum())
                    raw = np.frombuffer(raw, np.uint8)[~drop].tobytes()
                sizes.append(n)
                gone.append(removed)
                spans.append(runs)
                digests.append(hashlib.sha256(raw).hexdigest())
                if with_text:
                    kept_bytes.append(raw)
            out = [ids, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept_bytes, pa.binary())] * with_text, names + ["kept"] * with_text)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row for each document: sizes, removed bytes and runs, digest of what is left, and that itself if asked for (bytes: a cut may split a character)."""
    texts = with_shift(one_text_per_id(docs, id_col, text_col))
    runs = repeated_windows(texts.filter("doc_id is not null")).groupBy("doc_id").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return texts.join(runs, "doc_id", "left").select("doc_id", "text", "shift", "lo", "hi").mapInArrow(_cut_out(with_text), schema)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
