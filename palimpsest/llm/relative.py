"""Removal of repeated word passages by relative Lempel-Ziv parsing against reference blocks.

A window is ``WINDOW`` (35) consecutive words of one document, words being
``[^\\x20\\x09-\\x0D]+``. A word goes if a window over it has a word sequence that
also starts anywhere else, in the same document or another. All copies go.
Windows are judged on the input.

Of the word 8-grams of a window the one of least hash is its anchor, which
depends on the window's words alone: equal windows have equal anchors at equal
distance. An anchor's context, the words of all windows that it is the anchor
of (at most 62), is what is parsed, and a context can only share a window with
a context of the same gram. So a reference block holds all contexts of some
grams, and a document is parsed against every block that can hold a factor of
35 words of it, piece by piece.

1. Documents are packed to shelves, compressed. A shelf sends each distinct
   gram with its number of anchors to a bucket by hash; grams with two anchors
   and more come back to their shelves.
2. Shelves send the contexts of those grams to the reference blocks. Equal
   contexts of a shelf are sent once; as their windows repeat, all of them are
   decided there.
3. A block joins equal contexts and sorts the others by gram and words: its
   index. Each context is parsed greedily from its first word: a factor is the
   longest match with any other context of the block. Windows within a factor
   repeat. Windows over a factor's end lie in no factor; each is looked up in
   the index. Where no factor of 35 words begins, parsing goes on at the next word.
4. A gram with more than ``HOT`` anchors is spread over several blocks. What is
   no repeat in its own block is compared across them by two 64-bit hashes.
5. A document's repeated windows are united and cut out of its words.

Rows are documents: repeated rows repeat each other. Null text has no words.
Rows without doc_id take part and keep their null. Texts of any length work, a
document's words being in memory at once. An empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import textbytes as tb
from palimpsest.llm.runtime import Tables, drop_caches, one_text_per_id, prepare, release, shuffle_width

WINDOW = 35
GRAM = 8
SPAN = WINDOW - GRAM + 1
#: Words of the longest context; its anchor then stands in column SPAN - 1.
WIDE = WINDOW + SPAN - 1
#: Bytes of text of a shelf, a longer document alone.
SHELF = 2 << 20
#: Words that get their anchors at once; a place among them takes 20 bits.
PIECE = 1 << 19
#: Bytes of text for each bucket of grams, contexts of a block, and anchors above which a gram is spread.
BUCKET, BLOCK, HOT = 64 << 20, 30_000, 20_000
ROWS = "kind int, shelf long, bucket int, pack binary"
SHELVES, GRAMS, SHARED, TOTAL, CONTEXTS, RUNS, OPEN = range(7)

# ---------------------------------------------------------------- words and anchors


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, a stretch of text at a time."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + (1 << 20), "right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        out[lo:hi] = tb.span_hashes(tb.prefix(data[a:b]), starts[lo:hi] - a, ends[lo:hi] - a)
        lo = hi
    return out


def _grams(words: np.ndarray) -> np.ndarray:
    up, down = tb.powers(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, dtype=np.uint64, out=sums[1:])
    n = len(words) - GRAM + 1
    return tb.mix((sums[GRAM:] - sums[:n]) * down[:n])


def anchors(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, first and last window start, and gram hash of each anchor; ``row`` is the document of each word."""
    found = []
    for s in range(0, max(0, len(words) - WINDOW + 1), PIECE):
        own, rows = words[s : s + PIECE + WINDOW - 1], row[s : s + PIECE + WINDOW - 1]
        n = len(own) - WINDOW + 1
        at = np.flatnonzero(rows[:n] == rows[WINDOW - 1 :])
        if not len(at):
            continue
        grams = _grams(own)
        low = tb.slide_min(grams & ~tb.U(0xFFFFF) | np.arange(len(grams), dtype=np.uint64), SPAN)
        pos = (low[at] & tb.U(0xFFFFF)).astype(np.int64)
        head = np.flatnonzero(np.append(True, (pos[1:] != pos[:-1]) | (at[1:] != at[:-1] + 1)))
        tail = np.append(head[1:], len(at)) - 1
        found.append((pos[head] + s, at[head] + s, at[tail] + s, grams[pos[head]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Words:
    """The words of some texts, and the same texts with one space between words."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.starts, self.ends, self.row = tb.words(data, off)
        self.hash = word_hashes(data, self.starts, self.ends)
        self.first = np.searchsorted(self.row, np.arange(len(off)))
        gap = tb.SPACE[data]
        keep = ~gap
        keep[1:] |= keep[:-1].copy()
        self.plain = np.where(gap, np.uint8(32), data)[keep].tobytes()
        upto = np.cumsum(keep)
        #: Begin and end of each word in ``plain``.
        self.begin, self.end = upto[self.starts] - 1, upto[self.ends - 1]


# ---------------------------------------------------------------- packs


def _record(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kind, shelf, bucket, pack = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(shelf, pa.int64()), pa.array(bucket, pa.int32()), pa.array(pack, pa.binary())], ["kind", "shelf", "bucket", "pack"])


def _joined(*parts: np.ndarray) -> bytes:
    """Arrays of one length, that length first."""
    return np.int64(len(parts[0])).tobytes() + b"".join(x.tobytes() for x in parts)


def _parted(raw: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def _squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _expanded(raw) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """(kind, shelf, pack) of one bucket after the other, as rows come in order of bucket."""
    at, held = None, []
    for batch in batches:
        for kind, shelf, bucket, pack in zip(*(batch.column(c).to_pylist() for c in ("kind", "shelf", "bucket", "pack")), strict=True):
            if bucket != at and held:
                yield at, held
                held = []
            at = bucket
            held.append((kind, shelf, pack))
    if held:
        yield at, held


def _by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with the places where it stands."""
    order = np.argsort(key, kind="stable")
    used, begin = np.unique(key[order], return_index=True)
    yield from zip(used.tolist(), np.split(order, begin[1:]), strict=True) if len(key) else ()


def _runs(shelf: int, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, int, bytes]:
    """Runs of repeated windows of a shelf's documents, by the numbers of their first words."""
    return RUNS, shelf, 0, _squeezed(_joined(row.astype("<u4"), lo.astype("<u4"), hi.astype("<u4")))


# ---------------------------------------------------------------- shelves and shared grams


def _shelve(buckets: int):
    def close(shelf: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.chunked_array([b.column("text") for b in held]).combine_chunks()
        ids = pa.chunked_array([b.column("doc_id") for b in held]).combine_chunks()
        data, off = tb.utf8(texts)
        data, off = data[off[0] : off[-1]], off - off[0]
        head = _joined(pc.fill_null(ids, 0).to_numpy().astype("<i8"), ids.is_valid().to_numpy(zero_copy_only=False).astype("u1"), np.diff(off).astype("<i8"))
        yield _record([(SHELVES, shelf, 0, _squeezed(head + data.tobytes()))])
        starts, ends, row = tb.words(data, off)
        gram, times = np.unique(anchors(word_hashes(data, starts, ends), row)[3], return_counts=True)
        rows = [(GRAMS, shelf, k, _squeezed(_joined(np.diff(gram[at], prepend=np.uint64(0)).astype("<u8"), times[at].astype("<u4")))) for k, at in _by(tb.mix(gram) % tb.U(buckets))]
        for lo in range(0, len(rows), 1024):
            yield _record(rows[lo : lo + 1024])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        drop_caches()
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            each = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, lo = np.cumsum(each), 0
            while lo < len(batch):
                room = (ends[lo - 1] if lo else 0) + SHELF - size
                hi = min(len(batch), int(np.searchsorted(ends, room, "right")))
                if hi == lo and not held:
                    hi = lo + 1
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
                    size += int(each[lo:hi].sum())
                if hi < len(batch):
                    yield from close(part << 32 | seq, held)
                    seq, held, size = seq + 1, [], 0
                lo = hi
        if held:
            yield from close(part << 32 | seq, held)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shelf and bucket the grams that have two anchors and more, and over how many blocks each is spread."""
    for bucket, held in _grouped(batches):
        parts = [_parted(_expanded(pack), "<u8", "<u4") for _, _, pack in held]
        code, grams = pd.factorize(np.concatenate([np.cumsum(g, dtype=np.uint64) for g, _ in parts]))
        total = np.bincount(code, np.concatenate([n for _, n in parts])).astype(np.int64)
        shared, lo, rows = total >= 2, 0, []
        for (_, shelf, _), (own, _) in zip(held, parts, strict=True):
            at = code[lo : lo + len(own)]
            at, lo = at[shared[at]], lo + len(own)
            if len(at):
                rows.append((SHARED, shelf, bucket, _squeezed(_joined(grams[at].astype("<u8"), -(-total[at] // HOT).astype("<u4")))))
        yield _record([*rows, (TOTAL, -1, bucket, _joined(np.array([total[shared].sum()], "<i8")))])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(_parted(p, "<i8")[0][0]) for p in batch.column("pack").to_pylist()], pa.int64())], ["n"])


# ---------------------------------------------------------------- contexts


def _opened(pack: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, which are given, bytes and offsets of a shelf's texts."""
    raw = _expanded(pack)
    ids, given, size = _parted(raw, "<i8", "u1", "<i8")
    return ids, given.astype(bool), np.frombuffer(raw, np.uint8, offset=8 + 17 * len(ids)), np.concatenate([[0], np.cumsum(size)])


def _send_contexts(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shelf, pack, packs in zip(*(batch.column(c) for c in ("shelf", "pack", "packs")), strict=True):
                yield from one(shelf.as_py(), pack.as_buffer(), packs.as_py())

    def one(shelf: int, pack, packs: list[bytes]) -> Iterator[pa.RecordBatch]:
        _, _, data, off = _opened(pack)
        text = Words(data, off)
        wanted, split = (np.concatenate(x) for x in zip(*(_parted(_expanded(p), "<u8", "<u4") for p in packs), strict=True))
        order = np.argsort(wanted)
        wanted, split = wanted[order], split[order]
        pos, first, last, gram = anchors(text.hash, text.row)
        at = np.searchsorted(wanted, gram)
        at[at == len(wanted)] = 0
        own = wanted[at] == gram
        pos, first, last, gram, split = pos[own], first[own], last[own], gram[own], split[at][own]
        row, left, size = text.row[pos], pos - first, last - first + WINDOW
        lo, hi = text.begin[first].tolist(), text.end[last + WINDOW - 1].tolist()
        # equal contexts of the shelf: the first is sent, and all are decided if there are several
        seen: dict[tuple[int, bytes], int] = {}
        bodies = [text.plain[a:b] for a, b in zip(lo, hi, strict=True)]
        which = np.fromiter((seen.setdefault(k, len(seen)) for k in zip(left.tolist(), bodies, strict=True)), np.int64, len(bodies))
        times = np.bincount(which, minlength=len(seen))
        decided = times[which] >= 2
        begin = first - text.first[row]
        if decided.any():
            yield _record([_runs(shelf, row[decided], begin[decided], (begin + last - first)[decided])])
        lead = np.full(len(seen), -1)
        lead[which[::-1]] = np.arange(len(which))[::-1]
        spread = tb.mix(tb.mix(np.full(len(lead), shelf, np.uint64)) + pos[lead].astype(np.uint64)) % np.maximum(split[lead], 1).astype(np.uint64)
        rows = []
        for block, k in _by((tb.mix(gram[lead]) + spread) % tb.U(blocks)):
            k = lead[k]
            some = [bodies[i] for i in k.tolist()]
            flags = decided[k].astype("u1") | (split[k] > 1).astype("u1") << 1
            head = _joined(gram[k].astype("<u8"), row[k].astype("<u4"), begin[k].astype("<u4"), left[k].astype("u1"), size[k].astype("u1"), flags, np.array(list(map(len, some)), "<u4"))
            rows.append((CONTEXTS, shelf, block, _squeezed(head + b"".join(some))))
        for a in range(0, len(rows), 256):
            yield _record(rows[a : a + 256])

    return run


# ---------------------------------------------------------------- parsing in a block


def parse(group: np.ndarray, left: np.ndarray, size: np.ndarray, words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which windows of each context repeat in another: (contexts, SPAN), by the distance of their start from the anchor.

    ``words`` has WIDE columns with the anchor's first word in column SPAN - 1
    and anything outside the context; contexts differ. ``known`` ones are
    decided and only serve as reference.
    """
    n = len(group)
    repeat = np.zeros((n, SPAN), bool)
    right, nearest = size - left, WINDOW - (size - left)
    here = np.maximum(nearest, 0)
    # the words before the anchor as one number a distance: equal for equal gram and equal words
    column = np.arange(WIDE)
    blank = (column < SPAN - 1 - left[:, None]) | (column >= SPAN - 1 + right[:, None])
    words = np.where(blank, tb.U(0), words)
    before = np.empty((SPAN, n), np.int64)
    before[0] = pd.factorize(group)[0]
    for t in range(1, SPAN):
        code, each = pd.factorize(words[:, SPAN - 1 - t])
        before[t] = pd.factorize(before[t - 1] * len(each) + code)[0]
    # the index: contexts in order of the words from the anchor on
    order = np.lexsort(words[:, : SPAN - 2 : -1].T)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    after = np.ascontiguousarray(words[:, SPAN - 1 :])
    start = np.where(known, -1, left)
    for t in range(SPAN - 1, -1, -1):
        turn = (start == t) & (t >= here)
        if not turn.any():
            continue
        near = np.zeros(int(before[t].max()) + 1, bool)
        near[before[t][turn]] = True
        some = np.flatnonzero(near[before[t]] & (left >= t))
        some = some[np.lexsort((rank[some], before[t][some]))]
        a, b = some[:-1], some[1:]
        differ = after[a] != after[b]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), WINDOW)
        same = np.minimum(same, np.minimum(right[a], right[b]))
        same[before[t][a] != before[t][b]] = -WIDE
        longest = np.full(n, -WIDE)
        longest[b] = same
        longest[a] = np.maximum(longest[a], same)
        at = np.flatnonzero(turn)
        length = t + longest[at]
        long_ = length >= WINDOW
        ends = t - (length - WINDOW)
        for d in range(int(ends[long_].min()) if long_.any() else t + 1, t + 1):
            repeat[at[long_ & (ends <= d)], d] = True
        start[at] = np.where(long_, ends, t) - 1
    return repeat


def _matrix(bodies: list[bytes], left: np.ndarray) -> np.ndarray:
    """Word hashes of contexts, anchors in one column."""
    out = np.zeros((len(bodies), WIDE), np.uint64)
    for lo in range(0, len(bodies), 2048):
        some = bodies[lo : lo + 2048]
        off = np.cumsum([0, *map(len, some)])
        data = np.frombuffer(b"".join(some), np.uint8)
        starts, ends, row = tb.words(data, off)
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(some)))[row]
        out[lo + row, SPAN - 1 - left[lo + row] + place] = word_hashes(data, starts, ends)
    return out


def _open_windows(words: np.ndarray, left: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each distance the contexts that have a window there, and its two hashes in one value."""
    second = tb.mix(words ^ tb.U(tb.BASE))
    for t in range(SPAN):
        at = np.flatnonzero((t <= left) & (t >= WINDOW - (size - left)))
        if len(at):
            both = []
            for each in (words, second):
                rolled = np.zeros(len(at), np.uint64)
                for j in range(WINDOW):
                    rolled = tb.mix(rolled + each[at, SPAN - 1 - t + j] * tb.U(tb.BASE))
                both.append(rolled)
            yield t, at, np.ascontiguousarray(np.stack(both, axis=1)).view("V16").ravel()


def _parse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows of each block, and the windows of spread grams."""
    names = ["kind", "shelf", "bucket", "pack"]
    for bucket, held in _grouped(_passing(batches)):
        if bucket < 0:
            yield _record([(kind, shelf, 0, pack) for kind, shelf, pack in held])
            continue
        seen: dict[tuple[int, bytes], int] = {}
        bodies: list[bytes] = []
        parts = []
        for _, shelf, pack in held:
            raw = _expanded(pack)
            gram, row, begin, left, size, flags, length = _parted(raw, "<u8", "<u4", "<u4", "u1", "u1", "u1", "<u4")
            ends = 8 + 23 * len(gram) + np.cumsum(length.astype(np.int64))
            number = np.empty(len(gram), np.int64)
            for i, (a, b, where) in enumerate(zip((ends - length).tolist(), ends.tolist(), left.tolist(), strict=True)):
                body = raw[a:b]
                number[i] = k = seen.setdefault((where, body), len(seen))
                if k == len(bodies):
                    bodies.append(body)
            parts.append((number, np.full(len(gram), shelf), gram, row.astype(np.int64), begin.astype(np.int64), left.astype(np.int64), size.astype(np.int64), flags))
        del held
        number, shelf, gram, row, begin, left, size, flags = (np.concatenate(x) for x in zip(*parts, strict=True))
        lead = np.full(len(bodies), -1)
        lead[number[::-1]] = np.arange(len(number))[::-1]
        known = np.bincount(number, flags & 1, len(bodies)) + (np.bincount(number, minlength=len(bodies)) >= 2) > 0
        words = _matrix(bodies, left[lead])
        repeat = np.repeat(known[:, None], SPAN, axis=1)
        alone = np.bincount(pd.factorize(gram[lead])[0])[pd.factorize(gram[lead])[0]] == 1
        k = np.flatnonzero(~alone)
        if len(k):
            repeat[k] |= parse(gram[lead][k], left[lead][k], size[lead][k], words[k], known[k])
        # occurrences that their shelf has not decided
        todo = np.flatnonzero((flags & 1) == 0)
        valid = (np.arange(SPAN) <= left[todo][:, None]) & (np.arange(SPAN) >= (WINDOW - (size - left))[todo][:, None])
        mark = repeat[number[todo]] & valid
        edge = np.zeros((len(todo), SPAN + 2), np.int8)
        edge[:, 1:-1] = mark
        who, near = np.nonzero(np.diff(edge, axis=1) == 1)
        _, far = np.nonzero(np.diff(edge, axis=1) == -1)
        who = todo[who]
        pos = begin[who] + left[who]
        yield from (_record([_runs(s, row[who][at], (pos - far + 1)[at], (pos - near)[at])]) for s, at in _by(shelf[who]))
        hot = np.flatnonzero((flags[lead] & 2) > 0)
        if len(hot):
            for t, at, key in _open_windows(words[hot], left[lead][hot], size[lead][hot]):
                occurrence = lead[hot[at]]
                open_ = ~repeat[hot[at], t]
                _, one = np.unique(key, return_index=True)
                told = np.where(open_, row[occurrence], -1)[one]
                packed = np.stack([told, (begin + left)[occurrence][one] - t], axis=1).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), OPEN, np.int32)), pa.array(shelf[occurrence][one]), pa.array(np.zeros(len(one), np.int32)), pa.array([a.tobytes() + b.tobytes() for a, b in zip(key[one], packed, strict=True)], pa.binary())], names)


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as they come, none of them if there are none."""
    yield from (b for b in batches if len(b))


# ---------------------------------------------------------------- what is left


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for pack, packs in zip(batch.column("pack"), batch.column("packs"), strict=True):
            ids, given, data, off = _opened(pack.as_buffer())
            text = Words(data, off)
            n = len(text.starts)
            edge = np.zeros(n + 1, np.int64)
            for one in packs.as_py() or []:
                row, lo, hi = (x.astype(np.int64) for x in _parted(_expanded(one), "<u4", "<u4", "<u4"))
                np.add.at(edge, text.first[row] + lo, 1)
                np.add.at(edge, text.first[row] + hi + WINDOW, -1)
            gone = np.cumsum(edge[:n]) > 0
            n_words = np.diff(text.first)
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[text.first])
            spans, kept = [], []
            for d in range(len(ids)):
                a, b = int(text.first[d]), int(text.first[d + 1])
                if a == b or removed[d] == b - a:
                    kept.append(b"")
                elif not removed[d]:
                    kept.append(text.plain[text.begin[a] : text.end[b - 1]])
                else:
                    turns = np.flatnonzero(np.diff(np.concatenate([[True], gone[a:b], [True]]).astype(np.int8)))
                    kept.append(b" ".join(text.plain[text.begin[a + i] : text.end[a + j - 1]] for i, j in turns.reshape(-1, 2).tolist()))
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8))).reshape(-1, 2).tolist() if removed[d] else []
                spans.append([{"start": i, "end": j} for i, j in turns])
            columns = [pa.array(ids, mask=~given), pa.array(n_words), pa.array(removed.astype(np.int64)), pa.array(spans, kinds), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its words, how many go, the removed spans (numbers of the first word and of the word behind the last), and the words left, joined by one space."""
    spark = prepare(docs.sparkSession)
    texts, tables = one_text_per_id(docs, id_col, text_col), Tables(spark, "passages")
    bytes_ = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_width(spark), -(-bytes_ // BUCKET))
    stock = tables.put("shelves", texts.mapInArrow(_shelve(buckets), ROWS), by="kind")
    shelves = stock.filter(F.col("kind") == SHELVES).select("shelf", "pack")
    grams = stock.filter(F.col("kind") == GRAMS)
    shared = tables.put("shared", grams.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, ROWS), by="kind")
    contexts = shared.filter(F.col("kind") == TOTAL).select("pack").mapInArrow(_totals, "n long").agg(F.sum("n")).first()[0] or 0
    blocks = max(shuffle_width(spark), -(-contexts // BLOCK))
    release(spark)
    wanted = shared.filter(F.col("kind") == SHARED).groupBy("shelf").agg(F.collect_list("pack").alias("packs"))
    sent = shelves.join(wanted.hint("merge"), "shelf").mapInArrow(_send_contexts(blocks), ROWS)
    # what shelves have decided goes along, dealt by shelf
    dealt = sent.repartition(blocks, F.when(F.col("kind") == CONTEXTS, F.col("bucket")).otherwise(F.xxhash64("shelf") % blocks))
    block = F.when(F.col("kind") == CONTEXTS, F.col("bucket")).otherwise(F.lit(-1)).alias("bucket")
    found = tables.put("runs", dealt.select("kind", "shelf", block, "pack").sortWithinPartitions("bucket").mapInArrow(_parse_blocks, ROWS), by="kind")
    release(spark)
    runs = found.filter(F.col("kind") == RUNS).select("shelf", "pack").union(_across(found))
    told = runs.groupBy("shelf").agg(F.collect_list("pack").alias("packs"))
    return shelves.join(told.hint("merge"), "shelf", "left").mapInArrow(_keep, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")


def _across(found: DataFrame) -> DataFrame:
    """Runs of windows of spread grams that repeat in another block only."""
    windows = found.filter(F.col("kind") == OPEN).select("shelf", F.substring("pack", 1, 16).alias("key"), F.substring("pack", 17, 16).alias("place"))
    several = windows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return windows.join(several, "key", "left_semi").groupBy("shelf").agg(F.collect_list("place").alias("places")).mapInArrow(_as_runs, "shelf long, pack binary")


def _as_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packs = []
        for shelf, places in zip(batch.column("shelf").to_pylist(), batch.column("places").to_pylist(), strict=True):
            row, at = np.frombuffer(b"".join(places), "<i8").reshape(-1, 2).T
            packs.append(_runs(shelf, row[row >= 0], at[row >= 0], at[row >= 0])[3])
        yield pa.RecordBatch.from_arrays([batch.column("shelf"), pa.array(packs, pa.binary())], ["shelf", "pack"])


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
