"""Alignment of two tokenisers: where both end a token, which ids overlap, and how usual that is in the corpus.

A text stands behind one space. Tokeniser A (a byte-level file of the
tokenizers library) encodes space + text; B (a sentencepiece model) encodes the
text and adds the space itself. Strings of special tokens are plain text to
both. Where the bytes of all tokens of either differ from space + text (as
where the text holds U+2581, which B reads as a space), the text counts as
having no tokens, and so do null and empty texts.

1. A whole slice of a batch is one array of bytes with an offset for each
   document. The ends of A's and B's tokens in it are counted once for each
   byte place (``np.bincount``). Places where both end cut the slice into
   groups; places where either ends are the links, as two partitions of the
   same bytes have one overlapping pair of tokens between each two neighbouring
   ends. Prefix sums over those counts, read at the documents' offsets, give
   the numbers of each document.
2. Documents are put together to sections. A section numbers its distinct id
   pairs; its documents keep (pair number, times). The section's pairs are dealt by
   hash over buckets, in packs of one bucket each, with the number of documents.
3. A bucket adds up the documents of each pair over all sections, sends the
   sums back to the sections, and tells the highest of each A id. These maxima
   are no more than A has ids.
4. Each section reads its sums and adds up, for each of its documents, the
   links at their A id's highest count and the counts of all links.

No pair has more than one entry for each section in its bucket, however usual
it is, so no bucket is hot. Rows are documents: repeated rows count one by one,
rows without doc_id count as well and keep their null. An empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import textbytes as tb
from palimpsest.llm.runtime import Tables, drop_caches, one_text_per_id, prepare, release, shuffle_width

#: Bytes of text of a slice, a longer document alone.
SLICE = 2 << 20
#: Entries (document, distinct pair) after which a section is closed.
SECTION = 3_000_000
#: Bytes of text for each bucket of pairs.
BUCKET = 48 << 20
SECTIONS = "kind int, section long, bucket int, pack binary"
DOCS, PAIRS, COUNTS, MOST = 0, 1, 2, 3
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

# ---------------------------------------------------------------- tokens


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Side:
    """The ids of one tokeniser for numbered segments."""

    def __init__(self):
        self.ids, self.start, self.size = tb.Growing(np.int32), tb.Growing(np.int64), tb.Growing(np.int64)

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.start.add(self.ids.n + np.cumsum(size) - size)
        self.size.add(size)
        self.ids.add(ids)

    def cut(self, segments: int, ids: int) -> None:
        self.ids.n, self.start.n, self.size.n = ids, segments, segments

    def of(self, segments: np.ndarray) -> np.ndarray:
        size = self.size[segments]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.start[segments] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Tokens:
    """The bytes of the ids of one tokeniser, one after the other."""

    def __init__(self, each: list[bytes]):
        self.each = each
        self.size = np.array(list(map(len, each)), np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(each), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _after_letter(data: np.ndarray) -> np.ndarray:
    """For each place whether the byte before ends a character that is no white space: ASCII, or one whose first byte begins no white space."""
    before = np.zeros(len(data) + 1, bool)
    before[1:] = (data > 32) & (data < 127)
    before[2:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF) & (data[1:] >= 0x80)
    before[3:] |= (data[:-2] >= 0xE4) & (data[:-2] <= 0xED) & (data[1:-1] >= 0x80)
    return before


class Tools:
    """Both tokenisers, the bytes of their tokens, and the segments that a worker remembers.

    A segment runs from a space to the next space that stands after something
    else than white space. A's pre-tokeniser starts a new piece there and B has
    no piece with a space after another character, so the ids of a text are
    those of its segments. With another kind of tokeniser, or a B that has such
    a piece, the segment is the text.
    """

    #: Segments that a worker remembers, bytes of the longest of them (so at most 45 M ids), and segments encoded as one text.
    KEEP, LONG, TOGETHER = 700_000, 64, 256

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size_a, size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        byte = _byte_level()
        tokens_a = [self.a.id_to_token(i) or "" for i in range(size_a)]
        each_a = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in tokens_a]
        pieces = [self.b.id_to_piece(i) for i in range(size_b)]
        each_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = Tokens(each_a), Tokens(each_b)
        plan = json.loads(self.a.to_str())
        pre = plan.get("pre_tokenizer") or {}
        own = not plan.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        self.space_b = self.b.piece_to_id("▁")
        crossing = any("▁" in p.lstrip("▁") for p in pieces) or not self.b.is_byte(self.b.piece_to_id("<0x0A>"))
        self.in_segments = own and not crossing and each_b[self.space_b] == b" "
        #: Decimal ids with each mark that may follow: A's in a group, A's last, B's in a group, B's last.
        self.decimal = pa.array([f"{i}{c}" for n, marks in ((size_a, ",|"), (size_b, ",;")) for i in range(n) for c in marks])
        self.shift_b = 2 * size_a
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sides = Side(), Side()
        self.right, self.again = tb.Growing(bool), tb.Growing(bool)

    def thin_out(self) -> None:
        """Forget the segments that were not met again since they were learnt, or since this was last done; all, if most were."""
        kept = [s for s, k in self.known.items() if self.again.held[k]]
        if len(kept) > 0.7 * self.KEEP:
            kept = []
        number = np.array([self.known[s] for s in kept], np.int64)
        held = [(side.of(number), side.size[number]) for side in self.sides]
        right = self.right[number]
        self.forget()
        self._add(kept, held, right)

    def _add(self, segments: list[bytes], held: list[tuple[np.ndarray, np.ndarray]], right: np.ndarray) -> None:
        first = self.right.n
        for side, (ids, size) in zip(self.sides, held, strict=True):
            side.add(ids, size)
        self.right.add(right)
        self.again.add(np.zeros(len(segments), bool))
        self.known.update(zip(segments, range(first, first + len(segments)), strict=True))

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B; each text begins with a space."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # an empty text gets no space from B
        return ids_a, [x or [self.space_b] for x in self.b.encode([t[1:] for t in texts], num_threads=1)]

    def _learn(self, segments: list[bytes]) -> None:
        """Ids of new segments. Those that end in a letter may stand one behind the other in one text."""
        if not self.in_segments:
            return self._learn_each(segments)
        safe = _after_letter(np.frombuffer(b"".join(segments), np.uint8))[np.cumsum([0, *map(len, segments)])][1:].tolist()
        self._learn_each([s for s, k in zip(segments, safe, strict=True) if not k])
        some = [s for s, k in zip(segments, safe, strict=True) if k]
        parts = [some[lo : lo + self.TOGETHER] for lo in range(0, len(some), self.TOGETHER)]
        texts = [b"".join(p) for p in parts]
        for part, text, *ids in zip(parts, texts, *self._ids([t.decode("utf-8", "replace") for t in texts]), strict=True):
            bounds = np.cumsum(list(map(len, part)))
            raw, held = np.frombuffer(text, np.uint8), []
            for one, tokens in zip(ids, (self.bytes_a, self.bytes_b), strict=True):
                one = np.array(one, np.int32)
                ends = np.cumsum(tokens.size[one])
                at = np.searchsorted(ends, bounds)
                if ends[-1] == len(raw) and (ends[at] == bounds).all() and np.array_equal(tokens.joined(one), raw):
                    held.append((one, np.diff(at + 1, prepend=0)))
            if len(held) == 2:
                self._add(part, held, np.ones(len(part), bool))
            else:
                self._learn_each(part)

    def _learn_each(self, segments: list[bytes]) -> None:
        if not segments:
            return
        found = self._ids([s.decode("utf-8", "replace") for s in segments])
        held = [(np.fromiter(chain.from_iterable(x), np.int32), np.array(list(map(len, x)), np.int64)) for x in found]
        told = [[b"".join(map(tokens.each.__getitem__, one)) for one in x] for x, tokens in zip(found, (self.bytes_a, self.bytes_b), strict=True)]
        self._add(segments, held, np.array([a == s == b for s, a, b in zip(segments, *told, strict=True)], bool))

    def numbers(self, segments: pa.Array) -> tuple[np.ndarray, tuple[int, ...]]:
        """The number of each segment, and how much of what is held now stays after the slice: long segments go."""
        if len(self.known) > self.KEEP:
            self.thin_out()
        told = segments.dictionary_encode()
        bounds, raw = np.frombuffer(told.dictionary.buffers()[1], np.int64, len(told.dictionary) + 1), told.dictionary.buffers()[2]
        bounds, raw = bounds.tolist(), raw.to_pybytes() if raw else b""
        distinct = [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        number = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(number < 0)
        self.again.held[number[number >= 0]] = True
        new = [distinct[i] for i in fresh.tolist()]
        long_ = [s for s in new if len(s) > self.LONG]
        self._learn([s for s in new if len(s) <= self.LONG])
        stay = self.right.n, self.sides[0].ids.n, self.sides[1].ids.n
        self._learn(long_)
        number[fresh] = list(map(self.known.__getitem__, new))
        for s in long_:
            del self.known[s]
        return number[told.indices.to_numpy()], stay

    def trim(self, stay: tuple[int, ...]) -> None:
        self.right.n = self.again.n = stay[0]
        self.sides[0].cut(stay[0], stay[1])
        self.sides[1].cut(stay[0], stay[2])


@lru_cache(maxsize=2)
def tools(path_a: str, path_b: str) -> Tools:
    return Tools(path_a, path_b)


def paths(a: str | None = None, b: str | None = None) -> tuple[str, str]:
    """The files of both tokenisers; those of the public ones where none is given."""
    import public_tokenizers

    return a or str(public_tokenizers.path("byte_bpe_50k.json")), b or str(public_tokenizers.path("piece_bpe_32k.model"))


# ---------------------------------------------------------------- one slice


def _segments(data: np.ndarray, off: np.ndarray, whole: bool) -> tuple[pa.Array, np.ndarray]:
    """Segments of a slice, and the number of the first segment of each document."""
    n = len(data)
    starts = off[:-1]
    if not whole and n:
        head = (data == 32) & _after_letter(data)[:-1]
        head[starts] = True
        starts = np.flatnonzero(head)
    bounds = np.append(starts, n).astype(np.int64)
    segments = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return segments, np.searchsorted(starts, off)


class Aligned:
    """A slice of non-empty documents: ids of A and B, ends, groups and links, all over the bytes of the slice."""

    def __init__(self, texts: pa.Array, tool: Tools):
        data, off = tb.utf8(pc.binary_join_element_wise("", texts, " "))
        data, off = data[off[0] : off[-1]], off - off[0]
        segments, first = _segments(data, off, not tool.in_segments)
        number, stay = tool.numbers(segments)
        right = np.logical_and.reduceat(tool.right[number], first[:-1]) if len(off) > 1 else np.zeros(0, bool)
        side_a, side_b = tool.sides
        for d in np.flatnonzero(~right):
            # the bytes of the text decide, not those of its segments
            own, want = number[first[d] : first[d + 1]], data[off[d] : off[d + 1]].tobytes()
            right[d] = all(t.joined(s.of(own)).tobytes() == want for s, t in ((side_a, tool.bytes_a), (side_b, tool.bytes_b)))
        #: Which documents have tokens; the arrays below are of these.
        self.right = right
        number = number[np.repeat(right, np.diff(first))]
        self.off = np.concatenate([[0], np.cumsum(np.diff(off)[right])])
        n = int(self.off[-1])
        self.a, self.b = side_a.of(number), side_b.of(number)
        tool.trim(stay)
        self.tool = tool
        self.ends_a, self.ends_b = np.cumsum(tool.bytes_a.size[self.a]), np.cumsum(tool.bytes_b.size[self.b])
        at_a, at_b = np.bincount(self.ends_a, minlength=n + 1), np.bincount(self.ends_b, minlength=n + 1)
        self.cut = (at_a > 0) & (at_b > 0)
        either = (at_a > 0) | (at_b > 0)
        # how many end up to each place
        self.upto_a, self.upto_b = np.cumsum(at_a), np.cumsum(at_b)
        self.upto_cut, upto_link = np.cumsum(self.cut), np.cumsum(either)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.diff(x[self.off]) for x in (self.upto_a, self.upto_b, self.upto_cut, upto_link))
        place = np.flatnonzero(either)
        #: Of each link the numbers of its tokens: those that hold the byte before the end.
        self.link_a, self.link_b = self.upto_a[place - 1], self.upto_b[place - 1]

    def pairs(self) -> np.ndarray:
        """A id and B id of each link in one number."""
        return self.a[self.link_a].astype(np.int64) << 32 | self.b[self.link_b]

    def groups(self) -> tuple[np.ndarray, memoryview]:
        """``a1,a2|b1;a3|b2,b3;`` of all documents one after the other: where each begins, and the bytes."""
        edge = np.concatenate([[0], np.flatnonzero(self.cut)])
        items = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = self.cut[self.ends_a], self.cut[self.ends_b]
        group_a, group_b = self.upto_cut[self.ends_a - 1], self.upto_cut[self.ends_b - 1]
        items[np.arange(len(self.a)) + self.upto_b[edge[group_a]]] = 2 * self.a.astype(np.int64) + last_a
        items[np.arange(len(self.b)) + self.upto_a[edge[group_b + 1]]] = self.tool.shift_b + 2 * self.b.astype(np.int64) + last_b
        text = self.tool.decimal.take(pa.array(items))
        begin = np.frombuffer(text.buffers()[1], np.int32, len(items) + 1) if len(items) else np.zeros(1, np.int32)
        return begin[self.upto_a[self.off] + self.upto_b[self.off]], memoryview(text.buffers()[2] or b"")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``SLICE`` bytes of text together, a longer row alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _with_text(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(pc.greater(pc.binary_length(batch.column("text")), 0), False).to_numpy(zero_copy_only=False)


# ---------------------------------------------------------------- sections


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, all low bytes first: small numbers compress well so."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes | memoryview, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()


def _record(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kind, section, bucket, pack = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(section, pa.int64()), pa.array(bucket, pa.int32()), pa.array(pack, pa.binary())], ["kind", "section", "bucket", "pack"])


class Section:
    """Documents of one task until it is closed."""

    def __init__(self):
        self.docs: list[tuple[np.ndarray, ...]] = []
        self.digests: list[bytes] = []
        self.entries: list[tuple[np.ndarray, ...]] = []
        self.pairs: list[np.ndarray] = []
        self.n = 0

    def add(self, batch: pa.RecordBatch, tool: Tools) -> None:
        some = _with_text(batch)
        ids, absent = pc.fill_null(batch.column("doc_id"), 0).to_numpy(), ~batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        numbers = np.zeros((5, len(batch)), np.int64)
        digest = np.zeros((len(batch), 32), np.uint8)
        if some.any():
            found = Aligned(batch.column("text").filter(pa.array(some)), tool)
            at = np.flatnonzero(some)[found.right]
            numbers[0, at], numbers[1, at], numbers[2, at], numbers[3, at] = found.n_a, found.n_b, found.n_groups, found.n_links
            begin, raw = found.groups()
            digest[at] = [np.frombuffer(hashlib.sha256(raw[a : b - 1]).digest(), np.uint8) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)] or np.zeros((0, 32), np.uint8)
            code, pairs = pd.factorize(found.pairs())
            doc = np.repeat(np.arange(len(at)), found.n_links)
            both, times = np.unique(doc * len(pairs) + code, return_counts=True)
            numbers[4, at] = np.bincount(both // max(1, len(pairs)), minlength=len(at))
            self.entries.append((both % max(1, len(pairs)), times))
            self.pairs.append(pairs)
            self.n += len(both)
        self.docs.append((ids, absent, *numbers))
        self.digests.append(digest.tobytes())

    def close(self, section: int, buckets: int) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        ids, absent, n_a, n_b, n_groups, n_links, n_entries = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        every = np.concatenate([np.zeros(0, np.int64), *self.pairs])
        pairs, which = np.unique(every, return_inverse=True)
        bucket = (tb.mix(pairs.astype(np.uint64)) % tb.U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # numbers of pairs in order of (bucket, pair), ascending within each document
        shift = np.cumsum([0, *map(len, self.pairs)])
        number = np.concatenate([np.zeros(0, np.int64), *(rank[which[s + e]] for s, (e, _) in zip(shift, self.entries, strict=False))])
        times = np.concatenate([np.zeros(0, np.int64), *(t for _, t in self.entries)])
        owner = np.repeat(np.arange(len(ids)), n_entries)
        ranked = np.lexsort((number, owner))
        number, times = number[ranked], times[ranked]
        n_docs = np.bincount(number, minlength=len(pairs))
        step = np.diff(number, prepend=0)
        head = np.cumsum(n_entries)[:-1][n_entries[1:] > 0]
        step[head] = number[head]
        sizes = np.array([len(ids), len(number), len(pairs)], "<i8")
        parts = (sizes, ids.astype("<i8"), absent.astype("u1"), n_a.astype("<i8"), n_b.astype("<i8"), n_groups.astype("<i8"), n_links.astype("<i8"), n_entries.astype("<i8"))
        body = b"".join(x.tobytes() for x in parts) + _planes(step) + _planes(times) + b"".join(self.digests)
        yield _record([(DOCS, section, 0, squeeze(body))])
        pairs, bucket, n_docs = pairs[order], bucket[order], n_docs.astype(np.int64)
        used, begin = np.unique(bucket, return_index=True)
        for lo in range(0, len(used), 1024):
            rows = []
            for k, a, b in zip(used[lo : lo + 1024].tolist(), begin[lo : lo + 1024].tolist(), [*begin[1:], len(pairs)][lo : lo + 1024], strict=True):
                high, low = (pairs[a:b] >> 32), pairs[a:b] & 0xFFFFFFFF
                rows.append((PAIRS, section, k, squeeze(np.int64(b - a).tobytes() + _planes(np.diff(high, prepend=0)) + _planes(low) + _planes(n_docs[a:b]))))
            yield _record(rows)


def _send(path_a: str, path_b: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        drop_caches()
        tool, part, seq, held = tools(path_a, path_b), TaskContext.get().partitionId(), 0, Section()
        for batch in batches:
            for some in _slices(batch):
                held.add(some, tool)
                if held.n > SECTION:
                    yield from held.close(part << 32 | seq, buckets)
                    seq, held = seq + 1, Section()
        if held.docs:
            yield from held.close(part << 32 | seq, buckets)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each pair over all sections. Rows come in order of bucket."""
    expand, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress

    def close(bucket: int, held: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        code, pairs = pd.factorize(np.concatenate([p for _, p, _ in held]))
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, code, np.concatenate([n for _, _, n in held]))
        lo = 0
        for section, own, _ in held:
            n = len(own)
            yield _record([(COUNTS, section, bucket, squeeze(np.int64(n).tobytes() + _planes(np.diff(own >> 32, prepend=0)) + total[code[lo : lo + n]].astype("<i8").tobytes()))])
            lo += n
        a = pairs >> 32
        order = np.lexsort((total, a))
        last = np.append(a[order][1:] != a[order][:-1], True)
        most = np.stack([a[order][last], total[order][last]])
        yield _record([(MOST, -1, bucket, most.astype("<i8").tobytes())])

    at, held = None, []
    for batch in batches:
        for section, bucket, pack in zip(*(batch.column(c) for c in ("section", "bucket", "pack")), strict=True):
            if bucket.as_py() != at and held:
                yield from close(at, held)
                held = []
            at, raw = bucket.as_py(), expand(pack.as_buffer())
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            high, low, docs = (_from_planes(raw[8 + 4 * n * i : 8 + 4 * n * (i + 1)], n).astype(np.int64) for i in range(3))
            held.append((section.as_py(), np.cumsum(high) << 32 | low, docs))
    if held:
        yield from close(at, held)


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack in batch.column("pack"):
            a, most = np.frombuffer(pack.as_buffer(), "<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(most)], ["a", "most"])


def _per_document(body: bytes) -> tuple[np.ndarray, ...]:
    """A section's documents: ids, which have none, their five numbers, their entries as (pair number, times), and their digests."""
    n, entries, _ = np.frombuffer(body, "<i8", 3).tolist()
    ids, absent = np.frombuffer(body, "<i8", n, 24), np.frombuffer(body, "u1", n, 24 + 8 * n).astype(bool)
    numbers = np.frombuffer(body, "<i8", 5 * n, 24 + 9 * n).reshape(5, n)
    at = 24 + 49 * n
    step, times = (_from_planes(memoryview(body)[at + 4 * entries * i : at + 4 * entries * (i + 1)], entries).astype(np.int64) for i in range(2))
    size = numbers[4][numbers[4] > 0]
    first = np.cumsum(size) - size
    number = np.cumsum(step)
    # steps begin anew with each document
    number -= np.repeat(number[first] - step[first], size)
    return ids, absent, numbers, number, times, np.frombuffer(body, np.uint8, 32 * n, at + 8 * entries).reshape(n, 32)


def _finish(most: np.ndarray):
    """``most`` is the highest count of each A id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for pack, packs in zip(batch.column("pack"), batch.column("packs"), strict=True):
                ids, absent, numbers, number, times, digests = _per_document(expand(pack.as_buffer()))
                sums, best = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
                for one in sorted(packs.as_py() or [], key=lambda x: x["bucket"]):
                    raw = expand(one["pack"])
                    n = int(np.frombuffer(raw, "<i8", 1)[0])
                    sums.append(np.frombuffer(raw, "<i8", n, 8 + 4 * n))
                    best.append(sums[-1] == most[np.cumsum(_from_planes(raw[8 : 8 + 4 * n], n).astype(np.int64))])
                sums, best = np.concatenate(sums), np.concatenate(best)
                some = numbers[4] > 0
                n_best, count_sum = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                if some.any():
                    first = (np.cumsum(numbers[4]) - numbers[4])[some]
                    n_best[some] = np.add.reduceat(times * best[number], first)
                    count_sum[some] = np.add.reduceat(times * sums[number], first)
                told = [d.tobytes().hex() if k else "" for d, k in zip(digests, numbers[0] > 0, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=absent), *map(pa.array, (*numbers[:4], n_best, count_sum)), pa.array(told, pa.string())], [c.split()[0] for c in ALIGNED.split(", ")])

    return run


# ---------------------------------------------------------------- operators


def _sections(docs: DataFrame, path_a: str, path_b: str, tables: Tables) -> DataFrame:
    """Documents (kind 0) and packs of pairs (kind 1) of all sections, written."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_width(docs.sparkSession), -(-size // BUCKET))
    return tables.put("sections", docs.mapInArrow(_send(path_a, path_b, buckets), SECTIONS), by="kind")


def _summed(sections: DataFrame, tables: Tables) -> DataFrame:
    """For each section and bucket the counts of its pairs (kind 2), and for each bucket the highest of each A id (kind 3), written."""
    packs = sections.filter(F.col("kind") == PAIRS).select("section", "bucket", "pack")
    buckets = (packs.agg(F.max("bucket")).first()[0] or 0) + 1
    return tables.put("sums", packs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_add_up, SECTIONS), by="kind")


def link_statistics(docs: DataFrame, tokenizer_a: str | None = None, model_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: tokens of A and of B, groups, links, links at the highest count of their A id, the sum of counts, and the digest of its groups."""
    spark = prepare(docs.sparkSession)
    a, b = paths(tokenizer_a, model_b)
    tables = Tables(spark, "aligned")
    sections = _sections(one_text_per_id(docs, id_col, text_col), a, b, tables)
    sums = _summed(sections, tables)
    release(spark)
    highest = sums.filter(F.col("kind") == MOST).select("pack").mapInArrow(_highest, "a long, most long").groupBy("a").agg(F.max("most").alias("most"))
    found = highest.collect()  # no more rows than A has ids
    most = np.zeros(max((r["a"] for r in found), default=0) + 1, np.int64)
    most[[r["a"] for r in found]] = [r["most"] for r in found]
    back = sums.filter(F.col("kind") == COUNTS).groupBy("section").agg(F.collect_list(F.struct("bucket", "pack")).alias("packs"))
    whole = sections.filter(F.col("kind") == DOCS).select("section", "pack").join(back.hint("merge"), "section", "left")
    return whole.select("pack", "packs").mapInArrow(_finish(most), ALIGNED)


def link_counts(docs: DataFrame, tokenizer_a: str | None = None, model_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, docs): in how many documents a token a of A overlaps a token b of B."""
    a, b = paths(tokenizer_a, model_b)
    prepare(docs.sparkSession)
    return one_text_per_id(docs, id_col, text_col).mapInArrow(_pairs_of(a, b), "a int, b int, docs long").groupBy("a", "b").agg(F.sum("docs").alias("docs"))


def _pairs_of(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tools(path_a, path_b)
        for batch in batches:
            for some in _slices(batch):
                texts = some.column("text").filter(pa.array(_with_text(some)))
                if len(texts):
                    found = Aligned(texts, tool)
                    code, pairs = pd.factorize(found.pairs())
                    doc = np.repeat(np.arange(len(found.n_links)), found.n_links)
                    n = np.bincount(np.unique(doc * len(pairs) + code) % max(1, len(pairs)), minlength=len(pairs))
                    yield pa.RecordBatch.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], ["a", "b", "docs"])

    return run


def alignments(docs: DataFrame, tokenizer_a: str | None = None, model_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ids of A, ids of B, and for each group the byte after its end and how many tokens of either end up to there. Offsets count the space before the text."""
    a, b = paths(tokenizer_a, model_b)
    prepare(docs.sparkSession)
    return one_text_per_id(docs, id_col, text_col).mapInArrow(_aligned(a, b), "doc_id long, a_ids array<int>, b_ids array<int>, group_ends array<long>, group_a array<long>, group_b array<long>")


def _aligned(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tools(path_a, path_b)
        for batch in batches:
            for some in _slices(batch):
                has = _with_text(some)
                lists = [[[] for _ in range(len(some))] for _ in range(5)]
                if has.any():
                    found = Aligned(some.column("text").filter(pa.array(has)), tool)
                    ends, lo_a, lo_b = np.flatnonzero(found.cut), found.upto_a[found.off], found.upto_b[found.off]
                    lo_g = found.upto_cut[found.off]
                    for k, at in enumerate(np.flatnonzero(has)[found.right].tolist()):
                        own = ends[lo_g[k] : lo_g[k + 1]]
                        one = found.a[lo_a[k] : lo_a[k + 1]], found.b[lo_b[k] : lo_b[k + 1]], own - found.off[k], found.upto_a[own] - lo_a[k], found.upto_b[own] - lo_b[k]
                        for held, value in zip(lists, one, strict=True):
                            held[at] = value
                kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *(pa.array(x, pa.list_(k)) for x, k in zip(lists, kinds, strict=True))], ["doc_id", "a_ids", "b_ids", "group_ends", "group_a", "group_b"])

    return run


def op11_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    return link_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet"))
