"""Token ids in patched frame-of-reference blocks.

File format, one file ("shard") for a run of documents in ascending id order,
little-endian: the header (magic, version, block length, documents, tokens,
blocks, exceptions, documents without an id, which come first), then doc ids int64, tokens of each document int64, block
minima uint32, block widths uint8, exceptions of each block uint16, block
starts uint64 (index of the first packed word of each block), the packed words
uint64, exception positions uint16 and exception values uint32.

In a block the minimum is subtracted from all ids and the rest is packed at a
width w: of the widths that hold a given percentile of the block's values, the
one that makes the block smallest. Values that need more bits are stored whole
in the exception list; the packed field holds their low w bits. The last block
is filled up with its own last value.

Shards are written by Spark as rows of a table (``part``, ``seq``, counts,
``file`` = the bytes above), because a shard in a shared store must appear once
however often its task is tried. ``export_files`` puts them into plain files.

Null text counts as empty and yields the end id alone. Rows of equal doc_id are
all encoded, ordered by id and then text (null first); rows without a doc_id
come before all others in order of text, and their index rows have no doc_id.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.runtime import drop_caches, give_back, one_text_per_id, prepare, shared_dir, shuffle_width
from palimpsest.llm.textbytes import Growing

BLOCK = 128
PERCENTILES = (50, 75, 90, 95, 98, 100)
MAGIC = b"PFOR"
HEAD = struct.Struct("<4sHHQQQQQ")
#: Tokens after which a shard is closed; a document is never split.
SHARD_TOKENS = 1 << 20
END_ID = 0
SHARDS = "part int, seq long, n_docs long, n_tokens long, before long, file binary"
TABLE = "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"


#: Bits of each value below 2**16, made at first use.
_BITS: list[np.ndarray] = []

# ---------------------------------------------------------------- blocks


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width into rows of BLOCK * width / 64 words."""
    columns = np.ascontiguousarray(values.T)
    words = np.zeros((BLOCK * width // 64, values.shape[0]), np.uint64)
    for i in range(BLOCK):
        k, s = divmod(i * width, 64)
        words[k] |= columns[i] << np.uint64(s)
        if s + width > 64:
            words[k + 1] |= columns[i] >> np.uint64(64 - s)
    return np.ascontiguousarray(words.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    columns = np.ascontiguousarray(words.T)
    mask = np.uint64((1 << width) - 1)
    out = np.empty((BLOCK, words.shape[0]), np.uint64)
    for i in range(BLOCK):
        k, s = divmod(i * width, 64)
        v = columns[k] >> np.uint64(s)
        if s + width > 64:
            v = v | (columns[k + 1] << np.uint64(64 - s))
        out[i] = v & mask
    return np.ascontiguousarray(out.T)


def encode_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, missing: int = 0) -> bytes:
    """The file of a run of documents whose ids are given one after the other; the first ``missing`` have no doc id."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    flat = np.empty(blocks * BLOCK, np.uint32)
    flat[:n] = ids
    flat[n:] = ids[-1] if n else 0
    values = flat.reshape(blocks, BLOCK)
    low = values.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = values - low[:, None]
    if not _BITS:
        _BITS.append(np.repeat(np.arange(17), [1, *(1 << j for j in range(16))]).astype(np.uint8))
    high = rest >> 16
    bits = _BITS[0][rest & 0xFFFF] if not high.any() else np.where(high > 0, 16 + _BITS[0][high], _BITS[0][rest & 0xFFFF]).astype(np.uint8)
    width = np.zeros(blocks, np.uint8)
    if blocks:
        # values of each number of bits in each block, then of at most so many
        upto = np.bincount((np.arange(blocks)[:, None] * 33 + bits).ravel(), minlength=blocks * 33).reshape(blocks, 33).cumsum(axis=1)
        best = np.full(blocks, np.inf)
        for p in PERCENTILES:
            w = (upto < -(-BLOCK * p // 100)).sum(axis=1)
            cost = w * BLOCK + (BLOCK - upto[np.arange(blocks), w]) * 48
            better = cost < best
            best[better], width[better] = cost[better], w[better]
    outlier = bits > width[:, None]
    counts = outlier.sum(axis=1).astype(np.uint16)
    size = width.astype(np.uint64) * np.uint64(BLOCK // 64)
    starts = np.zeros(blocks, np.uint64)
    if blocks:
        np.cumsum(size[:-1], out=starts[1:])
    packed = np.zeros(int(size.sum()), np.uint64)
    for w in np.unique(width):
        if w:
            at = np.flatnonzero(width == w)
            mask = np.uint32((1 << int(w)) - 1)
            rows = _pack((rest[at] & mask).astype(np.uint64), int(w))
            packed[(starts[at][:, None] + np.arange(rows.shape[1], dtype=np.uint64)).ravel().astype(np.int64)] = rows.ravel()
    block, place = np.nonzero(outlier)
    head = HEAD.pack(MAGIC, 2, BLOCK, len(doc_ids), n, blocks, len(block), missing)
    parts = (doc_ids.astype("<i8"), lengths.astype("<i8"), low.astype("<u4"), width, counts.astype("<u2"), starts.astype("<u8"), packed.astype("<u8"), place.astype("<u2"), rest[block, place].astype("<u4"))
    return head + b"".join(x.tobytes() for x in parts)


def decode_shard(file: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Doc ids, tokens of each document, and all ids."""
    magic, version, block, docs, n, blocks, exceptions, _ = HEAD.unpack_from(file)
    if magic != MAGIC or version != 2 or block != BLOCK:
        raise ValueError("not a shard of this format")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(file, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, lengths, low, width, counts, starts = take("<i8", docs), take("<i8", docs), take("<u4", blocks), take("<u1", blocks), take("<u2", blocks), take("<u8", blocks)
    packed = take("<u8", int(width.astype(np.int64).sum()) * (BLOCK // 64))
    place, value = take("<u2", exceptions), take("<u4", exceptions)
    rest = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            words = packed[(starts[rows][:, None] + np.arange(int(w) * (BLOCK // 64), dtype=np.uint64)).astype(np.int64)]
            rest[rows] = _unpack(words, int(w))
    rest[np.repeat(np.arange(blocks), counts), place] = value
    return doc_ids, lengths, (rest + low[:, None]).ravel()[:n]


def without_id(file: bytes) -> int:
    """How many documents at the head of a shard have no doc id."""
    return HEAD.unpack_from(file)[-1]


def decode_block(file: bytes, block: int) -> np.ndarray:
    """The ids of one block, found by the index of block starts without reading the others."""
    _, _, _, docs, n, blocks, _, _ = HEAD.unpack_from(file)
    at = HEAD.size + 16 * docs
    low = np.frombuffer(file, "<u4", blocks, at)[block]
    width = np.frombuffer(file, "<u1", blocks, at := at + 4 * blocks)
    counts = np.frombuffer(file, "<u2", blocks, at := at + blocks)
    starts = np.frombuffer(file, "<u8", blocks, at := at + 2 * blocks)
    at += 8 * blocks
    w = int(width[block])
    rest = np.zeros(BLOCK, np.uint32)
    if w:
        rest[:] = _unpack(np.frombuffer(file, "<u8", w * (BLOCK // 64), at + 8 * int(starts[block]))[None], w)[0]
    at += 8 * int(width.astype(np.int64).sum()) * (BLOCK // 64)
    first, total = int(counts[:block].sum()), int(counts.sum())
    k = int(counts[block])
    rest[np.frombuffer(file, "<u2", k, at + 2 * first)] = np.frombuffer(file, "<u4", k, at + 2 * total + 4 * first)
    return (rest + low)[: max(0, n - block * BLOCK)]


# ---------------------------------------------------------------- encoding


class PieceEncoder:
    """Byte-level BPE by pieces between single spaces and line breaks, each distinct piece encoded by the library.

    The pre-tokeniser of these vocabularies never joins what lies before a
    single space with what follows, and puts that space before the next piece;
    a single line break is a token of its own, and so is what ends a word as a
    single mark. So where all white space of a text stands alone, its ids are
    those of the first piece, then for each piece those of " " + piece or of
    the line break and the piece. Any other text (adjacent white space, the
    string of an added token) is given to the library whole, and so is every
    text of a tokeniser of another kind.

    Texts are split and their pieces numbered by Arrow; only distinct pieces
    are looked up, and ids are gathered for all pieces of a slice at once.
    """

    #: White space, as any of the libraries counts it, other than space and line break.
    ODD = "".join(map(chr, [9, 11, 12, 13, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))
    ADJACENT = ("  ", " \n", "\n ", "\n\n")
    #: Marks that are split from the end of a word, and where they stand: after a Latin letter or a digit.
    MARKS = ".,;:!?$%&*#"
    MARKED = "[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f][.,;:!?$%&*#]$"
    #: Pieces that a worker remembers, code points of the longest of them, ids of all of them, and bytes of texts encoded at once.
    KEEP, LONG, IDS, SLICE = 350_000, 40, 6_000_000, 1 << 21

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        plan = json.loads(self.library.to_str())
        pre = plan.get("pre_tokenizer") or {}
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.by_piece = not plan.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and len(line) == 1
        self.line_id = line[0] if line else -1
        self.added = [x["content"] for x in plan.get("added_tokens") or [] if x.get("content")]
        self.whole = "|".join([f"[{self.ODD}]", *map(re.escape, (*self.ADJACENT, *self.added))])
        self.forget()

    def forget(self) -> None:
        """Start with no piece known. Piece k has the ids from ``start[k]`` on, ``size[k]`` of them; ``again`` tells if it was met again."""
        self.known: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.marks: dict[str, int] = {}
        self.ids, self.start, self.size, self.again = Growing(np.uint32), Growing(np.int64), Growing(np.int64), Growing(bool)
        ids = self._ids(list(self.MARKS))
        self._store(self.marks, list(self.MARKS), np.concatenate(ids), np.array([len(x) for x in ids]))

    def thin_out(self) -> None:
        """Forget the pieces that were not met again since they were learnt, or since this was last done; all, if most were."""
        kept = [p for p, k in self.known.items() if self.again.held[k]]
        numbers = np.array([self.known[p] for p in kept], np.int64)
        if len(kept) > self.KEEP * 0.7:
            kept, numbers = [], numbers[:0]
        ids, size = self._gather(self.start[numbers], self.size[numbers]), self.size[numbers]
        self.forget()
        self._store(self.known, kept, ids, size)
        give_back()

    def _odd(self, text: str) -> bool:
        return any(c in text for c in self.ODD)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, pieces: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lead + piece one after the other, and how many each has: many pieces to a text, one in a line."""
        every, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(pieces), 4096):
            some = pieces[lo : lo + 4096]
            text = lead + f"\n{lead}".join(some)
            if not self._odd(text):
                ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                breaks = np.flatnonzero(ids == self.line_id)
                if len(breaks) == len(some) - 1:
                    every.append(np.delete(ids, breaks))
                    sizes.append(np.diff(np.concatenate([[-1], breaks, [len(ids)]])) - 1)
                    continue
            found = self._ids([lead + s for s in some])
            every += found
            sizes.append(np.array([len(f) for f in found], np.int64))
        return np.concatenate(every), np.concatenate(sizes)

    def _store(self, known: dict[str, int], pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Number new pieces, whose ids are given one after the other."""
        first = self.start.n
        self.start.add(self.ids.n + np.cumsum(sizes) - sizes)
        self.ids.add(ids)
        self.size.add(sizes)
        self.again.add(np.zeros(len(sizes), bool))
        known.update(zip(pieces, range(first, first + len(pieces)), strict=True))

    def _gather(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of pieces, one after the other."""
        ends = np.cumsum(size)
        at = np.repeat((start - (ends - size)).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at]

    def _learn(self, pieces: list[str]) -> None:
        """Number new pieces; one that starts with a line break has no space before its word."""
        groups = (" ", [p for p in pieces if p and p[0] != "\n"]), ("", [p for p in pieces if p[:1] == "\n" and len(p) > 1])
        for lead, some in groups:
            ids, sizes = self._lines([p if lead else p[1:] for p in some], lead)
            if not lead:
                ids, sizes = np.insert(ids, np.cumsum(sizes) - sizes, self.line_id), sizes + 1
            self._store(self.known, some, ids, sizes)
        for p in ("", "\n"):
            if p in pieces:
                ids = self._ids([p or " "])[0]
                self._store(self.known, [p], ids, np.array([len(ids)]))

    def _numbers(self, stems: list[str], heads: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
        """The numbers of distinct stems and heads, and how many pieces and ids stay: what is longer than ``LONG`` is learnt last, for one slice."""
        todo = []
        for pieces, known, learn in ((stems, self.known, self._learn), (heads, self.heads, self._learn_heads)):
            number = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
            fresh = np.flatnonzero(number < 0)
            self.again.held[number[number >= 0]] = True
            new = [pieces[i] for i in fresh.tolist()]
            if short := sorted(p for p in new if len(p) <= self.LONG):
                learn(short)
            todo.append((known, learn, number, fresh, new))
        stay = self.start.n, self.ids.n
        for known, learn, number, fresh, new in todo:
            long_ = [p for p in new if len(p) > self.LONG]
            if long_:
                learn(long_)
            number[fresh] = list(map(known.__getitem__, new))
            for p in long_:
                del known[p]
        return todo[0][2], todo[1][2], stay

    def _learn_heads(self, heads: list[str]) -> None:
        found = self._ids(heads)
        self._store(self.heads, heads, np.concatenate(found), np.array([len(f) for f in found]))

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) + len(self.heads) > self.KEEP or self.ids.n > self.IDS:
            self.thin_out()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        off = split.offsets.to_numpy()
        numbered = pc.dictionary_encode(split.values)
        pieces, which = numbered.dictionary, numbered.indices.to_numpy()
        marked = pc.match_substring_regex(pieces, self.MARKED).to_numpy(zero_copy_only=False)
        mark = np.full(len(pieces), -1)
        mark[marked] = [self.marks[c] for c in pc.utf8_slice_codeunits(pieces.filter(pa.array(marked)), -1).to_pylist()]
        stems = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(pieces, 0, -1), pieces).to_pylist()
        # the first piece of a text has no space before it
        heads = pc.dictionary_encode(split.values.take(pa.array(off[:-1])))
        of_stems, of_heads, stay = self._numbers(stems, heads.dictionary.to_pylist())
        piece, mark = of_stems[which], mark[which]
        piece[off[:-1]] = of_heads[heads.indices.to_numpy()]
        mark[off[:-1]] = -1
        after = mark >= 0
        first = off[:-1] + np.concatenate([[0], np.cumsum(after)])[off[:-1]]
        piece = np.insert(piece, np.flatnonzero(after) + 1, mark[after])
        size = self.size[piece]
        ids, counts = self._gather(self.start[piece], size), np.add.reduceat(size, first)
        self.start.n = self.size.n = self.again.n = stay[0]
        self.ids.n = stay[1]
        return ids, counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        ends = np.cumsum(counts).tolist()
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *ends], ends, strict=False)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and the number of ids of each. Null counts as empty."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False) if self.by_piece else np.ones(n, bool)
        counts = np.zeros(n, np.int64)
        ids, rest = np.zeros(0, np.uint32), [np.zeros(0, np.uint32)]
        if not whole.all():
            ids, counts[~whole] = self._by_pieces(texts.filter(pa.array(~whole)))
        if whole.any():
            rest += self._ids(texts.filter(pa.array(whole)).to_pylist())
            counts[whole] = [len(x) for x in rest[1:]]
            out = np.empty(int(counts.sum()), np.uint32)
            from_whole = np.repeat(whole, counts)
            out[from_whole], out[~from_whole] = np.concatenate(rest), ids
            ids = out
        return ids, counts

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, int]]:
        """Ranges of rows of at most ``SLICE`` bytes together, a longer row alone."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + self.SLICE, "right")))
            yield lo, hi
            lo = hi


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _encode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before, tokens, missing = TaskContext.get().partitionId(), 0, 0, 0, 0
        if not encoder.cache_info().currsize:
            # what operators before this one left in the worker
            give_back()
        tool = encoder(path or tokenizer_path())
        docs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def add(doc: np.ndarray, size: np.ndarray, ids: np.ndarray, absent: int) -> None:
            nonlocal tokens, missing
            docs.append(doc)
            sizes.append(size)
            held.append(ids)
            tokens, missing = tokens + len(ids), missing + absent

        def close() -> pa.RecordBatch:
            nonlocal seq, before, tokens, missing
            doc = np.concatenate(docs)
            file = encode_shard(doc, np.concatenate(sizes), np.concatenate(held), missing)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(doc)], pa.int64()), pa.array([tokens], pa.int64()), pa.array([before], pa.int64()), pa.array([file], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "before", "file"]
            )
            seq, before, tokens, missing = seq + 1, before + tokens, 0, 0
            for x in (docs, sizes, held):
                x.clear()
            return row

        for batch in batches:
            for a, b in tool.slices(batch.column("text")):
                some = batch.slice(a, b - a)
                ids, size = tool.encode_column(some.column("text"))
                ids, size = np.insert(ids, np.cumsum(size), END_ID), size + 1
                doc, absent = pc.fill_null(some.column("doc_id"), 0).to_numpy(), ~some.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                ends, lo = np.cumsum(size), 0
                while lo < len(doc):
                    done = int(ends[lo - 1]) if lo else 0
                    hi = min(len(doc), int(np.searchsorted(ends, done + SHARD_TOKENS - tokens)) + 1)
                    add(doc[lo:hi], size[lo:hi], ids[done : int(ends[hi - 1])], int(absent[lo:hi].sum()))
                    lo = hi
                    if tokens >= SHARD_TOKENS:
                        yield close()
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encode all texts in ascending id order, those without an id first, and write the shards to ``path``.

    One shuffle moves the texts to ranges of ids, and of the heads of texts
    that have one id or none. Each range is a task that keeps one shard in
    memory, however many documents the range has.
    """
    spark = prepare(docs.sparkSession)
    rows = one_text_per_id(docs, id_col, text_col)
    ranges = rows.repartitionByRange(partitions or shuffle_width(spark), F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    ranges.mapInArrow(_encode(tokenizer), SHARDS).write.option("compression", "none").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_caches()
    for batch in batches:
        for part, before, file in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), batch.column("file"), strict=True):
            doc_ids, lengths, ids = decode_shard(file.as_buffer())
            absent = np.arange(len(doc_ids)) < without_id(file.as_buffer())
            ends = np.cumsum(lengths)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, mask=absent), pa.array(np.full(len(doc_ids), part, np.int32)), pa.array(before + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"]
            )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the written shards: start, tokens and checksum of the ids as read back.

    Only one number for each range of ids goes to the driver.
    """
    prepare(spark)
    shards = spark.read.parquet(path)
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    offsets, total = [], 0
    for part, n in totals:
        offsets.append((part, total))
        total += n
    starts = spark.createDataFrame(offsets, "part int, part_start long")
    found = shards.select("part", "before", "file").mapInArrow(_read, TABLE)
    return found.join(F.broadcast(starts), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def export_files(spark: SparkSession, path: str, folder: str) -> int:
    """Copy the shards to ``folder`` as plain files named by range and number, one at a time; for a mounted folder."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for row in spark.read.parquet(path).select("part", "seq", "file").toLocalIterator():
        with open(f"{folder}/{row['part']:05d}-{row['seq']:07d}.pfor", "wb") as out:
            out.write(row["file"])
        n += 1
    return n


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the shards into the shared folder and return the index that is read from them."""
    spark = prepare(docs.sparkSession)
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return read_index(spark, path)


def op7_token_output(spark, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))
