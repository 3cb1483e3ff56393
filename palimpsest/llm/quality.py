"""Quality rules: base features of each text, and cross-document line frequency for each host.

A word is a run of bytes other than space and 09-0D. A line is what ``\\n``
separates. Lines are compared across documents as the sequence of their words
with ASCII letters lower-cased, by a 64-bit hash of that sequence.

Steps: one pass over the texts gives the base features and the distinct
normalised lines of each document; the lines' document counts for each host
follow from one partial aggregation (a line that a third of all documents
share is counted in every map task first); lines above the host's limit are
joined back to the documents' line lists, and documents that lose more than
half of their words, or keep fewer than ``MIN_WORDS``, are depleted.

Null text counts as empty and fails the base rule, null host is a host of its
own, and equal rows of one doc_id are separate rows with separate verdicts that
count a line once. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import textbytes as tb
from palimpsest.llm.runtime import cut, prepare

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A line may occur in so many documents of its host, or in this share of them, whichever is more.
MIN_DOCS = 20
MAX_SHARE = 0.01
#: A document that loses more than this share of its words is depleted.
MAX_LOSS = 0.5

FEATURES = (
    "row_id long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "lines array<struct<line:long,words:int>>"
)
_STEP = np.array([pow(tb.BASE, 3 * j + 1, 1 << 64) for j in range(WINDOW)], dtype=np.uint64)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _sums(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[hi] - total[lo]


def _sequence_hashes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of values[lo:hi] for each pair, by prefix sums over the values."""
    up, down = tb.powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=sums[1:])
    return tb.mix((sums[hi] - sums[lo]) * down[lo])


def _line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each line; a row of n newlines has n + 1 lines."""
    breaks = np.flatnonzero(data == 10)
    row = np.searchsorted(off, breaks, "right") - 1
    starts = np.concatenate([off[:-1], breaks + 1])
    rows = np.concatenate([np.arange(len(off) - 1), row])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.empty_like(starts)
    last = np.append(rows[1:] != rows[:-1], True)
    ends[:-1] = starts[1:] - 1
    ends[last] = off[1:][rows[last]]
    return starts, ends, rows


def features_of(data: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Base features of each row, and (row, line hash, words) of its distinct lines with a word."""
    n = len(off) - 1
    starts, ends, row = tb.words(data, off)
    lo, hi = off[:-1], off[1:]
    ink = ~tb.SPACE[data]
    out = {
        "n_words": np.bincount(row, minlength=n).astype(np.int64),
        "word_chars": _sums(ink & ((data & 0xC0) != 0x80), lo, hi),
        "n_symbols": _sums(_SYMBOL[data], lo, hi),
    }
    hashes = tb.span_hashes(tb.prefix(data), starts, ends)
    repeat = np.zeros(n, np.int64)
    m = len(starts) - WINDOW + 1
    if m > 0:
        window = np.zeros(m, np.uint64)
        for j in range(WINDOW):
            window += hashes[j : j + m] * _STEP[j]
        whole = row[:m] == row[WINDOW - 1 :]
        key = tb.mix(window) + tb.mix(row[:m].astype(np.uint64))
        twice = np.zeros(m, bool)
        twice[whole] = pd.Series(key[whole]).duplicated(keep=False).to_numpy()
        edge = np.zeros(len(starts) + 1, np.int64)
        edge[:m] += twice
        edge[WINDOW : WINDOW + m] -= twice
        repeat = np.bincount(row, weights=(np.cumsum(edge[:-1]) > 0), minlength=n).astype(np.int64)
    out["n_repeat_words"] = repeat

    ls, le, lrow = _line_spans(data, off)
    first, past = np.searchsorted(starts, ls), np.searchsorted(starts, le)
    some = past > first
    ls, le, lrow, first, past = ls[some], le[some], lrow[some], first[some], past[some]
    own = lrow.astype(np.uint64)
    exact = tb.span_hashes(tb.prefix(data), ls, le) + tb.mix(own)
    out["n_dup_lines"] = np.bincount(lrow, weights=pd.Series(exact).duplicated().to_numpy(), minlength=n).astype(np.int64)
    folded = tb.span_hashes(tb.prefix(tb.LOWER[data]), starts, ends)
    line = _sequence_hashes(folded, first, past)
    frame = pd.DataFrame({"row": lrow, "line": line.view(np.int64), "words": past - first})
    frame = frame.groupby(["row", "line"], sort=True, as_index=False)["words"].sum()
    return out, (frame["row"].to_numpy(), frame["line"].to_numpy(), frame["words"].to_numpy())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = tb.utf8(batch.column("text"))
        for lo, hi in tb.chunks(off):
            base, (row, line, words) = features_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            at = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(line, pa.int64()), pa.array(words.astype(np.int32), pa.int32())], ["line", "words"])
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [part.column("row_id"), part.column("doc_id"), part.column("host"), *(pa.array(base[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.ListArray.from_arrays(pa.array(at), items)],
                ["row_id", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
            )


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: base features and distinct normalised lines. No shuffle."""
    prepare(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).cast("string").alias("text")
    )
    return rows.mapInArrow(_features, FEATURES)


def frequent_lines(features: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line, n_docs) of lines above their host's limit.

    Counts are of documents: rows of one doc_id count a line once, a row
    without a doc_id is a document of its own. Documents of a line are told
    apart over all tasks and then counted in map tasks first, so no host and no
    line gathers rows.
    """
    own = F.when(F.col("doc_id").isNull(), F.col("row_id"))
    once = features.select("host", "doc_id", own.alias("own"), F.explode("lines.line").alias("line")).distinct()
    counted = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    hosts = features.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    return (
        counted.filter(F.col("n_docs") > min_docs)
        .join(hosts, "host")
        .filter(F.col("n_docs") > F.col("host_docs") * max_share)
        .select("host", "line", "n_docs")
    )


def judge(features: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_loss: float = MAX_LOSS) -> DataFrame:
    """Adds removed words and the two verdicts to the features of each document.

    ``features`` is read three times: pass a written or checkpointed frame.
    """
    frequent = frequent_lines(features, min_docs, max_share).select("host", "line")
    lost = (
        features.select("row_id", "host", F.inline("lines"))
        .join(frequent, ["host", "line"])
        .groupBy("row_id")
        .agg(F.sum("words").cast("long").alias("n_removed_words"), F.collect_list("line").alias("removed_lines"))
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < MIN_WORDS) | (F.col("n_removed_words") > max_loss * F.col("n_words"))
    return (
        features.drop("lines")
        .join(lost, "row_id", "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_loss: float = MAX_LOSS) -> DataFrame:
    """Features and verdicts, one row for each row of ``docs``."""
    features = cut(text_features(docs, id_col, text_col, host_col))
    return judge(features, min_docs, max_share, max_loss)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("removed_lines").to_pylist(), strict=True):
            if text and gone:
                raw = np.frombuffer(text.encode(), np.uint8)
                starts, ends, _ = _line_spans(raw, np.array([0, len(raw)]))
                ws, we, _ = tb.words(raw, np.array([0, len(raw)]))
                first, past = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
                folded = tb.span_hashes(tb.prefix(tb.LOWER[raw]), ws, we)
                line = _sequence_hashes(folded, first, past).view(np.int64)
                keep = ~(np.isin(line, np.array(gone, np.int64)) & (past > first))
                text = "\n".join(bytes(raw[s:e]).decode() for s, e in zip(starts[keep], ends[keep], strict=True))
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def clean_documents(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of kept documents without the lines above the limits. ``doc_id`` must be a key here."""
    kept = verdicts.filter("kept").select("doc_id", "removed_lines")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(kept, "doc_id").mapInArrow(_strip, "doc_id long, text string")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


OP2_SQL = f"""
WITH w AS (
  SELECT doc_id, source, generate_subscripts(ws, 1) AS i, unnest(ws) AS word, len(ws) AS n
  FROM (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
win AS (
  SELECT doc_id, i, n, word, CASE WHEN i + {WINDOW - 1} <= n THEN
    string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) END AS g FROM w),
twice AS (SELECT doc_id, i, word, coalesce(g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1, false) AS t FROM win),
cov AS (SELECT doc_id, word, max(t::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS c FROM twice),
feat AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(c) AS n_repeat_words FROM cov GROUP BY doc_id),
raw AS (
  SELECT doc_id, coalesce(source, '') AS host, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
lines AS (
  SELECT doc_id, host, pos, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words,
    translate(array_to_string(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM raw WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
hosts AS (SELECT coalesce(source, '') AS host, count(*) AS host_docs FROM documents GROUP BY 1),
freq AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT doc_id) AS n_docs FROM lines GROUP BY 1, 2) JOIN hosts USING (host)
  WHERE n_docs > {MIN_DOCS} AND n_docs > host_docs * {MAX_SHARE}),
lost AS (SELECT doc_id, sum(words) AS gone FROM lines JOIN freq USING (host, norm) GROUP BY doc_id),
every AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS n_removed_words
  FROM documents d LEFT JOIN feat USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND NOT (n_words - n_removed_words < {MIN_WORDS} OR n_removed_words > {MAX_LOSS} * n_words) AS kept, n_removed_words
FROM every
"""
