"""Documents to chunks: headers, token limits, packing, numbering, articles."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

CHUNK = StructType([StructField("hierarchy", ArrayType(StringType())), StructField("body", StringType())])
_HEADER = re.compile(r"(#{1,3})\s+(\S.*)")
_FENCE = re.compile(r"\s*(```|~~~)")
COUNTED = re.compile(r"\w+|[^\w\s]")


def split_headers(markdown: str | None) -> list[dict]:
    """Sections under #, ## and ### lines with their path; header lines leave the text, fenced lines are no headers."""
    path: list[str | None] = [None, None, None]
    out: list[dict] = []
    held: list[str] = []
    fenced = False

    def flush() -> None:
        body = "\n".join(held).strip()
        if body:
            out.append({"hierarchy": [p for p in path if p], "body": body})
        held.clear()

    for line in (markdown or "").split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
        found = None if fenced else _HEADER.fullmatch(line.rstrip())
        if found:
            flush()
            level = len(found[1]) - 1
            path[level:] = [found[2].strip()] + [None] * (2 - level)
        else:
            held.append(line)
    flush()
    return out


def token_count(text: str) -> int:
    return len(COUNTED.findall(text))


def split_long(text: str, most: int = 1024, size: int = 4096, overlap: int = 100) -> list[str]:
    """A text of at most ``most`` tokens as it is; else pieces of at most ``size`` tokens that share ``overlap``."""
    spans = [m.span() for m in COUNTED.finditer(text)]
    if len(spans) <= most or len(spans) <= size:
        return [text]
    step = max(1, size - overlap)
    starts = range(0, max(1, len(spans) - overlap), step)
    return [text[spans[i][0] : spans[min(i + size, len(spans)) - 1][1]] for i in starts]


def pack_lines(text: str | None, limit: int = 1000) -> list[str]:
    """Lines packed in order until the next would pass ``limit`` characters; blank lines drop out."""
    out: list[list[str]] = []
    size = 0
    for line in (text or "").split("\n"):
        if line.strip():
            if not out or size + len(line) > limit:
                out.append([])
                size = 0
            out[-1].append(line)
            size += len(line)
    return ["\n".join(x) for x in out]


#: Bytes of text that are cut at a time, in one task: its Python holds the chunks of so much, whatever a batch holds.
BYTES = 4 << 20


def slices(batch: pa.RecordBatch, body: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``BYTES`` of a text column, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(body)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _rows(df: DataFrame, body: str, cut: Callable[[str | None], list], place: str, kinds: StructType, keep: list[str]) -> DataFrame:
    """One row for each thing that ``cut`` makes of a text: the columns to keep, its ``place``, and its own fields."""
    schema = StructType([*(df.schema[c] for c in keep), StructField(place, IntegerType()), *kinds.fields])
    made = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, body):
                found = [cut(t) for t in some.column(body).to_pylist()]
                n = np.array([len(x) for x in found])
                row = pa.array(np.repeat(np.arange(len(n)), n))
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                fields = [pa.array([x[f.name] for one in found for x in one], f.type) for f in made] if len(made) > 1 else [pa.array([x for one in found for x in one], made[0].type)]
                yield pa.RecordBatch.from_arrays([*(some.column(c).take(row) for c in keep), pa.array(at.astype(np.int32)), *fields], [*keep, place, *(f.name for f in made)])

    return df.select(*dict.fromkeys([*keep, body])).mapInArrow(run, schema)


def header_chunks(df: DataFrame, ident: str, body: str) -> DataFrame:
    return _rows(df, body, split_headers, "pos", CHUNK, [ident])


def limited_chunks(chunks: DataFrame, body: str = "body", most: int = 1024, size: int = 4096, overlap: int = 100) -> DataFrame:
    return _rows(chunks, body, lambda t: split_long(t or "", most, size, overlap), "part", StructType([StructField("part_body", StringType())]), chunks.columns)


def packed_chunks(df: DataFrame, ident: str, body: str, limit: int = 1000) -> DataFrame:
    return _rows(df, body, lambda t: pack_lines(t, limit), "pos", StructType([StructField("chunk", StringType())]), [ident])


def numbered(chunks: DataFrame, document: str) -> DataFrame:
    """``chunk_name``: Chunk0001, Table0002, ... in order of page, texts before tables, position."""
    w = Window.partitionBy(document).orderBy("page", F.when(F.col("kind") == "text", 0).otherwise(1), "pos")
    n = F.lpad(F.row_number().over(w).cast("string"), 4, "0")
    return chunks.withColumn("chunk_name", F.concat(F.when(F.col("kind") == "text", "Chunk").otherwise("Table"), n))


def chunk_section(refs: Column, body: Column) -> Column:
    """The first reference whose section the chunk's text holds."""
    return F.try_element_at(F.filter(refs, lambda r: (r != "") & body.contains(r)), F.lit(1))


def articles(df: DataFrame, ident: str, body: str) -> DataFrame:
    """(id, article, line_no, kind, line): article lines open blocks, numbered lines are their sections."""
    lines = df.select(ident, F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    opens = F.col("line").rlike(r"(?i)^Article\s+\d+")
    w = Window.partitionBy(ident).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.when(opens, "article").when(F.col("line").rlike(r"^\(?\d+\)?"), "section").otherwise("text")
    return lines.select(ident, F.count_if(opens).over(w).alias("article"), "line_no", kind.alias("kind"), "line")


def carry_forward(pages: DataFrame, document: str, order: str, columns: list[str]) -> DataFrame:
    """First known value of each column so far, in page order."""
    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in columns})


def within_budget(pages: DataFrame, document: str, order: str, tokens: str, budget: int) -> DataFrame:
    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("spent", F.sum(tokens).over(w)).filter(F.col("spent") <= budget)


def model_batches(pages: DataFrame, keys: list[str], order: str, model: str) -> DataFrame:
    """Batch number of each page: five pages to a call of a small model, two otherwise."""
    w = Window.partitionBy(*keys, model).orderBy(order)
    size = F.when(F.col(model).contains("mini"), 5).otherwise(2)
    return pages.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def sampled_pages(pages: DataFrame, document: str, number: str) -> DataFrame:
    """Three middle pages of five and more, the first three of four, all of fewer. Pages count from 1."""
    n = F.count(F.lit(1)).over(Window.partitionBy(document))
    middle = F.floor(n / 2)
    keep = F.when(n >= 5, F.col(number).between(middle, middle + 2)).when(n == 4, F.col(number) <= 3).otherwise(F.lit(True))
    return pages.withColumn("_keep", keep).filter("_keep").drop("_keep")
