"""Fill-in-the-middle: a text is cut at two unit borders and its parts are put in another order, with marks between.

Units are the matches of ``pattern`` (lines by default), found by the Split
pre-tokeniser of the tokenizers library, whose isolated matches carry offsets
in code points; nothing is trained. n is the number of offsets. Four numbers
h1 to h4 from the SHA-256 of seed and doc_id choose: the prefix ends after the
smaller of h1 % (n + 1) and h2 % (n + 1) units and the middle after the larger,
h3 decides whether the text is transformed at all, h4 between the two orders:
prefix-suffix-middle (psm) and suffix-prefix-middle (spm).

A text that holds one of the marks stays plain, so every output tells its parts
and ``restored`` gives the text back from output and form alone. As a mark
starts with a character that it does not repeat, no mark can arise where a part
meets the next mark.

Null text counts as empty, and empty texts stay plain with n = 0. A row without
doc_id draws as if its id were the empty string. Rows are worked on one by one:
repeated rows give equal results, an empty table gives none, and extra columns
are not read. A text may have any length; its offsets are held in memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.runtime import one_text_per_id, prepare

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
#: Rows given on together hold at most so many code points, a longer one alone.
CHUNK = 1 << 22


def _draws(seed: int) -> list[Column]:
    """h1 to h4 as columns over doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _cut(pattern: str, marks: tuple[str, str, str], rate: int, spm_rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        split = Split(Regex(pattern), "isolated").pre_tokenize_str
        before, between, last = marks

        def one(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
            # offsets of every match; what no match covers is a unit as well
            ends = [end for _, (_, end) in split(text)] if text else []
            n = len(ends)
            if not text or any(m in text for m in marks) or h3 % 100 >= rate:
                return n, "plain", None, None, text
            a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
            i, j = (ends[k - 1] if k else 0 for k in (a, b))
            head, middle, tail = text[:i], text[i:j], text[j:]
            if h4 % 100 < spm_rate:
                return n, "spm", i, j - i, f"{between}{tail}{before}{head}{last}{middle}"
            return n, "psm", i, j - i, f"{before}{head}{between}{tail}{last}{middle}"

        def batch_of(ids: list, rows: list[tuple]) -> pa.RecordBatch:
            n, form, i, j, out = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(out, pa.string())], [c.split()[0] for c in CUT.split(", ")])

        for batch in batches:
            ids, rows, held = [], [], 0
            for doc, text, *h in zip(*(batch.column(c) for c in ("doc_id", "text", "h1", "h2", "h3", "h4")), strict=True):
                text = text.as_py() or ""
                if rows and held + len(text) > CHUNK:
                    yield batch_of(ids, rows)
                    ids, rows, held = [], [], 0
                ids.append(doc.as_py())
                rows.append(one(text, *(x.as_py() for x in h)))
                held += len(text)
            if rows:
                yield batch_of(ids, rows)

    return run


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, pattern: str = LINES, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """One row for each document: n, form, lengths of prefix and middle (null where plain) and the output text.

    ``rate`` and ``spm_rate`` are per cent: of texts that are transformed, and
    of those the ones in suffix-prefix-middle order. ``marks`` stand before
    prefix, suffix and middle.
    """
    if len({*marks}) != 3 or any(not m or m[0] in m[1:] or m[0] in other[1:] or m in other for m in marks for other in marks if m is not other):
        raise ValueError("marks must differ, and none may begin with a character that follows in another or itself")
    prepare(docs.sparkSession)
    rows = one_text_per_id(docs, id_col, text_col).select("doc_id", "text", *_draws(seed))
    return rows.mapInArrow(_cut(pattern, marks, rate, spm_rate), CUT)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made from."""
    part = F.split(output, "|".join(re.escape(m) for m in marks))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda text: F.sha2(text, 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), units AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS u, [CAST('0x' || substr(d, 1 + 8 * i, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS h FROM drawn
), ranked AS (
  SELECT doc_id, text, u, h, len(u) AS n, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 AS plain FROM units
), placed AS (
  SELECT doc_id, text, n, CASE WHEN plain THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, u, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM ranked
), parts AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM placed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""
