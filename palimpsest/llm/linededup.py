"""Line dedup across documents within an edit bound. DataFrame operations only.

A line is what ``\\n`` separates; it is compared as its words (runs of
characters other than space and 09-0D) in lower case. Lines without words are
left alone. A line is removed if an earlier line, in order of (doc_id, line
number), has the same words (exact), or, for lines of ``MIN_WORDS`` words and
more, if it is the first of its words and an earlier line is at most one word
inserted, deleted or replaced away (near). Lines are judged on the input, also
against lines that are removed themselves; so repeats chain, and the earliest
of a group always stays.

1. Equal lines are counted by 128-bit hash, in map tasks first. What follows is
   about distinct lines, each held by its first place.
2. An edit of one word leaves the first or the second half of a line as it was.
   Lines that share neither half (for their own number of words or for one
   less) with another line cannot have a partner and go no further.
3. The others emit their deletion neighbourhood: the hash of the line, and of
   the line without each of its words. Two lines are within the bound if they
   share a variant without the same word, or if one is a variant of the other.
   Equal variants are joined to the least line of their key, so a key of many
   lines gives one row for each line and never pairs.
4. The words of each line and its partner are compared exactly.
5. Lines are joined to the groups that lose some, and texts to the numbers of
   their removed lines; lines that stay are not moved again.

Lines under ``min_words`` words have no near repeats, as one word in few is
another line. Null text has no lines and stays null; a row without a doc_id has
no order, loses nothing and counts no lines. Rows of equal doc_id and text count their lines at
equal places; doc_id should be a key. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.runtime import Tables, one_text_per_id, release, written

MIN_WORDS = 8
#: White space other than the space and the line break.
_RARE = "\t\x0b\x0c\r"
_PLACES = 10**11


def words_of(line: Column) -> Column:
    """Words of a line of ``folded`` text."""
    return F.array_remove(F.split(line, " "), "")


def folded(text: Column) -> Column:
    """Lower case, with all gaps but the line break as spaces; the rare ones cost nothing where absent."""
    lower = F.lower(text)
    rare = [F.contains(text, F.lit(c)) for c in _RARE]
    return F.when(rare[0] | rare[1] | rare[2] | rare[3], F.translate(lower, _RARE, " " * len(_RARE))).otherwise(lower)


def place(doc_id: Column, number: Column, bits: int | None = None) -> Column:
    """One number in order of (doc_id, line number): a long with ``bits`` for the line number, or a decimal for any 64-bit id."""
    if bits is not None:
        return F.shiftleft(doc_id, bits).bitwiseOR(number.cast("long"))
    return (doc_id.cast("decimal(20,0)") * F.lit(_PLACES).cast("decimal(12,0)") + number.cast("decimal(12,0)")).cast("decimal(38,0)")


def unplace(at: Column, bits: int | None = None) -> tuple[Column, Column]:
    if bits is not None:
        return F.shiftright(at, bits), at.bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")
    number = F.pmod(at, F.lit(_PLACES).cast("decimal(38,0)"))
    return ((at - number) / F.lit(_PLACES).cast("decimal(38,0)")).cast("long"), number.cast("int")


def bits_of(lines: DataFrame) -> int | None:
    """Bits that the largest line number needs, if all places then fit a long; long ids are many times cheaper than decimals."""
    low, high, number = lines.agg(F.min("doc_id"), F.max("doc_id"), F.max("number")).first()
    if low is None:
        return 0
    bits = number.bit_length()
    return bits if -(2**63) <= low << bits and (high + 1) << bits <= 2**63 else None


def spaced(line: Column) -> Column:
    """Words of a line of ``folded`` text with one space between them."""
    line = F.trim(line)
    return F.when(F.contains(line, F.lit("  ")), F.regexp_replace(line, " +", " ")).otherwise(line)


def lines_of(texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every line with a word: document, number, words, and hashes of its first part, last part and third part.

    The first half and the rest (n words, hashes ``head`` and ``tail``) tell a
    line by 128 bits. As a line of one word less it has one half in common with
    that and one of its own, ``third``: the tail of an odd line without its
    middle word, the head of an even line without its last. Halves are cut from
    the line at its spaces; no line becomes an array of words.
    """
    rows = texts.select("doc_id", F.posexplode(F.split(folded(F.col("text")), "\n")).alias("number", "line")).filter(F.trim("line") != "")
    line = rows.select("doc_id", "number", spaced(F.col("line")).alias("line"))
    worded = line.withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    k, n = F.shiftright("n", 1), F.col("n")
    first = lambda count: F.call_function("substring_index", F.col("line"), F.lit(" "), count)
    third = F.when(n >= min_words, F.xxhash64(F.when(n % 2 == 1, first(-k)).otherwise(first(k - 1))))
    return worded.select("doc_id", "number", "n", F.xxhash64(first(k)).alias("head"), F.xxhash64(first(k - n)).alias("tail"), third.alias("third"))


def _halves() -> Column:
    """Keys of both halves of a line, as a line of its own length and as one of one word less."""
    odd, n = F.col("n") % 2 == 1, F.col("n")
    return F.array(F.xxhash64(F.lit(0), n, "head"), F.xxhash64(F.lit(1), n, "tail"), F.xxhash64(F.lit(0), n - 1, F.when(odd, F.col("head")).otherwise(F.col("third"))), F.xxhash64(F.lit(1), n - 1, F.when(odd, F.col("third")).otherwise(F.col("tail"))))


def variants(candidates: DataFrame) -> DataFrame:
    """(at, n, hash, hash2, drop): the line (drop -1) and the line without word ``drop``; n is the number of words left.

    ``hash`` is the exclusive or of a hash of each word left and its place, so
    all variants of a line follow from two running values; ``hash2`` is a sum
    over the words left whatever their places. Words are rows here, so a line of
    any length costs as many rows as it has words.
    """
    words = candidates.select("at", F.posexplode("words").alias("i", "w"))
    rows = words.select("at", "i", F.xxhash64("w", "i").alias("k"), F.xxhash64("w", F.col("i") - 1).alias("m"), F.shiftrightunsigned(F.xxhash64("w"), 24).alias("s"))
    line = Window.partitionBy("at")
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    known = rows.select(
        "at", "i", "k", "s", F.bit_xor("k").over(upto).alias("pk"), F.bit_xor("m").over(upto).alias("pm"),
        F.bit_xor("k").over(line).alias("tk"), F.bit_xor("m").over(line).alias("tm"), F.sum("s").over(line).alias("ts"), F.count(F.lit(1)).over(line).cast("int").alias("n"),
    )
    row = lambda n, hash_, hash2, drop: F.struct(n.alias("n"), hash_.alias("hash"), hash2.alias("hash2"), drop.alias("drop"))
    without = row(F.col("n") - 1, F.col("pk").bitwiseXOR(F.col("k")).bitwiseXOR(F.col("pm")).bitwiseXOR(F.col("tm")), F.col("ts") - F.col("s"), F.col("i"))
    whole = row(F.col("n"), F.col("tk"), F.col("ts"), F.lit(-1))
    return known.select("at", F.inline(F.when(F.col("i") == 0, F.array(whole, without)).otherwise(F.array(without))))


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by one inserted, deleted or replaced word at most."""
    short, long_ = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    same = F.transform(F.sequence(F.lit(0), F.size(short) - 1), lambda i: F.get(short, i) == F.get(long_, i))
    first = F.array_position(same, False).cast("int")
    k = F.when(first == 0, F.size(short)).otherwise(first - 1)
    tail = F.slice(long_, k + 2, F.size(long_))
    return F.when(F.size(a) == F.size(b), F.slice(short, k + 2, F.size(short)) == tail).when(F.size(long_) == F.size(short) + 1, F.slice(short, k + 1, F.size(short)) == tail).otherwise(False)


def line_links(texts: DataFrame, lines: DataFrame, tables: Tables, min_words: int = MIN_WORDS, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups of equal lines with their first place, verified links of near lines to an earlier one)."""
    spark = texts.sparkSession
    groups = tables.put("groups", lines.groupBy("n", "head", "tail").agg(F.min(place(F.col("doc_id"), F.col("number"), bits)).alias("at"), F.count(F.lit(1)).alias("n_same"), F.max("third").alias("third")))
    halves = groups.filter(F.col("n") >= min_words).select("at", F.explode(_halves()).alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 1").select("half")
    doc_id, number = unplace(F.col("at"), bits)
    chosen = halves.join(shared, "half", "left_semi").select("at").distinct().select(doc_id.alias("doc_id"), number.alias("number"))
    wanted = tables.put("wanted", chosen.groupBy("doc_id").agg(F.collect_set("number").alias("numbers")))
    release(spark)
    split = texts.join(wanted, "doc_id").select("doc_id", "numbers", F.split(folded(F.col("text")), "\n").alias("all"))
    picked = split.select("doc_id", F.explode("numbers").alias("number"), "all").select("doc_id", "number", F.get("all", F.col("number")).alias("line"))
    candidates = tables.put("candidates", picked.select(place(F.col("doc_id"), F.col("number"), bits).alias("at"), words_of(F.col("line")).alias("words")).dropDuplicates(["at"]))
    release(spark)
    keys = tables.put("variants", variants(candidates))
    replaced = keys.filter("drop >= 0").groupBy("n", "hash", "hash2", "drop").agg(F.min("at").alias("low"), F.max("at").alias("high")).filter("low < high").select("n", "hash", "hash2", "drop", F.col("low").alias("other"))
    sides = keys.groupBy("n", "hash", "hash2").agg(F.min(F.when(F.col("drop") < 0, F.col("at"))).alias("whole"), F.min(F.when(F.col("drop") >= 0, F.col("at"))).alias("part")).filter("whole is not null and part is not null")
    replaced, sides = tables.put("replaced", replaced), tables.put("sides", sides)
    found = (
        keys.join(replaced, ["n", "hash", "hash2", "drop"]).filter("other < at").select("at", "other")
        .union(keys.join(sides, ["n", "hash", "hash2"]).select("at", F.when(F.col("drop") < 0, F.col("part")).otherwise(F.col("whole")).alias("other")).filter("other < at"))
        .distinct()
    )
    other = candidates.select(F.col("at").alias("other"), F.col("words").alias("other_words"))
    near = found.join(candidates, "at").join(other, "other").filter(within_one(F.col("words"), F.col("other_words"))).groupBy("at").agg(F.min("other").alias("other"))
    links = tables.put("links", near)
    tables.drop("wanted", "candidates", "variants", "replaced", "sides")
    release(spark)
    return groups, links


def removed_lines(docs: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(all lines, (doc_id, number, same, near) of each line that goes, as exact or as near repeat)."""
    texts = one_text_per_id(docs, id_col, text_col).filter("doc_id is not null and text is not null")
    lines = tables.put("lines", lines_of(texts, min_words))
    bits = bits_of(lines)
    groups, links = line_links(texts, lines, tables, min_words, bits)
    near = links.select("at", F.lit(True).alias("near"))
    told = tables.put("told", groups.join(near, "at", "left").filter("n_same > 1 or near").select("n", "head", "tail", F.col("at").alias("first"), F.coalesce("near", F.lit(False)).alias("first_near")))
    tables.drop("groups", "links")
    marked = lines.select("doc_id", "number", "n", "head", "tail").join(told, ["n", "head", "tail"])
    same = place(F.col("doc_id"), F.col("number"), bits) > F.col("first")
    return lines, marked.select("doc_id", "number", same.alias("same"), (~same & F.col("first_near")).alias("near")).filter("same or near")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text without the removed lines, numbers of the lines removed as exact and as near repeats, and counts."""
    tables = Tables(docs.sparkSession, "line-dedup")
    number = lambda kind: F.collect_set(F.when(F.col(kind), F.col("number")))
    lines, removed = removed_lines(docs, tables, id_col, text_col, min_words)
    counted = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    gone = removed.groupBy("doc_id").agg(F.count_if("same").alias("n_exact"), F.count_if("near").alias("n_near"), number("same").alias("exact"), number("near").alias("alike"))
    told = tables.put("removed", counted.join(gone, "doc_id", "left"))
    tables.drop("lines", "told")
    release(docs.sparkSession)
    texts = one_text_per_id(docs, id_col, text_col).join(told, "doc_id", "left")
    out = F.concat("exact", "alike")
    # cut once for each text that loses lines, and not inside the function of a line
    texts = texts.withColumn("parts", F.when(F.size(out) > 0, F.split("text", "\n")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), out), lambda i: F.get("parts", i))
    text = F.when(F.size(out) > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    numbers = [F.sort_array(F.coalesce(c, F.array().cast("array<int>"))).alias(to) for c, to in (("exact", "exact"), ("alike", "near"))]
    return texts.select("doc_id", text.alias("text"), *numbers, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_lines", "n_exact", "n_near")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text) without the removed lines; a document may lose all."""
    return deduplicated(docs, id_col, text_col, min_words).select("doc_id", "text")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Writes the texts without removed lines, with the numbers of those, as a Parquet table in the shared folder; the result is the counts read from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return written(deduplicated(docs), "deduplicated").select("doc_id", "n_lines", "n_exact", "n_near")


OP3_SQL = f"""
WITH raw AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS number, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
lines AS (SELECT doc_id, number, ws, len(ws) AS n, array_to_string(ws, ' ') AS norm
  FROM (SELECT doc_id, number, regexp_extract_all(lower(line), '[^\\x20\\x09-\\x0D]+') AS ws FROM raw) WHERE len(ws) > 0),
placed AS (SELECT *, row_number() OVER (ORDER BY doc_id, number) AS pos FROM lines),
firsts AS (SELECT *, min(pos) OVER (PARTITION BY norm) AS first FROM placed),
d AS (SELECT pos, ws, n, norm FROM firsts WHERE pos = first AND n >= {MIN_WORDS}),
v AS (SELECT pos, n, i, md5(array_to_string(list_concat(ws[:i - 1], ws[i + 1:]), ' ')) AS h FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM d)),
r AS (SELECT h, i, n, min(pos) AS least FROM v GROUP BY ALL),
near AS (
  SELECT v.pos FROM v JOIN r ON v.h = r.h AND v.i = r.i AND v.n = r.n WHERE r.least < v.pos
  UNION SELECT v.pos FROM v JOIN d ON v.h = md5(d.norm) AND v.n = d.n + 1 WHERE d.pos < v.pos
  UNION SELECT d.pos FROM v JOIN d ON v.h = md5(d.norm) AND v.n = d.n + 1 WHERE v.pos < d.pos),
c AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (pos > first) AS n_exact, count(*) FILTER (pos = first AND pos IN (SELECT pos FROM near)) AS n_near FROM firsts GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_exact, 0)::BIGINT AS n_exact, coalesce(n_near, 0)::BIGINT AS n_near FROM documents LEFT JOIN c USING (doc_id)
"""
