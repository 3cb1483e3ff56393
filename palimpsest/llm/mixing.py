"""Mixing sources to target weights by iterative proportional fitting. DataFrame operations only.

Documents fall into cells of (source, lang, topic); a cell counts the tokens of
its documents. Raking scales the cells' weights to the target share of each
source, then of each language, then of each topic, and again, until all three
margins hold. A document of a cell is kept with probability

    min(1, c * weight / tokens)

where c is solved so that the expected number of kept tokens is the budget.
The decision compares that with a uniform number from the MD5 of seed and
doc_id, so it does not depend on partitions, and runs with a larger budget keep
a superset.

Targets are given as (value, share) frames or, by default, tempered: the share
of a value is its share of tokens to the power ``TEMPER``, normalised. Shares
of values without tokens are dropped and the rest normalised; values that a
given frame does not name get none.

A token is a run of characters other than space and 09-0D. The topic is a
column that the caller gives or, by default, the register of the text: empty,
symbols, shouted, figures, lines or prose. Null
source or lang is the value ''. Null and empty texts have no tokens; they are
kept with the probability of their cell, or never if the cell has no tokens.
Rows of equal doc_id share one fate. An empty table gives no rows.

Cells are counted in map tasks first. The driver sees single numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.runtime import cut, prepare

DIMENSIONS = ("source", "lang", "topic")
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
KEEP_SHARE = 0.75
SEED = "mix-1"
#: Raking ends when no weight moves by more than TOLERANCE of itself in a round, or, after ROUNDS, by more than SETTLED of all weight.
TOLERANCE, ROUNDS, SETTLED, MOST_ROUNDS = 1e-12, 60, 1e-6, 600
#: Cells that are sent to all tasks at once.
SENT_CELLS = 50_000
WORD, SYMBOL, DIGIT = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]", "[0-9]"


def topic_of(text: Column, words: Column) -> Column:
    """Register of a text from counts over all of it."""
    size = F.length(text)
    return (
        F.when(words == 0, "empty")
        .when(F.regexp_count(text, F.lit(SYMBOL)) * 20 >= size, "symbols")
        .when((F.upper(text) == text) & (F.lower(text) != text), "shouted")
        .when(F.regexp_count(text, F.lit(DIGIT)) * 50 >= size, "figures")
        .when((size - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1) * 60 >= size, "lines")
        .otherwise("prose")
    )


def with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` with a struct ``_cell`` of source, lang, topic and n_tokens; no column of the input is renamed. ``topic`` is the text's register unless a column is given."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    named = topic_of(text, words) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))
    return docs.withColumn("_cell", F.struct(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), named.alias("topic"), words.alias("n_tokens")))


def _targets(cells: DataFrame, name: str, given: DataFrame | None) -> DataFrame:
    """(name, target): shares that add up to one over the values with tokens."""
    margin = cells.groupBy(name).agg(F.sum("n_tokens").alias("n")).filter("n > 0")
    total = F.sum("raw").over(Window.partitionBy(F.lit(0)))
    if given is None:
        raw = margin.select(name, F.pow(F.col("n").cast("double"), TEMPER[name]).alias("raw"))
    else:
        raw = margin.join(given.select(F.col("value").cast("string").alias(name), F.col("share").cast("double").alias("raw")), name)
    return raw.select(name, (F.col("raw") / total).alias(f"{name}_target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Cells with tokens and their raked ``weight``; the weights add up to one.

    ``cells``: source, lang, topic, n_tokens. Runs a driver loop of one
    checkpoint and one number a round, until the weights settle; weights that
    do not within ``MOST_ROUNDS`` are an error.
    """
    targets = targets or {}
    fitted = cells.filter("n_tokens > 0")
    for name in DIMENSIONS:
        fitted = fitted.join(_targets(cells, name, targets.get(name)), name, "left").withColumn(f"{name}_target", F.coalesce(f"{name}_target", F.lit(0.0)))
    fitted = cut(fitted.withColumn("weight", F.col("n_tokens").cast("double")))
    done = 0
    while True:
        moved = fitted.withColumn("old", F.col("weight"))
        for name in DIMENSIONS:
            have = F.sum("weight").over(Window.partitionBy(name))
            moved = moved.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"{name}_target") / have).otherwise(0.0))
        fitted = cut(moved)
        moved_by = F.abs(F.col("weight") - F.col("old"))
        relative, mass = fitted.agg(F.max(moved_by / F.greatest("weight", F.lit(1e-300))), F.max(moved_by)).first()
        done += 1
        if relative is None or relative < TOLERANCE or (done >= ROUNDS and mass < SETTLED):
            break
        if done >= MOST_ROUNDS:
            raise RuntimeError(f"raking still moves weights by {mass:.1e} after {done} rounds: the margins cannot all hold")
    return fitted.drop("old")


def calibrate(weighted: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Adds ``probability`` to raked cells.

    Cells whose probability reaches one are taken whole and c is solved for the
    rest; the set of such cells only grows, so this ends.
    """
    ratio = F.col("weight") / F.col("n_tokens")
    budget = (weighted.agg(F.sum("n_tokens")).first()[0] or 0) * keep_share
    c, before = 0.0, None
    while True:
        full = ratio * c >= 1
        row = weighted.agg(F.count_if(full), F.sum(F.when(full, F.col("n_tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if row[0] == before or not row[2]:
            break
        before = row[0]
        c = max(c, (budget - (row[1] or 0)) / row[2])
    return weighted.withColumn("probability", F.least(F.lit(1.0), ratio * c))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep_share: float = KEEP_SHARE, seed: str = SEED, topic: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with ``_cell``, ``_probability`` and ``_kept``, calibrated cells). Columns of these names would be replaced; ``sample_documents`` keeps all."""
    prepare(docs.sparkSession)
    placed = with_cells(docs.drop("_weight", "_probability"), topic)
    cells = cut(placed.groupBy(*(F.col(f"_cell.{n}").alias(n) for n in DIMENSIONS)).agg(F.sum("_cell.n_tokens").alias("n_tokens")))
    fitted = cut(calibrate(rake(cells, targets), keep_share))
    rates = fitted.select(F.struct(*DIMENSIONS).alias("_key"), F.col("weight").alias("_weight"), F.col("probability").alias("_probability"))
    # the table of cells is sent to the tasks where it is small, which is counted; else the texts meet it by shuffle
    rates = F.broadcast(rates) if fitted.limit(SENT_CELLS + 1).count() <= SENT_CELLS else rates
    key = F.struct(*(F.col(f"_cell.{n}").alias(n) for n in DIMENSIONS))
    out = placed.join(rates, key == F.col("_key"), "left").drop("_key")
    out = out.withColumn("_weight", F.coalesce("_weight", F.lit(0.0))).withColumn("_probability", F.coalesce("_probability", F.lit(0.0)))
    return out.withColumn("_kept", uniform(F.col("doc_id"), seed) < F.col("_probability")), fitted


def sample_documents(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep_share: float = KEEP_SHARE, seed: str = SEED) -> DataFrame:
    """The sampled rows of ``docs``, all its columns, whatever their names."""
    packed = docs.select("doc_id", "text", "source", "lang", F.struct("*").alias("_row"))
    return mixed(packed, targets, keep_share, seed)[0].filter("_kept").select("_row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    out, _ = mixed(docs)
    return out.select(
        "doc_id", *(F.col(f"_cell.{n}").alias(n) for n in (*DIMENSIONS, "n_tokens")), F.round("_weight", 9).alias("weight"), F.round("_probability", 9).alias("probability"), F.col("_kept").alias("kept")
    )


def _sql(rounds: int = 40) -> str:
    steps = []
    for i in range(rounds):
        for j, name in enumerate(DIMENSIONS):
            k = 3 * i + j
            steps.append(f"w{k + 1} AS MATERIALIZED (SELECT * EXCLUDE w, w * {name}_target / sum(w) OVER (PARTITION BY {name}) AS w FROM w{k})")
    margins = ", ".join(f"{n}_t AS (SELECT {n}, pow(sum(n_tokens), {TEMPER[n]}) / sum(pow(sum(n_tokens), {TEMPER[n]})) OVER () AS {n}_target FROM cells WHERE n_tokens > 0 GROUP BY {n})" for n in DIMENSIONS)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
p AS (
  SELECT doc_id, source, lang, n_tokens, CASE WHEN n_tokens = 0 THEN 'empty'
    WHEN length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) * 20 >= length(t) THEN 'symbols'
    WHEN upper(t) = t AND lower(t) <> t THEN 'shouted'
    WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) * 50 >= length(t) THEN 'figures'
    WHEN (length(t) - length(replace(t, chr(10), '')) + 1) * 60 >= length(t) THEN 'lines' ELSE 'prose' END AS topic FROM d),
cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS n_tokens FROM p GROUP BY ALL),
{margins},
w0 AS MATERIALIZED (SELECT cells.*, source_target, lang_target, topic_target, n_tokens::DOUBLE AS w FROM cells JOIN source_t USING (source) JOIN lang_t USING (lang) JOIN topic_t USING (topic) WHERE n_tokens > 0),
{", ".join(steps)},
r AS (SELECT source, lang, topic, n_tokens, w, w / n_tokens AS ratio FROM w{3 * rounds}),
o AS (SELECT *, row_number() OVER s AS k, sum(n_tokens) OVER s AS upto, sum(w) OVER s AS wupto, sum(n_tokens) OVER () AS total, sum(w) OVER () AS wall FROM r
  WINDOW s AS (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT min(k) AS k0 FROM o WHERE ({KEEP_SHARE} * total - (upto - n_tokens)) / (wall - (wupto - w)) * ratio < 1),
f AS (SELECT ({KEEP_SHARE} * total - (upto - n_tokens)) / (wall - (wupto - w)) AS factor FROM o, c WHERE k = k0)
SELECT p.doc_id, p.source, p.lang, p.topic, p.n_tokens, round(coalesce(w, 0), 9) AS weight, round(coalesce(least(1.0, ratio * factor), 0), 9) AS probability,
  ('0x' || substr(md5('{SEED}:' || p.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / {1 << 52} < coalesce(least(1.0, ratio * factor), 0) AS kept
FROM p LEFT JOIN (SELECT * FROM r, f) q USING (source, lang, topic)
"""


OP1_SQL = _sql()
