"""Languages by profiles of letters: trained from labelled rows, kept as a small table, applied to any column.

A profile holds the logarithms of the frequencies of a language's most frequent
letter trigrams, from a bounded sample of its rows (``SAMPLE`` of least hash for each
language). A text's score for a language is the mean over its trigrams; scores become
shares, and a guess is reliable where its share and the text are large enough.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of each language that a profile is made from, characters of each, trigrams of a profile, languages at most.
SAMPLE, CHARACTERS, GRAMS, LANGUAGES = 1500, 4000, 3000, 200
#: Parts that a language's hashes are dealt into.
PARTS = 64
#: Trigrams below which no guess is made, and the share that makes one reliable.
LEAST, RELIABLE = 8, 0.7
#: How many trigrams' worth of evidence a share counts at most: one long text is no surer than this.
WEIGHT = 40
LETTERS = re.compile(r"[^\W\d_]+")

Profiles = dict[str, dict[str, float]]


def grams(text: str) -> Counter[str]:
    """Trigrams of the words of a text, each word between two spaces."""
    found: Counter[str] = Counter()
    for word, n in Counter(LETTERS.findall(text.lower())).items():
        padded = f" {word} "
        for i in range(len(padded) - 2):
            found[padded[i : i + 3]] += n
    return found


def train(labelled: DataFrame, body: str, language: str, sample: int = SAMPLE) -> Profiles:
    """Profiles of all languages of ``labelled``, at most ``LANGUAGES`` of them."""
    rows = labelled.filter(F.col(language).isNotNull() & (F.length(body) > 0)).select(F.col(language).alias("lang"), F.left(body, F.lit(CHARACTERS)).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    # no text is moved before it is known up to which hash a language's sample goes; parts of a language give ``sample`` hashes each at most
    parted = Window.partitionBy("lang", F.pmod("hash", F.lit(PARTS))).orderBy("hash")
    first = rows.select("lang", "hash").distinct().withColumn("n", F.row_number().over(parted)).filter(F.col("n") <= sample)
    upto = first.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).filter(F.col("n") <= sample).groupBy("lang").agg(F.max("hash").alias("upto"))
    near = rows.join(F.broadcast(upto), "lang").filter(F.col("hash") <= F.col("upto")).dropDuplicates(["lang", "text"])  # one row a language
    least = Window.partitionBy("lang").orderBy("hash", "text")
    some = near.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= sample)

    @F.pandas_udf("array<struct<gram:string,n:long>>")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"gram": g, "n": n} for g, n in grams(t).items()])

    each = some.select("lang", F.explode(counted("text")).alias("g")).groupBy("lang", "g.gram").agg(F.sum("g.n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    total = Window.partitionBy("lang")
    kept = each.withColumn("total", F.sum("n").over(total)).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= GRAMS)
    found: Profiles = {}
    # GRAMS rows for each language at most
    for r in kept.collect():
        found.setdefault(r["lang"], {})[r["gram"]] = math.log(r["n"] / r["total"])
    if len(found) > LANGUAGES:
        raise ValueError(f"{len(found)} languages")
    return found


def ranked(text: str | None, profiles: Profiles) -> list[tuple[str, float]]:
    """Languages and their shares, likeliest first; none where there is too little text."""
    found = grams(text or "")
    total = sum(found.values())
    if total < LEAST or not profiles:
        return []
    names = sorted(profiles)
    floor = min(min(p.values()) for p in profiles.values()) - math.log(4)
    means = np.array([sum(n * profiles[name].get(g, floor) for g, n in found.items()) / total for name in names])
    odds = np.exp((means - means.max()) * min(total, WEIGHT))
    shares = odds / odds.sum()
    return sorted(((name, float(s)) for name, s in zip(names, shares, strict=True)), key=lambda x: (-x[1], x[0]))


def languages(body: Column, profiles: Profiles, n: int = 3) -> Column:
    """struct<top array<struct<language, share>>, reliable>: the ``n`` likeliest languages of a whole text."""

    @F.pandas_udf("struct<top:array<struct<language:string,share:double>>,reliable:boolean>")
    def told(texts: pd.Series) -> pd.DataFrame:
        rows = [ranked(t, profiles)[:n] for t in texts]
        return pd.DataFrame({"top": [[{"language": name, "share": round(s, 4)} for name, s in row] for row in rows], "reliable": [bool(row) and row[0][1] >= RELIABLE for row in rows]})

    return told(body)
