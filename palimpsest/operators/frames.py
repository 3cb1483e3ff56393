"""Table access: paging, lookups, optional filters, inserts, updates, deletes, de-duplication and top rows.

Tables are append logs of Parquet: an update or delete is a frame without the
old rows and with the new, to be written to another path and swapped in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.store import work_folder


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys into as many parts as a shuffle has; given a number, Spark does not put small parts together again.

    What is grouped by the keys afterwards is grouped part by part, and not
    before in tasks that each hold a whole split of the input.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *keys)


def page(df: DataFrame, key: str, skip: int = 0, limit: int = 100) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` in order of the key."""
    return df.orderBy(key).offset(skip).limit(limit)


def point(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def exists(df: DataFrame, key: str, value) -> bool:
    return not point(df, key, value).limit(1).isEmpty()


def optional(df: DataFrame, **equal) -> DataFrame:
    """Equality filters of those arguments that are not None."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def between(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Inclusive bounds, each optional."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    return df if end is None else df.filter(F.col(column) <= F.lit(end))


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with ``rows`` in place of those of equal keys."""
    return table.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def update(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    return table.withColumns({k: F.when(where, v).otherwise(F.col(k)) for k, v in values.items()})


def delete(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), list(on), "left_anti")


def with_children(parent: DataFrame, children: DataFrame, link: Sequence[str], parent_key: str) -> DataFrame:
    """Children with the generated key of their parent."""
    return children.join(parent.select(*link, parent_key), list(link)).drop(*[c for c in link if c != parent_key])


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows of each key. The rank limit is applied before and after the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def first_wins(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    return top_per(df, keys, [F.col(position).asc()])


def last_wins(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    return top_per(df, keys, [F.col(position).desc()])


def best_wins(df: DataFrame, keys: Sequence[str], score: str, position: str) -> DataFrame:
    """Greatest score (null counts zero); the earlier position wins ties. Rows of a null or empty key are dropped."""
    df = df.filter(" and ".join(f"{k} is not null and cast({k} as string) <> ''" for k in keys))
    return top_per(df, keys, [F.coalesce(F.col(score), F.lit(0.0)).desc(), F.col(position).asc()])


def search(df: DataFrame, word: str, *columns: str) -> DataFrame:
    """Rows of which a column holds the word, whatever its case; % and _ are plain characters."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(word.lower()))
    return df.filter(hit)


def nonempty(df: DataFrame, column: str) -> DataFrame:
    """Rows whose array has an element; null counts as empty."""
    return df.filter(F.coalesce(F.size(column), F.lit(0)) > 0)


def large_contents(df: DataFrame, body: str, least: int = 2000) -> DataFrame:
    """Rows of more than ``least`` bytes."""
    return df.filter(F.octet_length(body) > least)


def numbered_page(df: DataFrame, order: Sequence[Column], page_no: int, size: int) -> DataFrame:
    """Page ``page_no`` (from 1) of ``size`` rows in the given order."""
    return df.orderBy(*order).offset((page_no - 1) * size).limit(size)


def capped(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, body: str, size: int) -> DataFrame:
    """First ``n`` rows of each key, their text cut to ``size`` characters: what a model is shown."""
    return top_per(df, keys, order, n).withColumn(body, F.left(body, F.lit(size)))


def placed(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Adds the place of each row in an order over all rows, from 1.

    Rows are sorted by range and written; the sizes of the ranges, one number
    each, tell where every range begins.
    """
    where = work_folder(df.sparkSession, "placed")
    df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(where)
    rows = df.sparkSession.read.parquet(where).withColumn("_range", F.shiftright("_id", 33))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r["_range"], total))
        total += r["n"]
    begin = F.broadcast(df.sparkSession.createDataFrame(starts, "_range long, _begin long"))  # one row a range
    return rows.join(begin, "_range").withColumn(name, F.col("_begin") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id", "_range", "_begin")
