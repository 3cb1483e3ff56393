"""Writing: whole tables swapped in at once, catalog tables, batches of points, reports as pages."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.functions.text import blank_to_null


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _path(spark, path)
    return store.exists(at)


def remove(spark: SparkSession, path: str) -> bool:
    store, at = _path(spark, path)
    return store.delete(at, True)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, which a cluster must name; a local run may do without."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="palimpsest-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more, as after a write."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def staged_write(df: DataFrame, path: str) -> None:
    """Write beside ``path`` and swap when all is written. For one table that nobody reads meanwhile.

    The old table is moved aside before the new one is moved in, and removed
    after that: between the two moves there is none at ``path``, and ``recover`` puts
    the old one back if the driver dies there. Use ``units.Store`` where readers
    must find a table at every moment.
    """
    spark = df.sparkSession
    recover(spark, path)
    staged, aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}", f"{path.rstrip('/')}-old"
    df.write.parquet(staged)
    store, at = _path(spark, path)
    old, new = _path(spark, aside)[1], _path(spark, staged)[1]
    if store.exists(at) and not store.rename(at, old):
        raise OSError(f"{path} could not be moved aside")
    if not store.rename(new, at):
        raise OSError(f"{staged} could not be renamed to {path}")
    store.delete(old, True)


def recover(spark: SparkSession, path: str) -> bool:
    """Put back a table that a swap has moved aside and not replaced; whether there was one."""
    store, at = _path(spark, path)
    old = _path(spark, f"{path.rstrip('/')}-old")[1]
    if not store.exists(old):
        return False
    if store.exists(at):
        return not store.delete(old, True)
    return store.rename(old, at)


def create_table(spark: SparkSession, name: str, schema: StructType | str) -> None:
    """An empty Parquet table of the catalog, if there is none of the name."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.format("parquet").saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def reset_table(spark: SparkSession, name: str) -> None:
    """The table without its rows."""
    schema = spark.table(name).schema
    drop_table(spark, name)
    create_table(spark, name, schema)


def point_batches(points: DataFrame, document: str, order: str, size: int = 100) -> DataFrame:
    """Adds ``batch``: points of a document in runs of ``size``, for inserts into a store outside."""
    n = F.row_number().over(Window.partitionBy(document).orderBy(order)) - 1
    return points.withColumn("batch", F.floor(n / size))


def upload_uri(bucket: Column, base: Column, category: Column, name: Column) -> Column:
    """``s3://bucket/base/category/name`` with repeated slashes as one; null where the name or the bucket lacks."""
    key = F.regexp_replace(F.concat_ws("/", blank_to_null(base), blank_to_null(category), name), "/{2,}", "/")
    return F.when(blank_to_null(name).isNotNull() & blank_to_null(bucket).isNotNull(), F.concat(F.lit("s3://"), bucket, F.lit("/"), F.regexp_replace(key, "^/", "")))


def escaped(body: Column) -> Column:
    """Text as HTML."""
    out = body
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def report_page(title: Column, sections: Column) -> Column:
    """An HTML page of array<struct<title, content array<string>>>: a heading and a list for each section."""
    item = lambda c: F.concat(F.lit("<li>"), escaped(F.coalesce(c, F.lit(""))), F.lit("</li>"))
    block = lambda s: F.concat(F.lit("<h2>"), escaped(s["title"]), F.lit("</h2><ul>"), F.array_join(F.transform(s["content"], item), ""), F.lit("</ul>"))
    body = F.array_join(F.transform(sections, block), "")
    return F.concat(F.lit("<!DOCTYPE html><html><head><title>"), escaped(title), F.lit("</title></head><body><h1>"), escaped(title), F.lit("</h1>"), body, F.lit("</body></html>"))
