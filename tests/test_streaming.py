"""Incremental forms give what a batch run gives."""

import json

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from palimpsest import streaming

SCHEMA = StructType([StructField("key", StringType()), StructField("body", StringType()), StructField("at", TimestampType())])


def source(spark, folder):
    return streaming.new_files(spark, str(folder), SCHEMA, per_batch=1)


def add(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps({"key": k, "body": b, "at": t}) for k, b, t in rows))


def test_content_once_and_last_status(spark, tmp_path):
    folder, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    folder.mkdir()
    add(folder, "1.json", [("a", "x", "2024-01-01T00:00:00"), ("a", "x", "2024-01-01T00:01:00"), ("b", "x", "2024-01-01T00:02:00")])
    add(folder, "2.json", [("a", "y", "2024-01-01T00:05:00"), ("a", "x", "2024-01-01T00:06:00")])
    once = streaming.new_content(source(spark, folder), "key", "body", "at")
    once.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r["key"], r["body"]) for r in spark.read.parquet(out).collect()) == [("a", "x"), ("a", "y"), ("b", "x")]

    log = str(tmp_path / "log")
    streaming.latest_status(source(spark, folder), "key", "body", "at", log, str(tmp_path / "marks2")).trigger(availableNow=True).start().awaitTermination(120)
    last = spark.read.parquet(log).groupBy("key").agg(F.max_by("body", "at").alias("body"))
    assert {r["key"]: r["body"] for r in last.collect()} == {"a": "x", "b": "x"}


def test_daily_counters(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    add(folder, "1.json", [("a", "x", "2024-01-01T10:00:00"), ("a", "y", "2024-01-01T23:00:00"), ("b", "x", "2024-01-02T00:02:00")])
    counted = streaming.daily_counters(source(spark, folder), "key", "at")
    counted.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert {(r["key"], r["n"]) for r in spark.table("daily").collect()} == {("a", 2), ("b", 1)}
