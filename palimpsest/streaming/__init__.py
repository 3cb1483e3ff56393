"""Incremental forms of operators that lend themselves to it. These go beyond what a batch run needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def new_files(spark: SparkSession, folder: str, schema: StructType, kind: str = "json", per_batch: int = 1000) -> DataFrame:
    """Rows of files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(kind).load(folder)


def new_content(stream: DataFrame, key: str, body: str, time: str, delay: str = "1 day") -> DataFrame:
    """Rows whose key and content were not seen within the delay; state older than that is dropped."""
    marked = stream.withColumn("md5", F.md5(F.col(body).cast("binary")))
    return marked.withWatermark(time, delay).dropDuplicatesWithinWatermark([key, "md5"])


def daily_counters(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """Rows for each key and day; late rows count until the delay has passed."""
    window = F.window(time, "1 day")
    return stream.withWatermark(time, delay).groupBy(key, window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("day"), "n")


def latest_status(stream: DataFrame, key: str, status: str, time: str, path: str, checkpoint: str):
    """A query that keeps a table of the last status of each key: every batch adds its last rows to an append log.

    Readers take the greatest time of a key, so a batch that is run twice
    changes nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.max_by(status, time).alias(status), F.max(time).alias(time)).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
