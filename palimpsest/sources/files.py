"""Tables, object listings, glossaries, stores of vectors, and pages."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def pdf_listing(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files of a folder without dot files: path, name, size, modification time; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder).select("path", "length", "modificationTime")
    return files.withColumn("name", F.substring_index("path", "/", -1)).filter(~F.col("name").startswith(".")).orderBy("name")


def modified_since(files: DataFrame, day: date) -> DataFrame:
    return files.filter(F.lower("path").endswith(".pdf") & (F.col("modificationTime") >= F.lit(day).cast("timestamp")))


def of_day(keys: DataFrame, key: str, day: date) -> DataFrame:
    return keys.filter(F.col(key).rlike(f"_{day:%Y%m%d}\\.pdf$"))


def object_rows(keys: DataFrame, key: str) -> DataFrame:
    """Name, country and type from the last parts of a key; keys of folders drop out."""
    parts = F.split(key, "/")
    return keys.filter(~F.col(key).endswith("/")).select("*", F.element_at(parts, -1).alias("name"), F.try_element_at(parts, F.lit(-2)).alias("country"), F.try_element_at(parts, F.lit(-3)).alias("type"))


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """(term, translation) of a JSON object; a missing or bad file has none."""
    try:
        raw = spark.read.text(path, wholetext=True)
        return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("term", "translation"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "term string, translation string")


def write_points(points: DataFrame, path: str, mode: str = "append") -> None:
    """Vectors with their payload as a table; ids follow from the text, so a second insert can be told."""
    points.withColumn("id", F.xxhash64("text")).write.mode(mode).parquet(path)


def verify_points(points: DataFrame, sample: int = 5) -> tuple[int, DataFrame]:
    """Number of points, and the dimensions of some."""
    return points.count(), points.select("id", F.size("dense").alias("dense_size"), F.size("sparse").alias("sparse_size")).orderBy("id").limit(sample)


def text_metadata(body: Column) -> Column:
    words = F.size(F.filter(F.split(F.trim(body), r"\s+"), lambda w: w != ""))
    return F.struct(F.sha2(body, 256).alias("sha256"), F.length(body).alias("n_chars"), words.alias("n_words"))


def snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def new_content(new: DataFrame, stored: DataFrame, key: str, body: str) -> DataFrame:
    """Rows whose key and MD5 are not stored."""
    return new.withColumn("md5", F.md5(F.col(body).cast("binary"))).join(stored.select(key, "md5"), [key, "md5"], "left_anti")


def new_files(new: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose name, size and time were not processed."""
    mark = F.md5(F.concat_ws("_", "name", F.col("size").cast("string"), F.col("modified").cast("string")).cast("binary")).alias("mark")
    return new.select("*", mark).join(done.select(mark), "mark", "left_anti")
