import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.environment["PYTHONPATH"] = ROOT
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its SQL on the same tables and compares the rows."""
    import math

    import duckdb
    import pandas as pd

    def one(value):
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
            return "null"
        return repr(round(float(value), 8)) if isinstance(value, int | float) and not isinstance(value, bool) else str(value)

    def rows(frame, columns):
        return sorted(tuple(map(one, r)) for r in frame[columns].astype(object).itertuples(index=False))

    def check(frame, sql, folder):
        db = duckdb.connect()
        for name in os.listdir(folder):
            db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
        want, got = db.sql(sql).df(), frame.toPandas()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert rows(got, columns) == rows(want, columns)
        return got

    return check
