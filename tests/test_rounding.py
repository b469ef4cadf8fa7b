"""Rounding as the SQL has it."""

from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from lexicarta.functions.numbers import rounded
from lexicarta.plans import detection_queries


def test_rounding_of_curves(spark):
    values = [i / 10000 / 100 for i in range(20000)] + [0.0, -0.0045 / 100, 1.5, 1e300, float("inf")]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", rounded(F.col("v"), 5).alias("r")).collect()
    assert len(got) == len(values)
    want = dict(duckdb.connect().execute("SELECT v, round(v, 5) FROM (SELECT unnest(?) AS v)", [values]).fetchall())
    assert all(r.r == want[r.v] for r in got)


def test_curves_of_values_around_zero(spark, tmp_path):
    """What is rounded to zero keeps its sign, through the CSV file too; texts are compared, since -0.0 equals 0.0."""
    values = [0.0, -0.0, 1e-9, -1e-9, -0.0004, 0.0005, -0.0006, -1.5, 1e304, -1e304, float("inf"), float("-inf"), float("nan"), None]
    rows = [(None if i == 5 else i, datetime(2024, 1, 9 if i % 2 else 10), v) for i, v in enumerate(values * 2)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((str(tuple(r)) for r in detection_queries.curve_scan(spark, str(tmp_path)).collect()), key=str)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(str(r) for r in db.execute(detection_queries.ORACLES["curve_scan"]).fetchall())
    assert got == want and any("-0.0" in r for r in want)
