"""A third of all rows on one key: results stay exact, and with shuffle joins AQE splits
the hot partition (thresholds lowered so a small fixture counts as skewed)."""

import pytest
from pyspark.sql import functions as F

from latecomer.operators.changes import dedup_latest
from latecomer.operators.groups import rows_in_groups
from latecomer.operators.nearest import nearest_place

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def skew_session(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _final_plan(df) -> str:
    df.collect()                       # runs this DataFrame's own adaptive plan to completion
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_group_join_is_split_and_exact(skew_session):
    spark = skew_session
    n = 30000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("g"),   # g = 0 holds 1/3
        F.col("id").alias("v"))
    groups = spark.range(0, n, 7).select(F.col("id").alias("g"))
    joined = rows_in_groups(rows, groups, ["g"], has_null=False)
    plan = _final_plan(joined)
    assert "isSkewJoin=true" in plan or "skew=true" in plan
    expected = rows.where((F.col("g") % 7) == 0).count()
    assert joined.count() == expected


def test_hot_key_dedup_is_exact(spark):
    n = 30000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
                                 F.col("id").alias("ord"))
    out = {r.k: r.ord for r in dedup_latest(rows, ["k"], ["ord"]).where("k = -1 or k = 1").collect()}
    assert out == {-1: n - (n % 3 or 3), 1: 1}


def test_hot_cell_nearest_is_exact(skew_session):
    spark = skew_session
    pts = spark.range(6000).select(
        F.col("id").alias("pid"),
        F.when(F.col("id") % 3 == 0, F.lit(48.85)).otherwise((F.col("id") % 170) - 85.0).alias("lat"),
        F.when(F.col("id") % 3 == 0, F.lit(2.35)).otherwise((F.col("id") * 7 % 360) - 180.0).alias("lon"))
    places = spark.createDataFrame([(1, 48.86, 2.34), (2, 48.80, 2.40), (3, 0.0, 0.0), (4, -30.0, 100.0)],
                                   "place_id long, lat double, lon double")
    got = {r.pid: r.place_id for r in nearest_place(pts, places, "pid", "place_id").collect()}
    assert all(got[p] == 1 for p in range(0, 6000, 3))     # every point of the hot cell -> Paris-ish place 1
    assert len(got) == 6000 and all(v is not None for v in got.values())
