"""Clustering compaction: which files are rewritten, and in what order their rows lie."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from latecomer.dataset import Dataset, Lake
from latecomer.sinks.maintenance import cluster, curve, layout
from latecomer.sinks.tables import write
from latecomer.sources.tables import read

FACT = StructType([StructField("a", LongType()), StructField("b", DoubleType()), StructField("p", StringType())])
TABLE = Dataset("silver", "z", "t", FACT, ("a",), ("p",))


@pytest.fixture()
def lake(spark, lake_root):
    return Lake(spark, lake_root)


def test_only_fragmented_partitions_are_rewritten(lake):
    for k in range(3):
        rows = [(i, float(i % 7), "x") for i in range(k, 90, 3)] + ([(1000, None, None), (1001, 1.0, "whole")] if k == 0 else [])
        write(lake, TABLE, lake.spark.createDataFrame(rows, FACT), "overwrite" if k == 0 else "append")
    kept = os.listdir(f"{lake.path(TABLE)}/p=whole")
    want = sorted(map(tuple, read(lake, TABLE).collect()), key=str)
    found = {r.p: (r.files, r.rows) for r in cluster(lake, TABLE, ("a", "b")).collect()}
    assert found == {"x": (3, 90)}
    assert {r.p: (r.files, r.rows) for r in layout(lake, TABLE).collect()} == {"x": (1, 90), None: (1, 1), "whole": (1, 1)}
    assert os.listdir(f"{lake.path(TABLE)}/p=whole") == kept
    assert sorted(map(tuple, read(lake, TABLE).collect()), key=str) == want
    assert cluster(lake, TABLE, ("a", "b")).isEmpty()


def test_rows_follow_the_curve(lake):
    grid = lake.spark.range(256).select((F.col("id") % 16).alias("a"), F.floor(F.col("id") / 16).cast("double").alias("b"), F.lit("x").alias("p"))
    placed = grid.withColumn("z", curve(grid, ("a", "b"), 4)).collect()
    assert len({r.z for r in placed}) == 256
    # a sixteenth of the curve covers a square of a sixteenth of the plane
    first = [r for r in placed if r.z < 16]
    assert len(first) == 16 and {r.a for r in first} == {0, 1, 2, 3} and {r.b for r in first} == {0.0, 1.0, 2.0, 3.0}
    odd = lake.spark.createDataFrame([(None, None, None), (1, float("nan"), "s")], FACT)
    assert odd.withColumn("z", curve(odd, ("a", "b", "p"))).count() == 2
