"""Restartable backfill (D6): a full recompute in ranges of about equal rows, each recorded once it is done.

The ranges are cut from a histogram of one group column, weighted by rows, and written down before the first one runs. A backfill
that stops (a failure, or ``at_most`` ranges in one go) goes on with the ranges that aren't recorded as done. A failure
between a range's replace and its record repeats that range, which gives the same rows.

Cases: rows whose column is NULL are a range of their own; one value is never split, so a value with most of the rows is a range;
a group that left the source is replaced by nothing; values that come up after the ranges were cut reach the target by
their run's change set; an empty source and target give no ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .. import fs
from ..dataset import Dataset, Lake
from ..session import release, stage
from ..sources.tables import read, table_exists
from .recompute import refill

#: The range of the rows without a value.
NULL_RANGE = -1


def balanced_ranges(counts: DataFrame, on: str, ranges: int) -> DataFrame:
    """(range_no, lower, upper, rows) from (``on``, n): consecutive values, about a ``ranges``-th of all rows in each.

    The running sum is taken within range partitions and raised by the totals of the partitions before: no task orders all values.
    """
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = counts.where(F.col(on).isNotNull()).repartitionByRange(parts, on).withColumn("part", F.spark_partition_id())
    known, path = stage(known, "histogram")             # a partition's number must not change under a retry
    try:
        within = Window.partitionBy("part").orderBy(on)
        # as many rows as partitions
        parts_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        totals = known.groupBy("part").agg(F.sum("n").alias("held")).select(
            "part", F.coalesce(F.sum("held").over(parts_before), F.lit(0)).alias("offset"),
            F.greatest(F.sum("held").over(Window.partitionBy()), F.lit(1)).alias("total"))
        placed = known.join(F.broadcast(totals), "part").withColumn(
            "before", F.col("offset") + F.sum("n").over(within) - F.col("n"))
        number = F.least(F.expr(f"(before * {int(ranges)}) div total"), F.lit(ranges - 1)).cast("int")
        found = placed.groupBy(number.alias("range_no")).agg(
            F.min(on).alias("lower"), F.max(on).alias("upper"), F.sum("n").alias("rows"))
        nulls = counts.where(F.col(on).isNull()).groupBy(F.lit(NULL_RANGE).alias("range_no")).agg(
            F.min(on).alias("lower"), F.max(on).alias("upper"), F.sum("n").alias("rows"))
        return stage(found.unionByName(nulls), "ranges")[0]
    finally:
        release(path, spark)


def _folder(lake: Lake, name: str, target: Dataset, part: str) -> str:
    return f"{lake.root.rstrip('/')}/_backfills/{target.rel()}/{name}/{part}"


def _plan(lake: Lake, name: str, source: Dataset, target: Dataset, on: str, ranges: int) -> DataFrame:
    """The ranges of the backfill, cut at its first start; a write that never ended doesn't count."""
    path = _folder(lake, name, target, "plan")
    value = source.schema[on].dataType
    schema = StructType([StructField("range_no", IntegerType()), StructField("lower", value), StructField("upper", value),
                         StructField("rows", LongType())])
    if not fs.exists(lake.spark, f"{path}/_SUCCESS"):
        counts = read(lake, source).groupBy(on).agg(F.count(F.lit(1)).alias("n"))
        if table_exists(lake, target):                  # values that only the target still has
            old = read(lake, target).select(F.col(on).cast(value).alias(on)).distinct().withColumn("n", F.lit(0))
            counts = counts.unionByName(old).groupBy(on).agg(F.sum("n").alias("n"))
        balanced_ranges(counts, on, ranges).coalesce(1).write.mode("overwrite").parquet(path)
    return lake.spark.read.schema(schema).parquet(path)


def _done(lake: Lake, name: str, target: Dataset) -> set[int]:
    path = _folder(lake, name, target, "done")
    if not fs.exists(lake.spark, path):
        return set()
    return {r[0] for r in lake.spark.read.schema("range_no int").parquet(path).collect()}      # a row a range


def progress(lake: Lake, name: str, source: Dataset, target: Dataset, on: str) -> DataFrame:
    """(range_no, lower, upper, rows, done) of a backfill that has been started."""
    if not fs.exists(lake.spark, f"{_folder(lake, name, target, 'plan')}/_SUCCESS"):
        raise ValueError(f"backfill {name!r} of {target.rel()} hasn't been started")
    done = F.col("range_no").isin(*_done(lake, name, target) or {None})
    return _plan(lake, name, source, target, on, 1).withColumn("done", F.coalesce(done, F.lit(False)))


def _within(on: str, row) -> Column:
    return F.col(on).isNull() if row.range_no == NULL_RANGE else F.col(on).between(F.lit(row.lower), F.lit(row.upper))


def backfill_in_ranges(lake: Lake, name: str, source: Dataset, target: Dataset, group_cols,
                       aggregate: Callable[[DataFrame], DataFrame], on: str, ranges: int = 16,
                       at_most: int | None = None) -> list[int]:
    """Recompute all groups, range by range of the group column ``on``; returns the ranges done by this call.

    ``name`` names the backfill: a call with the same name goes on where an earlier one stopped, and does nothing once all
    ranges are done."""
    cols = list(group_cols)
    if on not in cols:
        raise ValueError(f"{on!r} is not a group column: a group could lie in two ranges")
    if ranges < 1:
        raise ValueError("a backfill needs at least one range")
    done = _done(lake, name, target)
    plan = _plan(lake, name, source, target, on, ranges).orderBy("range_no").collect()         # ranges + 1 rows at most
    taken = []
    for row in [r for r in plan if r.range_no not in done][:at_most]:
        refill(lake, source, target, cols, aggregate, lambda rows, row=row: rows.where(_within(on, row)))
        lake.spark.range(0, 1, 1, 1).select(F.lit(row.range_no).alias("range_no")).write.mode("append").parquet(
            _folder(lake, name, target, "done"))
        taken.append(row.range_no)
    return taken
