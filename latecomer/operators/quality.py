"""Data-quality checks and run audit (D4, D5, C9 reporting).

Checks are one pass of aggregates per rule; the audit uses ``DataFrame.observe`` so the
counts are collected by the same jobs that do the work (no extra scan)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

CHECK_SCHEMA = StructType([StructField("rule", StringType(), False), StructField("failing_rows", LongType(), False)])


def quality_checks(df: DataFrame, keys, partition_by=()) -> DataFrame:
    """Rows with a NULL key part, rows whose key occurs more than once (X9 reports the
    NULL-key rows MERGE keeps re-inserting), rows with a NULL partition value.

    Duplicates are counted with a grouped count by key: combined map-side, so a hot key
    costs one row per task in the shuffle."""
    keys = list(keys)
    any_null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    flat = df.agg(
        F.sum(F.when(any_null_key, 1).otherwise(0)).cast("bigint").alias("null_key"),
        (F.sum(F.when(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in partition_by]), 1).otherwise(0))
         if partition_by else F.lit(0)).cast("bigint").alias("null_partition"))
    dups = (df.where(~any_null_key).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("duplicate_key")))
    per_rule = flat.select(F.explode(F.array(
        F.struct(F.lit("null_key").alias("rule"), F.col("null_key").alias("failing_rows")),
        F.struct(F.lit("null_partition").alias("rule"), F.col("null_partition").alias("failing_rows")),
    )).alias("r")).select("r.*")
    return per_rule.unionByName(dups.select(F.lit("duplicate_key").alias("rule"),
                                            F.col("duplicate_key").alias("failing_rows")))


def observed(df: DataFrame, name: str, **counts) -> tuple[DataFrame, Observation]:
    """Attach named aggregate metrics to ``df``; read them after the action ran."""
    obs = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows")] + [c.alias(n) for n, c in counts.items()]
    return df.observe(obs, *metrics), obs


AUDIT_SCHEMA = StructType([
    StructField("run_ts", StringType(), False),
    StructField("dataset", StringType(), False),
    StructField("rows_in", LongType(), True),
    StructField("rows_written", LongType(), True),
    StructField("changed_keys", LongType(), True),
    StructField("affected_partitions", LongType(), True),
    StructField("deleted_keys", LongType(), True),
])


def audit_row(spark: SparkSession, run_ts: str, dataset: str, rows_in: int, rows_written: int,
              changed_keys: int, affected_partitions: int, deleted_keys: int) -> DataFrame:
    """One audit record (a handful of scalars from observed metrics, not rows)."""
    return spark.createDataFrame(
        [(run_ts, dataset, rows_in, rows_written, changed_keys, affected_partitions, deleted_keys)], AUDIT_SCHEMA)
