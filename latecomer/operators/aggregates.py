"""Aggregates used by group recompute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped_sum(facts: DataFrame, group_cols, measure: str, alias: str | None = None) -> DataFrame:
    """A1: sum of ``measure`` per group; an all-NULL group sums to 0 (quirk X10 kept)."""
    zero = F.lit(0).cast(facts.schema[measure].dataType)
    return facts.groupBy(*group_cols).agg(F.coalesce(F.sum(measure), zero).alias(alias or measure))


def top_counts(df: DataFrame, col: str, limit: int = 1000, count_alias: str = "count") -> DataFrame:
    """A5 / O1 / O2: COUNT(*) by ``col``, most frequent first (ties by value), top ``limit``.
    Planned as a partial count then TakeOrderedAndProject: only ``limit`` rows per task
    reach the final merge."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias(count_alias))
            .orderBy(F.col(count_alias).desc(), F.col(col).asc_nulls_last()).limit(limit))
