"""Mergeable sub-aggregates of hot groups (A4, C4): a group's rows are cut into slices, each with a state of its own.

A group that holds a third of the table would be read whole for one late row. Here the change set of the facts names
(group, slice), so a recompute reads the changed slices only; the group's aggregate is then merged from its slices' states.
Minimum and maximum need no inverse: a slice that lost a row is aggregated anew from its rows. Distinct values are counted by
an HLL sketch, which merges without error of its own.

The facts are a bucketed dataset whose ``group_by`` is the group and ``slice``; the states are one of the same grain.

Cases: NULL groups are groups; a slice without rows has no state, a group without slices no aggregate; a group of NULL values
only has the count of its rows and NULL elsewhere (0 distinct values).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, IntegerType, LongType, StructField, StructType

from ..dataset import Dataset, Lake
from .recompute import recompute

SLICE_COL = "slice"
#: Rows, values, total, least, greatest and the sketch of distinct values.
STATE = ("n_rows", "n_values", "total", "least", "greatest", "distinct_sketch")
#: 2^12 registers: a standard error of 1.6 % and about 4 KB a state at most.
SKETCH_BITS = 12


def sliced(rows: DataFrame, key, slices: int) -> DataFrame:
    """``rows`` with the slice of each row; a key always falls into the same slice, so an update finds its old row there."""
    return rows.withColumn(SLICE_COL, F.pmod(F.xxhash64(*key), F.lit(slices)).cast("int"))


def state_fields(measure: DataType, total: DataType) -> list[StructField]:
    """The fields of a state, to follow the group columns (and, in the table of slices, ``slice``)."""
    kinds = (LongType(), LongType(), total, measure, measure, BinaryType())
    return [StructField(name, kind, True) for name, kind in zip(STATE, kinds)]


def states_schema(groups: StructType, measure: DataType, total: DataType) -> StructType:
    return StructType([*groups.fields, StructField(SLICE_COL, IntegerType(), True), *state_fields(measure, total)])


def slice_states(rows: DataFrame, group_cols, measure: str, distinct: str | None = None) -> DataFrame:
    """The state of each (group, slice) from its rows; ``distinct`` names the column whose values are told apart."""
    told_apart = F.col(distinct or measure)
    # sketches take no decimals, doubles or dates; a NULL isn't a value
    value = F.when(told_apart.isNotNull(), F.xxhash64(told_apart))
    return rows.groupBy(*group_cols, SLICE_COL).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(measure).alias("n_values"), F.sum(measure).alias("total"),
        F.min(measure).alias("least"), F.max(measure).alias("greatest"),
        F.hll_sketch_agg(value, SKETCH_BITS).alias("distinct_sketch"))


def merged(states: DataFrame, group_cols) -> DataFrame:
    """The state of each group from the states of its slices (or of any parts of it)."""
    return states.groupBy(*group_cols).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"))


def mean() -> Column:
    return F.when(F.col("n_values") > 0, F.col("total").cast("double") / F.col("n_values")).alias("mean")


def n_distinct() -> Column:
    """Estimated number of distinct values."""
    return F.hll_sketch_estimate("distinct_sketch").alias("n_distinct")


def recompute_states(lake: Lake, source: Dataset, states: Dataset, target: Dataset, group_cols,
                     aggregate: Callable[[DataFrame], DataFrame],
                     combine: Callable[[DataFrame], DataFrame] | None = None) -> bool:
    """Bring ``states`` and ``target`` up to date with the changes of ``source``.

    ``aggregate`` makes states from facts (:func:`slice_states`), ``combine`` a target row from the states of a group
    (:func:`merged` when not given)."""
    cols = list(group_cols)
    for ds in (source, states):
        if tuple(ds.group_by) != (*cols, SLICE_COL):
            raise ValueError(f"{ds.rel()}: changes must be recorded by {[*cols, SLICE_COL]}, not {list(ds.group_by)}")
    recompute(lake, source, states, (*cols, SLICE_COL), aggregate)
    return recompute(lake, states, target, cols, combine or (lambda found: merged(found, cols)))
