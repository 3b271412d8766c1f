"""History over the landed runs (D1, D2, D3): bronze keeps every run's slice, so earlier
states can be replayed and versioned with plain aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import RUN_COL
from .changes import (INCREMENTAL, SNAPSHOT, _check_mode, anti_by_key, dedup_latest,
                      null_safe_row_equal)


def as_of(bronze: DataFrame, keys, run_ts: str, mode: str = INCREMENTAL, order_cols=(),
          run_col: str = RUN_COL, runs: DataFrame | None = None) -> DataFrame:
    """The table as it stood after run ``run_ts``.

    * incremental sources: the latest row per key over all runs ``<= run_ts``;
    * snapshot sources: the newest slice ``<= run_ts``, deduplicated. ``runs`` (a column of
      all run ids, such as the audit table) names runs that delivered nothing: after an
      empty snapshot the table is empty.
    Run ids must sort in run order (timestamps do)."""
    _check_mode(mode)
    upto = bronze.where(F.col(run_col) <= F.lit(run_ts))
    if mode == SNAPSHOT:
        known = upto.select(run_col) if runs is None else upto.select(run_col).union(
            runs.select(run_col).where(F.col(run_col) <= F.lit(run_ts)))
        newest = known.agg(F.max(run_col).alias(run_col))       # one row: a proven size bound
        upto = upto.join(F.broadcast(newest), run_col, "left_semi")
    return dedup_latest(upto, keys, [run_col, *order_cols]).drop(run_col)


def scd2(bronze: DataFrame, keys, value_cols, order_cols=(), run_col: str = RUN_COL) -> DataFrame:
    """Type-2 history: one row per version of a key with ``valid_from`` (the run that
    introduced it), ``valid_to`` (the run that replaced it, NULL if current) and
    ``is_current``. A run that re-delivers the same values opens no new version.

    Each key is first reduced to one row per run (an aggregate), so a window partition
    holds at most one row per run of that key: bounded by the number of runs."""
    keys, value_cols = list(keys), list(value_cols)
    per_run = dedup_latest(bronze.select(*keys, *value_cols, *order_cols, run_col),
                           [*keys, run_col], list(order_cols)).select(*keys, *value_cols, run_col)
    w = Window.partitionBy(*keys).orderBy(run_col)
    prev = per_run.select(*keys, run_col, *value_cols,
                          *[F.lag(c).over(w).alias(f"_prev_{c}") for c in value_cols],
                          F.lag(run_col).over(w).alias("_prev_run"))
    same = F.lit(True)
    for c in value_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_prev_{c}"))
    versions = prev.where(F.col("_prev_run").isNull() | ~same).select(*keys, *value_cols, run_col)
    out = versions.select(*keys, *value_cols, F.col(run_col).alias("valid_from"),
                          F.lead(run_col).over(w).alias("valid_to"))
    return out.withColumn("is_current", F.col("valid_to").isNull())


def split_tombstones(batch: DataFrame, keys, flag_col: str = "is_deleted") -> tuple[DataFrame, DataFrame]:
    """D3: separate a batch that marks deletions with a flag into (upserts, deleted keys)."""
    flag = F.coalesce(F.col(flag_col), F.lit(False))
    return batch.where(~flag).drop(flag_col), batch.where(flag).select(*keys).distinct()


def merge_with_tombstones(target: DataFrame, batch: DataFrame, keys, flag_col: str = "is_deleted") -> DataFrame:
    """D3 pure layer: incremental merge, then removal of the flagged keys."""
    keys = list(keys)
    upserts, gone = split_tombstones(batch, keys, flag_col)
    kept = anti_by_key(target, upserts, keys).unionByName(upserts.select(*target.columns))
    return anti_by_key(kept, gone, keys)


__all__ = ["as_of", "scd2", "split_tombstones", "merge_with_tombstones", "null_safe_row_equal"]
