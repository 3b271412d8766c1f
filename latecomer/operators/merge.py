"""Keyed upsert, pure layer.

MERGE semantics without MERGE: the matched target rows are replaced in full, unmatched
batch rows are inserted, and in snapshot mode target rows missing from the batch are
deleted. Keys match by plain equality, so a NULL key never matches (quirk X9 kept).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .changes import INCREMENTAL, SNAPSHOT, _check_mode, anti_by_key


def merge_result(target: DataFrame, batch: DataFrame, keys, mode: str = INCREMENTAL) -> DataFrame:
    """Rows of the table after the upsert. ``batch`` must already be unique on ``keys``."""
    _check_mode(mode)
    cols = target.columns
    b = batch.select(*cols)
    if mode == SNAPSHOT:
        return b
    return anti_by_key(target, b, keys).unionByName(b)


def merge_partitions(scope: DataFrame, batch: DataFrame, keys, mode: str = INCREMENTAL) -> DataFrame:
    """New content of the affected partitions: ``scope`` is the target restricted to the
    affected partitions. For a snapshot the rows outside the batch are dropped; for an
    incremental merge they are kept."""
    _check_mode(mode)
    cols = scope.columns
    b = batch.select(*cols)
    if mode == SNAPSHOT:
        return b
    return anti_by_key(scope, b, keys).unionByName(b)


__all__ = ["merge_result", "merge_partitions", "INCREMENTAL", "SNAPSHOT"]
