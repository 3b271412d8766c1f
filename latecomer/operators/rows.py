"""Row-level propagation (C5, S4, J3, U2): only the rows whose key changed upstream are
transformed and upserted downstream; keys deleted upstream are deleted downstream too
(quirk X2 fixed)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame

from ..dataset import Dataset, Lake
from ..sinks.cursor import consume, pending
from ..sinks.tables import upsert
from ..sources.tables import affected, read_keys
from .changes import anti_by_key


def map_changed_result(source_rows: DataFrame, keys_df: DataFrame, keys,
                       transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pure layer: the transformed current rows of the changed keys."""
    keys = list(keys)
    rows = source_rows.join(keys_df.select(*keys).distinct(), keys, "left_semi")
    return rows.transform(transform)


def map_changed(lake: Lake, source: Dataset, target: Dataset,
                transform: Callable[[DataFrame], DataFrame], order_cols=()) -> bool:
    """Apply layer: read the keys that the source changed since ``target`` last took its changes in, transform their
    current rows, upsert them into ``target`` and delete the keys the source deleted (those that have come back since
    are kept). Returns False (and writes nothing) when nothing changed."""
    runs, taken = pending(lake, source, target)
    keys = affected(lake, source, "keys", runs)
    deleted = affected(lake, source, "deleted_keys", runs)
    none_deleted = deleted.isEmpty()
    if none_deleted and keys.isEmpty():
        consume(lake, source, target, taken)
        return False
    # every changed row lies in a partition of the change set: prune to those before the key join
    within = affected(lake, source, "partitions", runs) if source.partition_by else None
    now = read_keys(lake, source, keys, within)
    gone = None
    if not none_deleted:
        # one run's deleted keys aren't in its batch; over several runs a key may have come back
        gone = deleted if len(runs) == 1 else anti_by_key(deleted, now, source.key)
    upsert(lake, target, now.transform(transform), "incremental", order_cols=order_cols, delete_keys=gone)
    consume(lake, source, target, taken)
    return True
