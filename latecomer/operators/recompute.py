"""Apply layer of group recompute (C4, C6, C7): read the source's affected partitions of
this run, recompute those groups from all their rows and replace them in the target."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset, Lake
from ..sinks.cursor import consume, pending
from ..sinks.tables import replace_groups
from ..sources.tables import affected, read, read_changed_groups, table_exists
from .groups import group_predicate, recompute_groups, rows_in_groups


def recompute(lake: Lake, source: Dataset, target: Dataset, group_cols,
              aggregate: Callable[[DataFrame], DataFrame],
              derive: Callable[[DataFrame], DataFrame] | None = None) -> bool:
    """Recompute the groups that the source changed since ``target`` last took its changes in (runs whose hop was
    skipped included). No-op (returns False) when there are none.

    ``derive`` adds derived group columns (e.g. quarter from month) to both the change
    set and the source rows before grouping (D8)."""
    cols = list(group_cols)
    runs, taken = pending(lake, source, target)
    # a source with group_by names the exact groups it changed, others the partitions
    grain = list(source.group_by or source.partition_by)
    changed = affected(lake, source, "groups" if source.group_by else "partitions", runs)
    missing = [c for c in cols if c not in changed.columns]
    if derive is None and missing:
        raise ValueError(f"group columns {missing} are not in the source's partition grain {changed.columns}")
    if changed.isEmpty():
        consume(lake, source, target, taken)
        return False
    rows = read(lake, source)
    if derive is not None:
        # the source partitions of the changed derived groups, derived from the (few) distinct
        # partition tuples; the semi join on them prunes the scan before rows are derived
        changed = derive(changed)
        wanted = rows_in_groups(derive(rows.select(*grain).distinct()), changed, cols).select(*grain)
        rows = derive(rows_in_groups(rows, wanted, grain))
    # the marker table itself is the selective side of the semi join: Spark prunes the
    # source's partitions from it at run time, whatever the types of the group columns
    scoped = derive is None and bool(source.group_by) and set(cols) == set(grain)
    if scoped:
        rows = read_changed_groups(lake, source, changed)
    groups, fresh = recompute_groups(rows, changed, cols, aggregate, scoped=scoped)
    replace_groups(lake, target, fresh, groups, cols, groups_checked=True)
    consume(lake, source, target, taken)
    return True


def backfill(lake: Lake, source: Dataset, target: Dataset, group_cols,
             aggregate: Callable[[DataFrame], DataFrame], lower=None, upper=None,
             on: str | None = None, named_groups=None) -> bool:
    """Recompute every group of the source (full backfill), those whose ``on`` column
    lies in ``[lower, upper]`` (ranged backfill), or a few groups named by hand
    (``named_groups``: tuples; a literal OR-of-ANDs predicate, P6/P7, that prunes
    partitions statically). The groups are then replaced in the target."""
    cols = list(group_cols)

    def chosen(rows: DataFrame) -> DataFrame:
        if named_groups is not None:
            rows = rows.where(group_predicate(named_groups, cols))
        if on is not None and lower is not None:
            rows = rows.where(F.col(on) >= F.lit(lower))
        if on is not None and upper is not None:
            rows = rows.where(F.col(on) <= F.lit(upper))
        return rows

    return refill(lake, source, target, cols, aggregate, chosen)


def refill(lake: Lake, source: Dataset, target: Dataset, group_cols, aggregate: Callable[[DataFrame], DataFrame],
           chosen: Callable[[DataFrame], DataFrame]) -> bool:
    """Recompute the groups that ``chosen`` leaves of the source's and the target's rows (a filter on group columns)."""
    cols = list(group_cols)
    rows = chosen(read(lake, source))
    groups = rows.select(*cols)
    if table_exists(lake, target):
        # a group that has left the source is replaced by nothing
        groups = groups.unionByName(chosen(read(lake, target)).select(*cols))
    groups = groups.distinct()
    if groups.isEmpty():
        return False
    fresh = aggregate(rows_in_groups(rows, groups, cols))
    replace_groups(lake, target, fresh, groups, cols)
    return True
