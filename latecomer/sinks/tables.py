"""Writes to lake datasets (K1-K7): the apply layer over the pure operators.

Plain Parquet has no MERGE or DELETE, so every mutation rewrites only the affected
partition folders with *dynamic partition overwrite* (one job, staged then committed),
and partitions that end up with no rows are removed afterwards.

Commit order (R3): change set first, then data, then the removal of emptied partitions.
A retried run unions its change set with the one its earlier attempt left (quirk X6), so
a partition emptied by the first attempt is still recomputed downstream.
Atomicity is per job, not per table: a crash between the data job and the removal of an
emptied partition leaves that partition's old rows until the run is retried.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import fs
from ..functions.scalar import utc_now_iso
from ..session import release, stage
from ..dataset import BUCKET_COL, INGESTED_COL, RUN_COL, Dataset, Lake
from ..operators.changes import (INCREMENTAL, SNAPSHOT, _check_mode, affected_partitions, anti_by_key,
                                 changed_partitions_only, dedup_latest)
from ..operators.groups import (check_groups, check_within_groups, rows_in_groups,
                                rows_outside_groups)
from ..operators.merge import merge_partitions, merge_result
from ..sources.records import cast_to
from . import checkpoints, index
from ..sources.tables import affected, marker_schema, read, read_with_folders, table_exists


def conform(df: DataFrame, ds: Dataset, also=()) -> DataFrame:
    """Select and cast to the declared schema, in declared order; a value that doesn't convert raises.
    Columns of ``also`` are kept as they are.

    An empty string in a partition column becomes NULL: a partition folder can't tell the two apart."""
    if ds.buckets and BUCKET_COL not in df.columns:
        df = df.withColumn(BUCKET_COL, F.lit(0))
    missing = [c for c in ds.columns() if c not in df.columns]
    if missing:
        raise ValueError(f"{ds.rel()}: missing columns {missing}")
    out = cast_to(df, ds.schema, also)
    if ds.buckets:
        out = out.withColumn(BUCKET_COL, ds.bucket())
    texts = [c for c in ds.partition_by if isinstance(ds.schema[c].dataType, StringType)]
    return out.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in texts}) if texts else out


def _layout(df: DataFrame, ds: Dataset) -> DataFrame:
    """Storage order (partition columns last) and one writer per partition folder.

    ``REBALANCE`` on the partition columns makes each folder come from few tasks (no
    small-file explosion), while AQE still splits a folder that holds a third of all rows
    into several evenly sized tasks. A landing of one run goes to one folder anyway and is
    written as it comes.
    """
    out = df.select(*ds.storage_columns())
    if ds.partition_by and tuple(ds.partition_by) != (RUN_COL,):
        out = out.hint("rebalance", *[F.col(c) for c in ds.partition_by])
    return out


def _refresh(lake: Lake, path: str) -> None:
    lake.spark.catalog.refreshByPath(path)


def write(lake: Lake, ds: Dataset, df: DataFrame, mode: str = "overwrite") -> None:
    """K1: whole-table overwrite or append, partitioned by the dataset's grain."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unknown write mode {mode!r}")
    path = lake.path(ds)
    w = _layout(conform(df, ds), ds).write.mode(mode).option("partitionOverwriteMode", "static")
    if ds.partition_by:
        w = w.partitionBy(*ds.partition_by)
    index.behind(lake, ds)
    w.parquet(path)
    _refresh(lake, path)


def overwrite_partitions(lake: Lake, ds: Dataset, df: DataFrame, path: str | None = None) -> None:
    """Replace exactly the partition folders that ``df`` has rows for."""
    if not ds.partition_by:
        raise ValueError(f"{ds.rel()}: partition overwrite needs partition columns")
    path = path or lake.path(ds)
    (_layout(df, ds).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*ds.partition_by).parquet(path))
    _refresh(lake, path)


def drop_folders(lake: Lake, ds: Dataset, folders: DataFrame | None) -> int:
    """Remove the listed partition folders (paths only, streamed; never rows)."""
    if folders is None:
        return 0
    n = sum(fs.delete(lake.spark, r[0], encoded=True) for r in folders.toLocalIterator())
    _refresh(lake, lake.path(ds))
    return n


def _emptied(lake: Lake, ds: Dataset, affected_parts: DataFrame, incoming: DataFrame, kept: DataFrame) -> DataFrame | None:
    """Folders of affected partitions left without rows, to remove after the rewrite (a
    dynamic overwrite leaves a partition that gets no rows in place).

    Only affected partitions that receive no incoming rows can empty; usually there are
    none and no further job runs. For the few candidates, the kept rows decide. The folders
    are those of the files that hold the partitions' rows now, so partition values of any type
    are found. The list is fixed before the rewrite."""
    cols = list(ds.partition_by)
    cand = rows_outside_groups(affected_parts.select(*cols).distinct(), incoming.select(*cols), cols)
    if cand.isEmpty():
        return None
    gone = rows_outside_groups(cand, rows_in_groups(kept.select(*cols), cand, cols), cols)
    return stage(rows_in_groups(read_with_folders(lake, ds, cols), gone, cols).select("_folder").distinct(), "emptied")[0]


def _rewrite_whole(lake: Lake, ds: Dataset, rows: DataFrame) -> None:
    """Replace an unpartitioned table by rows computed from it: written beside it, then swapped
    in by two renames. The old folder stays until the new one is in place, so a failed write
    leaves the table as it was."""
    path, tag = lake.path(ds), uuid.uuid4().hex[:12]
    new, old = f"{path}.new-{tag}", f"{path}.old-{tag}"
    try:
        _layout(conform(rows, ds), ds).write.mode("errorifexists").parquet(new)
    except BaseException:
        release(new, lake.spark)
        raise
    fs.rename(lake.spark, path, old)
    try:
        fs.rename(lake.spark, new, path)
    except BaseException:
        fs.rename(lake.spark, old, path)
        raise
    release(old, lake.spark)
    _refresh(lake, path)


# --------------------------------------------------------------------------- bronze

def stamp(df: DataFrame, run_ts: str, ingested_at: str | None = None) -> DataFrame:
    """Literal audit columns."""
    ing = F.lit(ingested_at) if ingested_at is not None else utc_now_iso()
    return df.withColumns({INGESTED_COL: ing.cast("string"), RUN_COL: F.lit(run_ts)})


def write_bronze(lake: Lake, ds: Dataset, df: DataFrame) -> None:
    """Append this run's raw arrivals, idempotently. Bronze is partitioned by
    ``run_ts``; a retry replaces that one folder in a single job (quirk X8 fixed), and an
    empty retry removes what an earlier attempt of the same run left."""
    if tuple(ds.partition_by) != (RUN_COL,):
        raise ValueError(f"{ds.rel()}: bronze must be partitioned by {RUN_COL}")
    stamped = stamp(df, lake.run.run_ts)
    checkpoints.forget_from(lake, ds, lake.run.run_ts)
    if not table_exists(lake, ds):
        write(lake, ds, stamped, "overwrite")
        return
    if stamped.isEmpty():
        left = read_with_folders(lake, ds, [RUN_COL]).where(F.col(RUN_COL) == F.lit(lake.run.run_ts))
        drop_folders(lake, ds, left.select("_folder").distinct())
        return
    overwrite_partitions(lake, ds, conform(stamped, ds))


# --------------------------------------------------------------------------- change channel

def _write_marker(lake: Lake, ds: Dataset, level: str, rows: DataFrame, unique: bool = False) -> None:
    schema = marker_schema(ds, level)
    cols = [f.name for f in schema.fields if f.name != RUN_COL]
    path = lake.marker_path(ds, level)
    run = lake.run.run_ts
    fresh = rows.select(*cols)
    if fs.exists(lake.spark, path):
        # a retried run keeps what its first attempt recorded (quirk X6)
        earlier = affected(lake, ds, level, run)
        if not unique or not earlier.isEmpty():
            fresh, unique = fresh.unionByName(earlier), False
    # the distinct's shuffle already spreads distinct tuples evenly (AQE sizes its output),
    # so the files come straight from it, with no second shuffle
    out = (fresh if unique else fresh.distinct()).withColumn(RUN_COL, F.lit(run)).select(*[f.name for f in schema.fields])
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(RUN_COL).parquet(path))
    _refresh(lake, path)


def record_affected(lake: Lake, ds: Dataset, keys: DataFrame | None = None,
                    partitions: DataFrame | None = None, deleted: DataFrame | None = None,
                    groups: DataFrame | None = None, unique_keys: bool = False) -> None:
    """K7: distinct changed keys / affected partitions / deleted keys / exact groups of this run,
    overwritten per run; nothing is written for an empty set (quirk X13). ``unique_keys``: ``keys`` holds no key twice, so
    it is written as it comes."""
    for level, rows in (("keys", keys), ("partitions", partitions), ("deleted_keys", deleted), ("groups", groups)):
        if rows is None:
            continue
        if level == "partitions" and not ds.partition_by:
            continue
        if level in ("keys", "deleted_keys") and not ds.key:
            continue
        # an empty set writes no partition: the marker stays absent (or, on a retry, keeps
        # what the earlier attempt recorded); no separate emptiness job is needed
        _write_marker(lake, ds, level, rows, unique_keys and level == "keys")
    _write_commit(lake, ds)


def _write_commit(lake: Lake, ds: Dataset) -> None:
    """A new commit id for this run's change set: readers that consumed an earlier attempt's take it in again."""
    path = lake.marker_path(ds, "commits")
    row = lake.spark.range(0, 1, 1, 1).select(F.lit(uuid.uuid4().hex).alias("commit"), F.lit(lake.run.run_ts).alias(RUN_COL))
    (row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(RUN_COL).parquet(path))
    _refresh(lake, path)


# --------------------------------------------------------------------------- upsert

def upsert(lake: Lake, ds: Dataset, batch: DataFrame, mode: str = INCREMENTAL,
           order_cols=(), only_changed: bool = False, delete_keys: DataFrame | None = None,
           written: Observation | None = None) -> None:
    """K3 / K4 / K5: keyed upsert of ``batch`` into ``ds``.

    * create the table on first write (everything affected);
    * otherwise record keys, deleted keys and affected partitions (pre-image of matched
      keys, post-image, deleted), then rewrite only those partitions and remove the ones
      that emptied.
    The batch is deduplicated first (last row by ``order_cols``, full tie-break).
    ``delete_keys`` removes those keys as well (row-level deletes propagated from an
    upstream snapshot, quirk X2, or tombstones, D3).
    ``written`` (an ``Observation``) receives ``rows``: the rows the rewrite job wrote,
    counted by that job itself.
    """
    _check_mode(mode)
    if not ds.key:
        raise ValueError(f"{ds.rel()}: upsert requires a key")
    keys, pcols = list(ds.key), list(ds.partition_by)
    extra = [c for c in order_cols if c not in ds.columns()]       # e.g. an arrival number
    latest = dedup_latest(conform(batch, ds, extra), keys, order_cols).drop(*extra)
    if not table_exists(lake, ds):
        # nothing to read before the write: no staging; the change set comes from the table
        write(lake, ds, _counted(latest, written), "overwrite")
        made = read(lake, ds)
        # one row a key; a key read back from folder names counts as unknown
        unique = not set(keys) & set(pcols)
        record_affected(lake, ds, keys=made.select(*keys), partitions=made.select(*pcols) if pcols else None,
                        groups=made.select(*ds.group_by) if ds.group_by else None, unique_keys=unique)
        if ds.index_buckets:
            index.rebuild(lake, ds, unique)
        return
    # Fixed once, in the shared checkpoint dir: the batch may be derived from the very table
    # this upsert rewrites, and a lost executor must not recompute it from the new files.
    batch, staged = stage(latest, "batch")
    gone = None
    try:
        if delete_keys is not None:
            # read by every step below
            delete_keys, gone = stage(delete_keys.select(*keys).distinct(), "delete")
        _upsert_fixed(lake, ds, batch, keys, pcols, mode, only_changed, delete_keys, written)
    finally:
        release(staged, lake.spark)
        release(gone, lake.spark)


def _counted(df: DataFrame, written: Observation | None) -> DataFrame:
    return df if written is None else df.observe(written, F.count(F.lit(1)).alias("rows"))


def _upsert_fixed(lake: Lake, ds: Dataset, batch: DataFrame, keys, pcols, mode: str,
                  only_changed: bool, delete_keys: DataFrame | None,
                  written: Observation | None = None) -> None:
    target = read(lake, ds)
    batch_keys = batch.select(*keys)                                     # one row a key already
    grain = list(ds.group_by) or pcols                                   # what changes are recorded for
    where = [c for c in dict.fromkeys([*pcols, *grain]) if c not in keys]
    if ds.index_buckets and mode == INCREMENTAL:
        asked = batch_keys if delete_keys is None else batch_keys.unionByName(delete_keys.select(*keys))
        tk = index.lookup(lake, ds, asked).select(*keys, *where)         # the batch's buckets of the index, no scan
    else:
        tk = target.select(*keys, *where)                                # P4: narrow scan
    dropped = None
    if delete_keys is not None:
        dropped = tk.join(delete_keys.select(*keys).distinct(), keys, "left_semi")
    deleted = anti_by_key(tk, batch_keys, keys).select(*keys) if mode == SNAPSHOT else None
    if dropped is not None:
        deleted = dropped.select(*keys) if deleted is None else deleted.unionByName(dropped.select(*keys))
    parts = groups = staged = post = None
    if grain:
        if mode == SNAPSHOT and only_changed:
            parts = changed_partitions_only(target, batch, keys, grain)
        elif mode == SNAPSHOT:
            # every target row is either matched or deleted: all its partitions are affected
            parts = tk.select(*grain).unionByName(batch.select(*grain)).distinct()
        elif ds.group_by:
            parts = affected_partitions(tk, batch, keys, grain, mode)
        else:
            parts, post = _folders_affected(tk, batch, keys, pcols)
        if dropped is not None:
            parts = parts.unionByName(dropped.select(*grain)).distinct()
    if ds.group_by:
        groups, staged = stage(parts, "groups")
        parts = groups.select(ds.bucket()).distinct()                    # the folder follows from the group
    try:
        record_affected(lake, ds, keys=batch_keys, partitions=parts, deleted=deleted, groups=groups, unique_keys=True)
    finally:
        release(staged, lake.spark)
        release(post, lake.spark)
    index.behind(lake, ds)
    _apply_upsert(lake, ds, target, batch, keys, pcols, mode, only_changed, delete_keys, written)
    if ds.index_buckets:
        if mode == SNAPSHOT:
            index.rebuild(lake, ds)
        else:
            kept = batch if delete_keys is None else anti_by_key(batch, delete_keys, keys)
            index.follow(lake, ds, kept, delete_keys)


def _folders_affected(tk: DataFrame, batch: DataFrame, keys, pcols) -> tuple[DataFrame, str]:
    """The partitions of an incremental upsert (see :func:`affected_partitions`) and the folder that holds the batch's own.

    Matched rows in a partition that the batch writes anyway add none, so only the rows of the other partitions are joined by
    key; a batch that reaches every partition needs no join."""
    post, path = stage(batch.select(*pcols).distinct(), "post")
    if rows_outside_groups(tk.select(*pcols), post, pcols).isEmpty():
        return post, path
    return affected_partitions(rows_outside_groups(tk, post, pcols), batch, keys, pcols), path


def _apply_upsert(lake: Lake, ds: Dataset, target: DataFrame, batch: DataFrame, keys, pcols, mode: str, only_changed: bool,
                  delete_keys: DataFrame | None, written: Observation | None) -> None:
    """Rewrite the partitions that the recorded change set names."""
    if not pcols:
        merged = merge_result(target, batch, keys, mode)
        if delete_keys is not None:
            merged = anti_by_key(merged, delete_keys, keys)
        _rewrite_whole(lake, ds, _counted(merged, written))
        return
    committed = affected(lake, ds, "partitions")          # the change set as committed
    scope = rows_in_groups(target, committed, pcols)
    new_rows = merge_partitions(scope, batch, keys, mode)
    if delete_keys is not None:
        new_rows = anti_by_key(new_rows, delete_keys, keys)
    if mode == SNAPSHOT and only_changed:
        # unchanged partitions are not rewritten: restrict the snapshot to the marked ones
        new_rows = rows_in_groups(new_rows, committed, pcols)
    gone = _emptied(lake, ds, committed, batch, new_rows)
    overwrite_partitions(lake, ds, _counted(new_rows, written))
    drop_folders(lake, ds, gone)


# --------------------------------------------------------------------------- group replace

def replace_groups(lake: Lake, ds: Dataset, new_rows: DataFrame, groups: DataFrame,
                   group_cols=None, groups_checked: bool = False) -> None:
    """K6: replace only ``groups`` of ``ds`` by ``new_rows``; other groups keep their files
    untouched; groups without new rows disappear. Emits the *requested* groups as this
    dataset's change set, so an emptied group still reaches the next hop (quirk X3), and, for
    a keyed dataset, the keys of the new rows and the keys that the replaced groups lose.

    Group columns may be coarser than the partitions: every partition that holds rows of a
    group is rewritten. ``groups_checked``: the caller already knows the group set is not empty."""
    cols = list(group_cols or ds.partition_by)
    pcols = list(ds.partition_by)
    if groups_checked:
        missing_cols = [c for c in cols if c not in groups.columns]
        if missing_cols:
            raise ValueError(f"{ds.rel()}: group columns {missing_cols} are not in the change grain")
    else:
        check_groups(groups, cols, ds.rel())
    new_rows, staged = stage(conform(new_rows, ds), "groups")     # computed once, lineage cut
    try:
        _replace_fixed(lake, ds, new_rows, groups, cols, pcols)
    finally:
        release(staged, lake.spark)


def _replace_fixed(lake: Lake, ds: Dataset, new_rows: DataFrame, groups: DataFrame, cols, pcols) -> None:
    check_within_groups(new_rows, groups, cols, ds.rel())
    groups = groups.select(*cols).distinct()
    keys, exact = list(ds.key), list(ds.group_by)
    covered = set(pcols) <= set(cols)
    fresh_keys = new_rows.select(*keys) if keys else None
    if not table_exists(lake, ds):
        write(lake, ds, new_rows, "overwrite")
        touched = groups.select(*pcols) if covered else new_rows.select(*pcols)
        record_affected(lake, ds, keys=fresh_keys, partitions=touched if pcols else None,
                        groups=_exact_groups(new_rows, None, groups, cols, exact) if exact else None)
        if ds.index_buckets and keys:
            index.rebuild(lake, ds)
        return
    target = read(lake, ds)
    scope_of = target
    if exact and set(exact) <= set(cols):
        # the folders follow from the groups: nothing else of the table is read
        touched = groups.select(ds.bucket()).distinct()
        scope_of = rows_in_groups(target, touched, pcols)
    lost = None
    if keys:
        lost = anti_by_key(rows_in_groups(scope_of, groups, cols).select(*keys), new_rows.select(*keys), keys)
    if not pcols:
        record_affected(lake, ds, keys=fresh_keys, deleted=lost)
        _rewrite_whole(lake, ds, rows_outside_groups(target, groups, cols).unionByName(new_rows))
        return
    if covered:
        touched = groups.select(*pcols).distinct()
    elif scope_of is target:
        # coarser groups: the partitions that hold their rows now, and those of the new rows
        touched = rows_in_groups(target.select(*dict.fromkeys([*pcols, *cols])), groups, cols).select(*pcols).union(
            new_rows.select(*pcols)).distinct()
    gone_keys = staged = None
    if ds.index_buckets and keys:
        gone_keys, staged = stage(lost, "lost")
        lost = gone_keys
    try:
        record_affected(lake, ds, keys=fresh_keys, partitions=touched, deleted=lost,
                        groups=_exact_groups(new_rows, scope_of, groups, cols, exact) if exact else None)
        committed = affected(lake, ds, "partitions")
        scope = rows_in_groups(target, committed, pcols)
        rest = rows_outside_groups(scope, groups, cols)
        gone = _emptied(lake, ds, committed, new_rows, rest)
        index.behind(lake, ds)
        overwrite_partitions(lake, ds, rest.unionByName(new_rows))
        drop_folders(lake, ds, gone)
        if gone_keys is not None:
            index.follow(lake, ds, new_rows, gone_keys)
    finally:
        release(staged, lake.spark)


def _exact_groups(new_rows: DataFrame, target: DataFrame | None, groups: DataFrame, cols, exact) -> DataFrame:
    """The exact groups that a replace changes: the requested ones if they name whole groups, else those of the rows
    that go and come."""
    if set(exact) <= set(cols):
        return groups.select(*exact).distinct()
    out = new_rows.select(*exact)
    if target is not None:
        out = out.unionByName(rows_in_groups(target.select(*dict.fromkeys([*exact, *cols])), groups, cols).select(*exact))
    return out.distinct()
