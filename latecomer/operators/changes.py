"""Pure change detection: DataFrames in, DataFrames out, nothing written.

* :func:`dedup_latest`  -- one row per key, the last one by an explicit order (A3, quirk X4)
* :func:`changed_keys`  -- distinct batch keys (C2, A2)
* :func:`deleted_rows`  -- target rows whose key a snapshot no longer holds (J4)
* :func:`affected_partitions` -- pre-image of matched keys, post-image of the batch and,
  for snapshots, the deleted rows' partitions (C1, C3, O3, P4)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INCREMENTAL = "incremental"
SNAPSHOT = "snapshot"
MODES = (INCREMENTAL, SNAPSHOT)


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown merge mode {mode!r}; expected one of {MODES}")


def dedup_latest(df: DataFrame, keys, order_cols=()) -> DataFrame:
    """Keep one row per key: the greatest by ``order_cols``, ties broken by every other
    column, so the choice never depends on frame order.

    Built as one aggregate, ``max(struct(order..., rest...))`` per key: Spark combines it
    map-side, so a key holding a third of all rows is reduced inside each input task
    before the shuffle, and no group is ever materialised in one task.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("dedup requires a key")
    order_cols = [c for c in order_cols if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order_cols]
    ranked = order_cols + rest
    if not ranked:
        return df.select(*keys).distinct()
    # struct fields are renamed positionally so that the tuple order is explicit
    packed = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(ranked)])
    best = df.groupBy(*keys).agg(F.max(packed).alias("_best"))
    return best.select(*keys, *[F.col(f"_best._{i}").alias(c) for i, c in enumerate(ranked)]) \
        .select(*df.columns)


def _keys_not_null(keys) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def anti_by_key(df: DataFrame, other: DataFrame, keys) -> DataFrame:
    """Rows of ``df`` whose key is not in ``other`` (plain equality). Rows with a NULL key
    part can never match, so they bypass the join instead of all hashing to the one
    shuffle partition of NULL (a NULL-heavy key would otherwise land in a single task)."""
    keys = list(keys)
    nn = _keys_not_null(keys)
    return (df.where(nn).join(other.select(*keys).where(nn).distinct(), keys, "left_anti")
            .unionByName(df.where(~nn)))


def changed_keys(batch: DataFrame, keys) -> DataFrame:
    return batch.select(*keys).distinct()


def deleted_rows(target: DataFrame, batch: DataFrame, keys) -> DataFrame:
    """Target rows absent from a snapshot batch (plain equality: a NULL key never matches,
    so a NULL-key row is always deleted by a snapshot, as MERGE would)."""
    return anti_by_key(target, batch, keys)


def matched_rows(target: DataFrame, batch: DataFrame, keys) -> DataFrame:
    """Pre-image: target rows whose key the batch updates."""
    return target.join(batch.select(*keys).distinct(), list(keys), "left_semi")


def affected_partitions(target: DataFrame | None, batch: DataFrame, keys, partition_by,
                        mode: str = INCREMENTAL) -> DataFrame:
    """Distinct partition tuples an upsert rewrites.

    A row moving between partitions marks both the old (pre-image) and the new one
    (post-image). ``target=None`` means the table does not exist yet: every batch
    partition is affected.
    """
    _check_mode(mode)
    pcols = list(partition_by)
    post = batch.select(*pcols)
    if target is None:
        return post.distinct()
    tgt = target.select(*(list(keys) + [c for c in pcols if c not in keys]))   # P4: prune early
    frames = [matched_rows(tgt, batch, keys).select(*pcols), post]
    if mode == SNAPSHOT:
        frames.append(deleted_rows(tgt, batch, keys).select(*pcols))
    return reduce(DataFrame.unionByName, frames).distinct()


def null_safe_row_equal(cols, left: str = "t", right: str = "b") -> Column:
    conds = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in cols]
    return reduce(lambda a, b: a & b, conds)


def changed_partitions_only(target: DataFrame, batch: DataFrame, keys, partition_by) -> DataFrame:
    """Snapshot variant of :func:`affected_partitions` (quirk X7): a partition is marked
    only if a row in it was inserted, updated (by value), moved or deleted."""
    keys, pcols = list(keys), list(partition_by)
    cols = [c for c in batch.columns if c in target.columns]
    t = target.select(*cols, F.lit(True).alias("_in_t")).alias("t")
    b = batch.select(*cols, F.lit(True).alias("_in_b")).alias("b")
    key_eq = reduce(lambda a, c: a & c, [F.col(f"t.{k}") == F.col(f"b.{k}") for k in keys])
    # NULL keys never match: they bypass the join instead of hashing to one task
    has_key = reduce(lambda a, c: a & c, [F.col(k).isNotNull() for k in keys])
    loose = target.where(~has_key).select(*pcols).unionByName(batch.where(~has_key).select(*pcols))
    j = t.where(has_key).alias("t").join(b.where(has_key).alias("b"), key_eq, "full_outer")
    same = F.col("t._in_t").isNotNull() & F.col("b._in_b").isNotNull() & null_safe_row_equal(cols)
    pre = j.where(F.col("t._in_t").isNotNull() & ~same).select(*[F.col(f"t.{c}").alias(c) for c in pcols])
    post = j.where(F.col("b._in_b").isNotNull() & ~same).select(*[F.col(f"b.{c}").alias(c) for c in pcols])
    return pre.unionByName(post).unionByName(loose).distinct()
