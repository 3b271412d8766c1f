"""Maintained type-2 history (D2): versions of keys under late, deleted, reborn and repeated deliveries.

The stored table holds one row a version: key, values, ``valid_from`` (the run that brought it), ``valid_to`` (the run that ended
it, NULL while it holds) and ``seen`` (every run that delivered these values while they held). A key's absence is a version
too (``is_deleted``, values NULL); :func:`versions` leaves those out.

A run touches the keys it delivers or deletes and no others. One later than all runs seen confirms or closes the version that holds.
Otherwise versions are opened up into what was seen in which run, the run's own deliveries are added (or replace those of an
earlier attempt), and neighbours with equal values are merged again. So

* a late run inside an old version splits it, also where a later run had confirmed the same values;
* a deletion closes the version that holds, a rebirth opens a new one;
* a delivery of the values that already hold opens none.

A late snapshot deletes the keys that its predecessor had and it hasn't; keys it brings that the run after it, already taken in, didn't
have are deleted there. The table is bucketed by key, so a run rewrites the folders of its keys; a late run's aggregate holds
one key's deliveries, at most one a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..dataset import RUN_COL, Dataset, Lake, bucketed
from ..session import release, stage
from ..sinks.cursor import commits
from ..sinks.tables import record_affected, replace_groups
from ..sources.tables import read, read_changed_groups, table_exists
from .changes import INCREMENTAL, SNAPSHOT, _check_mode, dedup_latest


def history_dataset(pipeline: str, table: str, schema: StructType, keys, buckets: int = 64) -> Dataset:
    """The history of a table with the given schema (keys and values)."""
    whole = StructType([*schema.fields, StructField("valid_from", StringType()), StructField("valid_to", StringType()),
                        StructField("is_deleted", BooleanType()), StructField("seen", ArrayType(StringType()))])
    return bucketed("silver", pipeline, table, whole, (), tuple(keys), buckets)


def _values(hist: Dataset) -> list[str]:
    return [c for c in hist.columns() if c not in (*hist.group_by, *hist.partition_by, "valid_from", "valid_to", "is_deleted", "seen")]


def intervals(seen: DataFrame, keys, values) -> DataFrame:
    """Versions of deliveries (keys, values, ``is_deleted``, run): neighbours that agree are one version."""
    return _merged(seen.withColumn("seen", F.array(RUN_COL)), keys, values)


def _merged(spans: DataFrame, keys, values) -> DataFrame:
    """Versions of spans (keys, values, ``is_deleted``, ``seen``: the runs that delivered them, each run once a key).

    A key's deliveries are put in order and cut into versions within its own row: one aggregate, no window over the keys."""
    keys, values = list(keys), list(values)
    now = F.struct(F.col("is_deleted"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(values)])
    held = spans.groupBy(*keys).agg(F.collect_list(F.struct(F.col("seen").alias("runs"), now.alias("now"))).alias("_spans"))
    by_run = held.select(*keys, F.array_sort(F.flatten(F.transform("_spans", lambda s: F.transform(
        s["runs"], lambda r: F.struct(r.alias("run"), s["now"].alias("now")))))).alias("_all"))
    # a struct is NULL-safe as a whole: equal when all its fields are, NULLs included
    places = by_run.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size("_all") - 1), lambda i: (i == 0) | ~F.get(
        "_all", i)["now"].eqNullSafe(F.get("_all", i - 1)["now"])))

    def version(start, j):
        after = F.get("_starts", j + 1)
        runs = F.transform(F.slice("_all", start + 1, F.coalesce(after, F.size("_all")) - start), lambda d: d["run"])
        return F.struct(F.get("_all", start)["now"].alias("_now"), F.get("_all", after)["run"].alias("valid_to"),
                        F.filter(runs, lambda r: r.isNotNull()).alias("seen"))

    rows = places.select(*keys, F.inline(F.transform("_starts", version)))
    return rows.select(*keys, *[F.col(f"_now._{i}").alias(c) for i, c in enumerate(values)], F.get("seen", F.lit(0)).alias(
        "valid_from"), "valid_to", F.col("_now.is_deleted").alias("is_deleted"), "seen")


def _followed(hist: Dataset, stored: DataFrame, events: DataFrame, values, run: str) -> DataFrame:
    """The touched keys' versions after ``events`` (one a key) of a run later than all that the history has seen.

    Such a run only meets the version that holds: it confirms it, or closes it and opens its own. One join, no group of rows."""
    keys, fields = list(hist.group_by), [*values, "is_deleted"]
    old = stored.select(*[F.col(k).alias(f"_ok{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(fields)],
                        F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), F.col("seen").alias("_runs"), F.col(
                            hist.partition_by[0]).alias("_ob"))
    new = events.select(*keys, *[F.col(c).alias(f"_n{i}") for i, c in enumerate(fields)], hist.bucket().alias("_nb"))
    on = F.col("_ob") == F.col("_nb")                # prunes the folders
    for i, k in enumerate(keys):
        on = on & F.col(f"_ok{i}").eqNullSafe(F.col(k))
    same = F.lit(True)
    for i in range(len(fields)):
        same = same & F.col(f"_o{i}").eqNullSafe(F.col(f"_n{i}"))
    holds = F.col("_to").isNull()
    # rows of the result: the stored version (0), the run's own (1)
    sides = (F.when(F.col("_from").isNull(), F.array(F.lit(1))).when(~holds | same, F.array(F.lit(0)))
             .otherwise(F.array(F.lit(0), F.lit(1))))
    rows = old.join(new, on, "right").withColumn("_same", same).withColumn("_side", F.explode(sides))
    own = F.col("_side") == 1
    return rows.select(
        *keys, *[F.when(own, F.col(f"_n{i}")).otherwise(F.col(f"_o{i}")).alias(c) for i, c in enumerate(fields)],
        F.when(own, F.lit(run)).otherwise(F.col("_from")).alias("valid_from"),
        F.when(~own & holds & ~F.col("_same"), F.lit(run)).when(~own, F.col("_to")).alias("valid_to"),
        F.when(own, F.array(F.lit(run))).when(holds & F.col("_same"), F.concat("_runs", F.array(F.lit(run)))).otherwise(
            F.col("_runs")).alias("seen"))


def apply_run(lake: Lake, hist: Dataset, batch: DataFrame, mode: str = INCREMENTAL, order_cols=(),
              deleted_keys: DataFrame | None = None) -> None:
    """Take the current run's deliveries into the history: rows of ``batch`` (the last one of a key by ``order_cols``), keys that
    ``deleted_keys`` names and, for a snapshot, keys that held before and are absent. Runs may come in any order and again."""
    _check_mode(mode)
    keys, values, run = list(hist.group_by), _values(hist), lake.run.run_ts
    rows = dedup_latest(batch.select(*keys, *values, *[c for c in order_cols if c not in (*keys, *values)]), keys, order_cols)
    rows = rows.select(*keys, *values, F.lit(False).alias("is_deleted"), F.lit(run).alias(RUN_COL))
    none = [F.lit(None).cast(hist.schema[c].dataType).alias(c) for c in values]

    def absent(some: DataFrame, since: str) -> DataFrame:
        return some.select(*keys, *none, F.lit(True).alias("is_deleted"), F.lit(since).alias(RUN_COL))

    events, staged = stage(rows, "history")
    paths = [staged]
    exists = table_exists(lake, hist)
    try:
        gone = None if deleted_keys is None else deleted_keys.select(*keys).distinct()
        if mode == SNAPSHOT and exists:
            # what held just before this run (an earlier attempt of this run aside): versions seen before it, ended by it or later
            before = read(lake, hist).where(F.exists("seen", lambda r: r < run)).where(
                ~F.col("is_deleted") & (F.col("valid_to").isNull() | (F.col("valid_to") >= run))).select(*keys).distinct()
            gone = before if gone is None else gone.unionByName(before).distinct()
        later = min((r for r, _ in commits(lake, hist) if r > run), default=None) if mode == SNAPSHOT and exists else None
        fill = None
        if later is not None:
            # the next run is already in: what it delivered or deleted is on record, what it lacked of this batch isn't
            known = read(lake, hist).where(F.array_contains("seen", later)).select(*keys)
            fill, staged = stage(absent(events.select(*keys).join(known, _same(events, known, keys), "left_anti"), later),
                                 "history")
            paths.append(staged)
        if gone is not None:
            # null-safe: a NULL key is a key of the history like any other
            gone = gone.join(events.select(*keys, F.lit(True).alias("_here")), _same(gone, events, keys), "left_anti")
            gone, staged = stage(absent(gone, run), "history")
            paths.append(staged)
            events = events.unionByName(gone)
        touched = events.select(*keys)                   # one row a key: a deletion names none that is delivered
        follows = later is None and (not exists or read(lake, hist).where(F.exists("seen", lambda r: r >= run)).isEmpty())
        if not follows:
            # keys of an earlier attempt of this run lose what it said of them
            again = read(lake, hist).where(F.array_contains("seen", run)).select(*keys)
            touched, staged = stage(touched.unionByName(again).distinct(), "history")
            paths.append(staged)
        if touched.isEmpty():
            record_affected(lake, hist)
            return
        if not exists:
            fresh = events.select(*keys, *values, F.lit(run).alias("valid_from"), F.lit(None).cast("string").alias("valid_to"),
                                  "is_deleted", F.array(F.lit(run)).alias("seen"))
        elif follows:
            fresh = _followed(hist, read(lake, hist), events, values, run)
        else:
            # an earlier attempt's deliveries are replaced by this one's
            old = (read_changed_groups(lake, hist, touched).select(*keys, *values, "is_deleted", "seen")
                   .withColumn("seen", F.array_except("seen", F.array(F.lit(run)))).where(F.size("seen") > 0))
            if fill is not None:
                # absences later than the run only fill gaps
                known = old.select(*keys, F.explode("seen").alias(RUN_COL))
                events = events.unionByName(fill.join(known, _same(fill, known, [*keys, RUN_COL]), "left_anti"))
            fresh = _merged(old.unionByName(events.withColumn("seen", F.array(RUN_COL)).drop(RUN_COL)), keys, values)
        replace_groups(lake, hist, fresh, touched, keys, groups_checked=True)
    finally:
        for path in paths:
            release(path, lake.spark)


def _same(left: DataFrame, right: DataFrame, cols):
    on = F.lit(True)
    for c in cols:
        on = on & left[c].eqNullSafe(right[c])
    return on


def versions(lake: Lake, hist: Dataset) -> DataFrame:
    """The versions in which a key existed: keys, values, ``valid_from``, ``valid_to``, ``is_current``."""
    cols = [*hist.group_by, *_values(hist)]
    return read(lake, hist).where(~F.col("is_deleted")).select(*cols, "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"))


def versions_of(bronze: DataFrame, keys, values, mode: str = INCREMENTAL, order_cols=(), runs: DataFrame | None = None) -> DataFrame:
    """The same from all landed runs at once. For snapshots a key that a run lacks is deleted there; ``runs`` (``run_ts``)
    names runs, also those that delivered nothing."""
    keys, values = list(keys), list(values)
    rows = dedup_latest(bronze.select(*dict.fromkeys([*keys, *values, *order_cols, RUN_COL])), [*keys, RUN_COL], order_cols)
    seen = rows.select(*keys, *values, F.lit(False).alias("is_deleted"), RUN_COL)
    if mode == SNAPSHOT:
        known = (bronze if runs is None else runs).select(RUN_COL).distinct()
        follows = known.select(RUN_COL, F.lead(RUN_COL).over(Window.orderBy(RUN_COL)).alias("_next"))     # one row a run
        ahead = F.lead(RUN_COL).over(Window.partitionBy(*keys).orderBy(RUN_COL))
        lacking = seen.withColumn("_own", ahead).join(F.broadcast(follows), RUN_COL).where(
            F.col("_next").isNotNull() & ~F.col("_next").eqNullSafe(F.col("_own")))
        seen = seen.unionByName(lacking.select(*keys, *[F.lit(None).cast(bronze.schema[c].dataType).alias(c) for c in values],
                                               F.lit(True).alias("is_deleted"), F.col("_next").alias(RUN_COL)))
    return intervals(seen, keys, values).where(~F.col("is_deleted")).select(
        *keys, *values, "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"))


__all__ = ["history_dataset", "apply_run", "versions", "versions_of", "intervals"]
