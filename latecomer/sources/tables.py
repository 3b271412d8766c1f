"""Scans of lake datasets.

Every read uses the dataset's declared schema, so partition values keep their declared
types and an absent table or marker yields a typed empty frame, never a guess.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import fs
from ..dataset import BUCKET_COL, RUN_COL, Dataset, Lake
from ..operators.groups import rows_in_groups

LEVELS = ("keys", "partitions", "deleted_keys")


def levels_of(ds: Dataset) -> tuple[str, ...]:
    """The change levels of a dataset; one with ``group_by`` also names its exact groups."""
    return LEVELS + ("groups",) if ds.group_by else LEVELS


def table_exists(lake: Lake, ds: Dataset) -> bool:
    """Create-or-merge decision. Only "not there" means missing; any other error
    (permissions, unreachable store) propagates instead of turning into an overwrite."""
    return fs.exists(lake.spark, lake.path(ds))


def empty(lake: Lake, schema: StructType) -> DataFrame:
    # made in the JVM: an empty list of Python rows would start a Python worker a core
    return lake.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def read(lake: Lake, ds: Dataset) -> DataFrame:
    """The dataset's current rows, columns in declared order."""
    if not table_exists(lake, ds):
        return empty(lake, ds.schema)
    path = lake.path(ds)
    df = (lake.spark.read.schema(StructType([ds.schema[c] for c in ds.storage_columns()]))
          .option("basePath", path).parquet(path))
    return df.select(*ds.columns())


def read_with_folders(lake: Lake, ds: Dataset, cols) -> DataFrame:
    """``cols`` of the dataset's rows and the folder (encoded URI) each row lies in."""
    if not table_exists(lake, ds):
        return empty(lake, ds.sub_schema(cols)).withColumn("_folder", F.lit(None).cast("string"))
    path = lake.path(ds)
    df = (lake.spark.read.schema(StructType([ds.schema[c] for c in ds.storage_columns()]))
          .option("basePath", path).parquet(path))
    return df.select(*cols, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("_folder"))


def read_new(lake: Lake, ds: Dataset) -> DataFrame:
    """Only this run's slice; ``run_ts`` is the partition column, so the scan
    reads one folder."""
    return read(lake, ds).where(F.col(RUN_COL) == F.lit(lake.run.run_ts))


def read_groups(lake: Lake, ds: Dataset, groups: DataFrame, group_cols=None) -> DataFrame:
    """All rows of the given groups (default: the partition columns)."""
    cols = list(group_cols or ds.partition_by)
    return rows_in_groups(read(lake, ds), groups, cols)


def read_changed_groups(lake: Lake, ds: Dataset, groups: DataFrame) -> DataFrame:
    """All rows of the given exact groups of a dataset with ``group_by``: the folders that hold them are pruned by
    the groups' hashes, then their rows are picked."""
    wanted = groups.select(*ds.group_by).distinct().withColumn(BUCKET_COL, ds.bucket())
    return rows_in_groups(read(lake, ds), wanted, [BUCKET_COL, *ds.group_by])


def read_keys(lake: Lake, ds: Dataset, keys: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Current rows of the given keys. ``within`` (partition tuples that hold them, such
    as a run's change set) prunes the scan to those partitions first."""
    k = list(ds.key)
    rows = read(lake, ds) if within is None else read_groups(lake, ds, within)
    # a semi join takes a row once however often its key comes, and change sets hold a key once
    return rows.join(keys.select(*k), k, "left_semi")


def marker_schema(ds: Dataset, level: str) -> StructType:
    if level not in levels_of(ds):
        raise ValueError(f"unknown change level {level!r}")
    cols = {"partitions": ds.partition_by, "groups": ds.group_by}.get(level, ds.key)
    return StructType([ds.schema[c] for c in cols] + [StructField(RUN_COL, StringType(), True)])


def affected(lake: Lake, ds: Dataset, level: str, run_ts=None) -> DataFrame:
    """Keys / partitions / deleted keys changed by a run (default: the current one), or the union of
    those of several runs (a list of ids). A run that left no marker reads as a typed empty frame."""
    schema = marker_schema(ds, level)
    cols = [f.name for f in schema.fields if f.name != RUN_COL]
    path = lake.marker_path(ds, level)
    runs = [run_ts or lake.run.run_ts] if run_ts is None or isinstance(run_ts, str) else sorted(run_ts)
    if not runs or not fs.exists(lake.spark, path):
        return empty(lake, schema).select(*cols)
    # the run filter prunes to the runs' folders, and makes this side selective for dynamic pruning
    rows = (lake.spark.read.schema(schema).option("basePath", path).parquet(path)
            .where(F.col(RUN_COL).isin(runs) if len(runs) > 1 else F.col(RUN_COL) == F.lit(runs[0])).select(*cols))
    return rows if len(runs) == 1 else rows.distinct()
