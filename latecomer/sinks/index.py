"""Key-to-partition index (J1, C1): where the rows of a key lie, without a scan of the table.

An upsert must know the partitions (and groups) that hold its keys now. Without an index that is a scan of the key column of the whole
table. With one, it is a read of the buckets that the batch's keys hash to: an index row holds a key and its row's
partition and group columns, in the folder of the key's hash.

The index follows the table: after each change the buckets of the changed and deleted keys are rewritten. A flag beside it is set
before a change of the table and cleared after the index follows; whoever finds the flag (a run failed in between) or no index
rebuilds it from the table first. Rows with a NULL in their key match no batch and aren't indexed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import fs
from ..dataset import Dataset, Lake
from ..operators.changes import anti_by_key
from ..session import release, stage
from ..sources.tables import read, table_exists

KEY_BUCKET = "key_bucket"


def index_of(ds: Dataset) -> Dataset:
    """The index as a dataset of its own: keys, partition and group columns, and the bucket it is partitioned by."""
    cols = dict.fromkeys([*ds.key, *ds.partition_by, *ds.group_by])
    schema = StructType([*[ds.schema[c] for c in cols], StructField(KEY_BUCKET, IntegerType(), True)])
    return Dataset("_index", ds.pipeline, f"{ds.layer}_{ds.table}", schema, ds.key, (KEY_BUCKET,))


def _bucket(ds: Dataset) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast(ds.schema[k].dataType) for k in ds.key]), F.lit(ds.index_buckets)).cast("int")


def _flag(lake: Lake, ds: Dataset) -> str:
    return f"{lake.root.rstrip('/')}/_index_behind/{ds.pipeline}/{ds.layer}_{ds.table}"


def _rows(ds: Dataset, rows: DataFrame, unique: bool = False) -> DataFrame:
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in ds.key])
    cols = [c for c in index_of(ds).columns() if c != KEY_BUCKET]
    rows = rows.where(known).select(*cols)
    return (rows if unique else rows.distinct()).withColumn(KEY_BUCKET, _bucket(ds))


def behind(lake: Lake, ds: Dataset) -> None:
    """The table is about to change."""
    if ds.index_buckets:
        fs.mkdirs(lake.spark, _flag(lake, ds))


def rebuild(lake: Lake, ds: Dataset, unique: bool = False) -> None:
    """Write the whole index from the table (``unique``: which is known to hold one row a key)."""
    from .tables import write
    write(lake, index_of(ds), _rows(ds, read(lake, ds), unique), "overwrite")
    fs.delete(lake.spark, _flag(lake, ds))


def lookup(lake: Lake, ds: Dataset, keys: DataFrame) -> DataFrame:
    """Key, partition and group columns of the table's rows with one of ``keys``, read from the keys' buckets only."""
    if not table_exists(lake, index_of(ds)) or fs.exists(lake.spark, _flag(lake, ds)):
        rebuild(lake, ds)
    k = list(ds.key)
    wanted = keys.select(*k).withColumn(KEY_BUCKET, _bucket(ds))
    # bucket numbers (at most index_buckets of them): a literal filter prunes the folders when the plan is made
    buckets = sorted(r[0] for r in wanted.select(KEY_BUCKET).distinct().collect())
    rows = read(lake, index_of(ds)).where(F.col(KEY_BUCKET).isin(buckets))
    return rows.join(wanted.distinct(), [KEY_BUCKET, *k], "left_semi").drop(KEY_BUCKET)


def follow(lake: Lake, ds: Dataset, changed: DataFrame | None, gone: DataFrame | None) -> None:
    """Bring the index up to date: ``changed`` rows (keys, partition and group columns) as they are now, keys ``gone``."""
    from .tables import _emptied, drop_folders, overwrite_partitions
    if not ds.index_buckets:
        return
    index, k = index_of(ds), list(ds.key)
    if not table_exists(lake, index):
        rebuild(lake, ds)
        return
    fresh = _rows(ds, changed) if changed is not None else read(lake, index).limit(0)
    keys = fresh.select(*k) if gone is None else fresh.select(*k).unionByName(gone.select(*k))
    fresh, fresh_path = stage(fresh.select(*index.columns()), "index")
    keys, keys_path = stage(keys.distinct().withColumn(KEY_BUCKET, _bucket(ds)), "index")
    try:
        touched = keys.select(KEY_BUCKET).distinct()
        buckets = sorted(r[0] for r in touched.where(f"{KEY_BUCKET} IS NOT NULL").collect())
        kept = anti_by_key(read(lake, index).where(F.col(KEY_BUCKET).isin(buckets)), keys, k)
        empty = _emptied(lake, index, touched, fresh, kept)
        if buckets:
            overwrite_partitions(lake, index, kept.unionByName(fresh))
        drop_folders(lake, index, empty)
    finally:
        for path in (fresh_path, keys_path):
            release(path, lake.spark)
    fs.delete(lake.spark, _flag(lake, ds))
