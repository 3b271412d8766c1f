"""Dataset handles and the run context.

Two further features of a dataset are declared here. ``group_by`` with ``buckets`` sets the grain of its changes apart from
its folders: rows lie in ``buckets`` folders by the hash of their group, and each run records the exact groups it changed, so a
table of many millions of small groups has as many folders as one of a few. ``index_buckets`` keeps an index from
keys to partitions (see ``sinks/index.py``).

A :class:`Dataset` names one persistent table of the lake (layer / pipeline / table), its
merge key, its partition columns (the aggregation grain, never the record id) and its
explicit schema. A :class:`Lake` binds a root folder, a Spark session and the current run.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


@dataclass(frozen=True)
class Dataset:
    layer: str                      # bronze | silver | gold
    pipeline: str
    table: str
    schema: StructType
    key: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()  # exact groups of the change set, where folders are coarser
    buckets: int = 0                # folders of a dataset with group_by
    index_buckets: int = 0          # buckets of the key index; 0: no index

    def bucket(self) -> Column:
        """The folder of a row or group of a dataset with ``group_by``."""
        return F.pmod(F.xxhash64(*self.group_by), F.lit(self.buckets)).cast("int").alias(BUCKET_COL)

    def rel(self) -> str:
        return f"{self.layer}/{self.pipeline}/{self.table}"

    def columns(self) -> list[str]:
        return [f.name for f in self.schema.fields]

    def storage_columns(self) -> list[str]:
        """Column order on disk: data columns first, partition columns last."""
        data = [c for c in self.columns() if c not in self.partition_by]
        return data + list(self.partition_by)

    def field(self, name: str) -> StructField:
        return self.schema[name]

    def sub_schema(self, cols) -> StructType:
        return StructType([self.schema[c] for c in cols])


BUCKET_COL = "group_bucket"


def bucketed(layer: str, pipeline: str, table: str, schema: StructType, key=(), group_by=(), buckets: int = 64,
             index_buckets: int = 0) -> Dataset:
    """A dataset whose rows lie in ``buckets`` folders by the hash of their group; the folder column is added to the schema."""
    if not group_by or buckets < 1:
        raise ValueError(f"{layer}/{pipeline}/{table}: a bucketed dataset needs group columns and buckets")
    whole = StructType([*schema.fields, StructField(BUCKET_COL, IntegerType(), True)])
    return Dataset(layer, pipeline, table, whole, tuple(key), (BUCKET_COL,), tuple(group_by), buckets, index_buckets)


@dataclass(frozen=True)
class Run:
    run_ts: str                     # identical for every step of one scheduled run
    logical_date: str = ""


@dataclass(frozen=True)
class Lake:
    spark: SparkSession
    root: str
    run: Run = field(default_factory=lambda: Run("00000000T000000"))

    def path(self, ds: Dataset) -> str:
        return f"{self.root.rstrip('/')}/{ds.rel()}"

    def marker_path(self, ds: Dataset, level: str) -> str:
        return f"{self.root.rstrip('/')}/_changes/{ds.pipeline}/{ds.layer}_{ds.table}/{level}"

    def cursor_path(self, ds: Dataset) -> str:
        return f"{self.root.rstrip('/')}/_cursors/{ds.pipeline}/{ds.layer}_{ds.table}"

    def at(self, run_ts: str, logical_date: str = "") -> "Lake":
        return replace(self, run=Run(run_ts, logical_date))


RUN_COL = "run_ts"
INGESTED_COL = "ingested_at"


def bronze_schema(payload: StructType) -> StructType:
    """Landing schema: payload plus the audit columns (run_ts is the partition)."""
    return StructType(list(payload.fields) + [
        StructField(INGESTED_COL, StringType(), True),
        StructField(RUN_COL, StringType(), True),
    ])
