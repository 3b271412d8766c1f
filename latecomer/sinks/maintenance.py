"""Table maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StructType, TimestampType

from .. import fs
from ..dataset import RUN_COL, Dataset, Lake
from ..operators.groups import rows_in_groups
from ..operators.quality import AUDIT_SCHEMA, audit_row, observed
from ..session import stage
from ..sources.tables import LEVELS, affected, levels_of, marker_schema, read
from .cursor import forget, unread_before
from .tables import overwrite_partitions, upsert


def compact(lake: Lake, ds: Dataset, partitions: DataFrame | None = None) -> None:
    """Rewrite the given partitions (default: the ones this run changed) as few,
    evenly sized files. Rows are unchanged; other partitions are not touched."""
    if not ds.partition_by:
        raise ValueError(f"{ds.rel()}: compaction works per partition")
    parts = partitions if partitions is not None else affected(lake, ds, "partitions")
    overwrite_partitions(lake, ds, rows_in_groups(read(lake, ds), parts, ds.partition_by))


def layout(lake: Lake, ds: Dataset) -> DataFrame:
    """Files, bytes and rows of each partition, by the files' own metadata (no data column is read)."""
    path, pcols = lake.path(ds), list(ds.partition_by)
    rows = lake.spark.read.schema(StructType([ds.schema[c] for c in ds.storage_columns()])).option("basePath", path).parquet(path)
    files = rows.groupBy(*pcols, F.col("_metadata.file_path").alias("file")).agg(
        F.max("_metadata.file_size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return files.groupBy(*pcols).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))


def curve(df: DataFrame, cols, bits: int = 8) -> Column:
    """Place of a row on a Z curve through ``cols``: each column's value is cut into ``2 ** bits`` bins of about equal size (approximate
    quantiles of its order) and the bins' bits are interleaved. NULL comes first."""
    cols = list(cols)
    bins = 2 ** bits
    ranks = {}
    for c in cols:
        kind = df.schema[c].dataType
        ranks[c] = F.col(c).cast("double") if isinstance(kind, (NumericType, DateType, TimestampType)) else F.xxhash64(c).cast("double")
    at = [k / bins for k in range(1, bins)]
    cuts = df.agg(*[F.percentile_approx(ranks[c], at).alias(f"q{i}") for i, c in enumerate(cols)]).first()     # bins numbers a column
    place = F.lit(0).cast("long")
    for i, c in enumerate(cols):
        edges = sorted(set(cuts[i] or []))
        bin_of = F.when(F.col(c).isNull(), F.lit(0)).otherwise(_below(edges, ranks[c]))
        for b in range(bits):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(bin_of, b).bitwiseAND(F.lit(1)).cast("long"), b * len(cols) + i))
    return place


def _below(edges: list[float], value: Column) -> Column:
    """How many of the edges lie below ``value``."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < value)) if edges else F.lit(0)


def cluster(lake: Lake, ds: Dataset, by=(), target_bytes: int = 128 << 20) -> DataFrame:
    """Rewrite the fragmented partitions (more files than their bytes need at ``target_bytes`` a file) and only those, their rows in
    the order of a Z curve through the columns ``by``, in files of about ``target_bytes``. Returns the layout of these
    partitions before the rewrite."""
    if not ds.partition_by:
        raise ValueError(f"{ds.rel()}: clustering works per partition")
    pcols = list(ds.partition_by)
    found, _ = stage(layout(lake, ds).where(F.col("files") > F.greatest(F.lit(1), F.ceil(F.col("bytes") / target_bytes))), "layout")
    total = found.agg(F.sum("bytes")).first()[0]
    if total is None:
        return found
    rows = rows_in_groups(read(lake, ds), found, pcols)
    rows = rows.withColumn("_place", curve(rows, by) if by else F.lit(0))
    # ranges of (partition, place) packed into files of the target size; a partition crosses into another range once a file at most
    packed = (rows.repartitionByRange(max(1, -(-int(total) // target_bytes)), *pcols, "_place")
              .sortWithinPartitions(*pcols, "_place").select(*ds.storage_columns()))
    (packed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*pcols).parquet(lake.path(ds)))
    lake.spark.catalog.refreshByPath(lake.path(ds))
    return found


def expire_markers(lake: Lake, ds: Dataset, before_run: str) -> list[str]:
    """Drop change-set partitions of runs older than ``before_run`` (one folder a run and
    level; run ids sort in run order). Refuses while a subscribed reader hasn't consumed one of them."""
    waiting = unread_before(lake, ds, before_run)
    if waiting:
        raise ValueError(f"{ds.rel()}: changes that readers still need: {waiting}")
    removed = []
    for level in levels_of(ds):
        path = lake.marker_path(ds, level)
        if not fs.exists(lake.spark, path):
            continue
        rows = lake.spark.read.schema(marker_schema(ds, level)).option("basePath", path).parquet(path)
        old = rows.where(F.col(RUN_COL) < F.lit(before_run)).select(
            RUN_COL, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).distinct()
        for run, folder in old.toLocalIterator():
            fs.delete(lake.spark, folder, encoded=True)
            removed.append(f"{level}/{run}")
        lake.spark.catalog.refreshByPath(path)
    forget(lake, ds, before_run)
    return removed


def _rows(seen: Observation) -> int:
    """Observed rows; an optimized-away (empty) input reports none."""
    try:
        return int(seen.get.get("rows", 0))
    except AssertionError:
        return 0


def audited_upsert(lake: Lake, ds: Dataset, batch: DataFrame, mode: str = "incremental",
                   order_cols=()) -> DataFrame:
    """Upsert and append one audit record per run: rows in, rows written, changed keys,
    affected partitions and deleted keys. ``rows_in`` is observed while the batch is
    fixed and ``rows_written`` by the rewrite job itself (no extra scans); the rest are
    counts of this run's (small) change set. A retried run replaces its record."""
    tag = f"audit_{ds.table}_{lake.run.run_ts}_{uuid.uuid4().hex[:8]}"
    watched, obs = observed(batch, tag)
    written = Observation(f"{tag}_written")
    upsert(lake, ds, watched, mode, order_cols=order_cols, written=written)
    rows_in, rows_written = _rows(obs), _rows(written)
    counts = {lvl: affected(lake, ds, lvl).count() if (lvl != "partitions" or ds.partition_by) else 0
              for lvl in LEVELS}
    rec = audit_row(lake.spark, lake.run.run_ts, ds.rel(), rows_in, rows_written, counts["keys"],
                    counts["partitions"], counts["deleted_keys"])
    path = f"{lake.root.rstrip('/')}/_audit/runs"
    (rec.withColumn("audit_run", F.col("run_ts")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("audit_run", "dataset").parquet(path))
    lake.spark.catalog.refreshByPath(path)
    return read_audit(lake)


def read_audit(lake: Lake) -> DataFrame:
    path = f"{lake.root.rstrip('/')}/_audit/runs"
    if not fs.exists(lake.spark, path):
        return lake.spark.createDataFrame([], AUDIT_SCHEMA)
    schema = "run_ts string, rows_in bigint, rows_written bigint, changed_keys bigint, " \
             "affected_partitions bigint, deleted_keys bigint, audit_run string, dataset string"
    return lake.spark.read.schema(schema).parquet(path).select(*[f.name for f in AUDIT_SCHEMA.fields])
