"""State checkpoints of a landing table (D1): an as-of read takes the nearest one and the slices after it, not all of bronze.

A checkpoint holds, for each key, the row that wins over all runs up to its own, with the run that delivered it. As winning is a
maximum over (run, order), the state after a later run is the maximum over the checkpoint's rows and the later slices.

A landing for a run (late, or a retry) removes the checkpoints of that run and of later ones before it writes, so that none
outlives the slices it was made from (``write_bronze`` sees to it).

Cases: no checkpoint yet: all slices are read; before the first run the state is empty; a run that delivered nothing changes
nothing in an incremental source, and empties a snapshot one if ``runs`` names it; NULL keys are one key, as in the dedup.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import fs
from ..dataset import RUN_COL, Dataset, Lake
from ..operators.changes import INCREMENTAL, SNAPSHOT, _check_mode, dedup_latest
from ..sources.tables import read

_INDEX = StructType([StructField(RUN_COL, StringType()), StructField("folder", StringType())])


def _root(lake: Lake, bronze: Dataset) -> str:
    return f"{lake.root.rstrip('/')}/_checkpoints/{bronze.rel()}"


def checkpoints(lake: Lake, bronze: Dataset) -> dict[str, str]:
    """run -> folder of the checkpoints that hold; one index row a checkpoint reaches the driver."""
    index = f"{_root(lake, bronze)}/index"
    if not fs.exists(lake.spark, index):
        return {}
    rows = lake.spark.read.schema(_INDEX).parquet(index).collect()
    return {run: folder for run, folder in rows if fs.exists(lake.spark, f"{_root(lake, bronze)}/{folder}/_SUCCESS")}


def forget_from(lake: Lake, bronze: Dataset, run_ts: str) -> list[str]:
    """Remove the checkpoints of ``run_ts`` and of later runs; returns their runs."""
    old = {run: folder for run, folder in checkpoints(lake, bronze).items() if run >= run_ts}
    for folder in old.values():
        fs.delete(lake.spark, f"{_root(lake, bronze)}/{folder}")
    return sorted(old)


def _slices(lake: Lake, bronze: Dataset, after: str | None, upto: str) -> DataFrame:
    """Slices of the runs in (after, upto]: literal filters on the partition column, so other slices aren't read."""
    found = read(lake, bronze).where(F.col(RUN_COL) <= F.lit(upto))
    return found if after is None else found.where(F.col(RUN_COL) > F.lit(after))


def _winners(lake: Lake, bronze: Dataset, keys, run_ts: str, order_cols) -> DataFrame:
    held = {run: folder for run, folder in checkpoints(lake, bronze).items() if run <= run_ts}
    nearest = max(held, default=None)
    if nearest == run_ts:
        return _read(lake, bronze, held[nearest])
    rows = _slices(lake, bronze, nearest, run_ts)
    if nearest is not None:
        rows = _read(lake, bronze, held[nearest]).unionByName(rows)
    return dedup_latest(rows, keys, [RUN_COL, *order_cols])


def _read(lake: Lake, bronze: Dataset, folder: str) -> DataFrame:
    return lake.spark.read.schema(bronze.schema).parquet(f"{_root(lake, bronze)}/{folder}")


def checkpoint(lake: Lake, bronze: Dataset, keys, run_ts: str, order_cols=()) -> None:
    """Store the state of an incremental source after ``run_ts``, made from the checkpoint before it."""
    if run_ts in checkpoints(lake, bronze):
        return
    folder = uuid.uuid4().hex
    _winners(lake, bronze, keys, run_ts, order_cols).write.parquet(f"{_root(lake, bronze)}/{folder}")
    lake.spark.range(0, 1, 1, 1).select(F.lit(run_ts).alias(RUN_COL), F.lit(folder).alias("folder")).write.mode(
        "append").parquet(f"{_root(lake, bronze)}/index")


def state_as_of(lake: Lake, bronze: Dataset, keys, run_ts: str, mode: str = INCREMENTAL, order_cols=(),
                runs: DataFrame | None = None) -> DataFrame:
    """The table as it stood after ``run_ts``, with the run that delivered each row.

    ``runs`` (a frame with all run ids, such as the audit table) names the snapshots that delivered nothing."""
    _check_mode(mode)
    if mode != SNAPSHOT:
        return _winners(lake, bronze, keys, run_ts, order_cols)
    known = read(lake, bronze).select(RUN_COL) if runs is None else read(lake, bronze).select(RUN_COL).union(runs.select(RUN_COL))
    newest = known.where(F.col(RUN_COL) <= F.lit(run_ts)).agg(F.max(RUN_COL)).first()[0]         # one value
    rows = read(lake, bronze).where(F.col(RUN_COL) == F.lit(newest))
    return dedup_latest(rows, keys, list(order_cols))
