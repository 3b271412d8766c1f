"""Streaming form of the change propagation (section 2.9 of the design).

A file stream delivers batches; each micro-batch is one run (``run_ts`` = batch id):
keyed upsert into silver, then scoped recompute of the affected gold groups. There is
no watermark on purpose: a row arriving any number of runs late still corrects its
group. A replayed micro-batch (after a failure) re-applies the same rows under the same
run id, which the upsert and the change channel absorb (idempotent).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..dataset import Dataset, Lake
from ..operators.recompute import recompute
from ..sinks.tables import upsert


def run_id(batch_id: int) -> str:
    return f"b{batch_id:012d}"


def propagate_batch(lake: Lake, silver: Dataset, gold: Dataset, group_cols,
                    aggregate: Callable[[DataFrame], DataFrame], mode: str = "incremental",
                    order_cols=()) -> Callable[[DataFrame, int], None]:
    def apply(batch: DataFrame, batch_id: int) -> None:
        run = lake.at(run_id(batch_id))
        if "_place" in order_cols:
            batch = batch.withColumn("_place", F.monotonically_increasing_id())
        upsert(run, silver, batch, mode, order_cols=order_cols)
        recompute(run, silver, gold, group_cols, aggregate)
    return apply


def start_file_stream(spark: SparkSession, source_path: str, schema: StructType, lake: Lake,
                      silver: Dataset, gold: Dataset, group_cols,
                      aggregate: Callable[[DataFrame], DataFrame], checkpoint_path: str | None = None,
                      fmt: str = "parquet", mode: str = "incremental", order_cols=(),
                      available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes what has landed and stops
    (a scheduled run), otherwise it keeps polling every ``processing_time``."""
    ckpt = checkpoint_path or f"{lake.root.rstrip('/')}/_streams/{silver.pipeline}_{silver.table}"
    # rows of one key within a micro-batch: ``order_cols``, then the file's time and the place in it
    src = spark.readStream.schema(schema).format(fmt).load(source_path).select(
        "*", F.col("_metadata.file_modification_time").alias("_landed"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"))
    order = (*order_cols, "_landed", "_file", "_block", "_place")
    w = (src.writeStream.foreachBatch(propagate_batch(lake, silver, gold, group_cols, aggregate, mode, order))
         .option("checkpointLocation", ckpt))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()
