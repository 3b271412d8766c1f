"""W3, the template pipeline: extract raw rows, clean to ``(id, period, amount)``, and
sum by period (one group column). Same operators as the costs pipeline; a new pipeline
starts from a copy of these three functions with its own names and source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..dataset import Dataset, Lake, bronze_schema
from ..operators.aggregates import grouped_sum
from ..operators.recompute import recompute
from ..sinks.tables import upsert, write_bronze
from ..sources.records import cast_to
from ..sources.tables import read_new

CLEAN = StructType([StructField("id", StringType(), True), StructField("period", StringType(), True),
                    StructField("amount", DoubleType(), True)])


def datasets(name: str, mode_key=("id",)):
    landed = StructType([*CLEAN.fields, StructField("arrival", LongType(), True)])
    bronze = Dataset("bronze", name, "raw", bronze_schema(landed), partition_by=("run_ts",))
    silver = Dataset("silver", name, "fact", CLEAN, key=mode_key, partition_by=("period",))
    gold = Dataset("gold", name, "by_period", StructType([CLEAN["period"], CLEAN["amount"]]), partition_by=("period",))
    return bronze, silver, gold


def run(lake: Lake, name: str, raw: DataFrame, mode: str = "snapshot", arrival_col: str | None = None) -> None:
    """``arrival_col`` of ``raw`` orders several rows of one id within a run: the last one wins."""
    bronze, silver, gold = datasets(name)
    number = F.col(arrival_col).cast("bigint") if arrival_col else F.lit(None).cast("bigint")
    write_bronze(lake, bronze, cast_to(raw.withColumn("arrival", number), CLEAN, ["arrival"]))
    upsert(lake, silver, read_new(lake, bronze).transform(lambda d: cast_to(d, CLEAN, ["arrival"])), mode,
           order_cols=("arrival",))
    recompute(lake, silver, gold, ("period",), lambda f: grouped_sum(f, ("period",), "amount"))
