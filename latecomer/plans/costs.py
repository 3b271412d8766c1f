"""W1, the costs pipeline: records -> bronze -> snapshot upsert -> affected group sums.

extract:   JSON records of the run (S8) landed in bronze, idempotent per run (K2)
clean:     this run's slice (S2), cast to the fact schema (P1), snapshot upsert (K5)
aggregate: recompute the affected (period, center) sums (C4) and replace them (K6)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ..dataset import Dataset, Lake, bronze_schema
from ..operators.aggregates import grouped_sum
from ..operators.recompute import recompute
from ..sinks.tables import upsert, write_bronze
from ..sources.records import cast_to, read_records
from ..sources.tables import read_new
from .orders_facts import ARRIVAL, FACT_SCHEMA, GOLD, GROUPS, SILVER

BRONZE = Dataset("bronze", "costs", "arrivals", bronze_schema(StructType([*FACT_SCHEMA.fields, StructField(
    ARRIVAL, StringType(), True)])), partition_by=("run_ts",))
SOURCE_MODE = "snapshot"     # each run delivers the whole source: absent rows are deleted


def extract(lake: Lake, records_path: str) -> None:
    write_bronze(lake, BRONZE, read_records(lake.spark, records_path, FACT_SCHEMA, multi_line=False, arrival_col=ARRIVAL))


def normalize(df: DataFrame) -> DataFrame:
    return cast_to(df, FACT_SCHEMA, [ARRIVAL])


def clean(lake: Lake) -> None:
    # the last record of a key that arrived in the run wins
    upsert(lake, SILVER, read_new(lake, BRONZE).transform(normalize), SOURCE_MODE, order_cols=(ARRIVAL,))


def aggregate(lake: Lake) -> bool:
    return recompute(lake, SILVER, GOLD, GROUPS, lambda f: grouped_sum(f, GROUPS, "amount"))


def run(lake: Lake, records_path: str) -> None:
    extract(lake, records_path)
    clean(lake)
    aggregate(lake)
