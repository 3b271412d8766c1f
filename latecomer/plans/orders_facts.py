"""Cost facts and change batches derived from the driver's ``orders`` table.

``orders`` stands for the cost records of the costs pipeline: key ``o_orderkey``, period
= order month, center = order priority, amount = total price as an exact decimal (sums
agree across engines; results are cast to double at the end).

The change scenario is a fixed arithmetic rule on the key, so every engine derives the
same batches from the whole table:

* late rows      -- key % 10 = 1: absent from the first load, arrive in the second run
* updated rows   -- key % 10 = 0: amount + 30 in the second run
* moved rows     -- key % 50 = 0: also re-dated to period 1995-01 (a partition move)
* snapshot gaps  -- key % 13 = 0: absent from the snapshot of the second run (deleted)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StringType, StructField, StructType

from ..dataset import Dataset, bronze_schema

AMOUNT = DecimalType(18, 2)
ARRIVAL = "arrival"
KEYS = ("cost_id",)
GROUPS = ("cost_period", "cost_center")

FACT_SCHEMA = StructType([
    StructField("cost_id", LongType(), True),
    StructField("cost_period", StringType(), True),
    StructField("cost_center", StringType(), True),
    StructField("amount", AMOUNT, True),
])

SILVER = Dataset("silver", "costs", "fact", FACT_SCHEMA, key=KEYS, partition_by=GROUPS)
# Gold holds one row per (period, center): one folder per group would mean one tiny file
# per row, so it is partitioned by period only; a group replace rewrites the folder of
# each touched month (its few centers) and nothing else.
GOLD = Dataset("gold", "costs", "cost_by_period",
               StructType([FACT_SCHEMA["cost_period"], FACT_SCHEMA["cost_center"],
                           StructField("amount", DecimalType(28, 2), True)]),
               partition_by=("cost_period",))
BRONZE = Dataset("bronze", "costs", "raw", bronze_schema(FACT_SCHEMA), partition_by=("run_ts",))

# fixed values of the change scenario
LATE_MOD, LATE_REM = 10, 1
UPDATE_MOD, UPDATE_REM = 10, 0
MOVE_MOD, MOVE_REM = 50, 0
DELETE_MOD, DELETE_REM = 13, 0
UPDATE_DELTA = 30
MOVE_TO_PERIOD = "1995-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cost_facts(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").cast("bigint").alias("cost_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("cost_period"),
        F.col("o_orderpriority").alias("cost_center"),
        F.col("o_totalprice").cast(AMOUNT).alias("amount"),
    )


def _is(mod: int, rem: int):
    return (F.col("cost_id") % mod) == rem


def initial_load(facts: DataFrame) -> DataFrame:
    """State after the first run: everything except the late rows."""
    return facts.where(~_is(LATE_MOD, LATE_REM))


def corrected(facts: DataFrame) -> DataFrame:
    """Current truth of the source: updates and moves applied."""
    return facts.select(
        "cost_id",
        F.when(_is(MOVE_MOD, MOVE_REM), F.lit(MOVE_TO_PERIOD)).otherwise(F.col("cost_period")).alias("cost_period"),
        "cost_center",
        F.when(_is(UPDATE_MOD, UPDATE_REM), F.col("amount") + F.lit(UPDATE_DELTA))
         .otherwise(F.col("amount")).cast(AMOUNT).alias("amount"),
    )


def incremental_batch(facts: DataFrame) -> DataFrame:
    """Second run, incremental feed: late rows and corrected rows only."""
    return corrected(facts.where(_is(LATE_MOD, LATE_REM) | _is(UPDATE_MOD, UPDATE_REM)))


def snapshot_batch(facts: DataFrame) -> DataFrame:
    """Second run, snapshot feed: the whole corrected source minus the removed rows."""
    return corrected(facts).where(~_is(DELETE_MOD, DELETE_REM))


def with_null_center(facts: DataFrame, null_center: str = "5-LOW") -> DataFrame:
    """Same facts, with one center unknown (NULL): exercises NULL groups."""
    return facts.withColumn("cost_center", F.when(F.col("cost_center") == null_center, F.lit(None))
                            .otherwise(F.col("cost_center")))


def as_double(df: DataFrame, *cols) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


# DuckDB forms of the same derivations, for the oracle.
SQL_FACTS = """facts AS (
  SELECT o_orderkey AS cost_id, strftime(o_orderdate, '%Y-%m') AS cost_period,
         o_orderpriority AS cost_center, CAST(o_totalprice AS DECIMAL(18,2)) AS amount
  FROM orders)"""
SQL_INITIAL = "initial AS (SELECT * FROM facts WHERE cost_id % 10 <> 1)"
SQL_CORRECTED = """corrected AS (
  SELECT cost_id,
         CASE WHEN cost_id % 50 = 0 THEN '1995-01' ELSE cost_period END AS cost_period,
         cost_center,
         CAST(CASE WHEN cost_id % 10 = 0 THEN amount + 30 ELSE amount END AS DECIMAL(18,2)) AS amount
  FROM facts)"""
SQL_BATCH = "batch AS (SELECT * FROM corrected WHERE cost_id % 10 IN (0, 1))"
SQL_SNAPSHOT = "snap AS (SELECT * FROM corrected WHERE cost_id % 13 <> 0)"
SQL_MERGED = """merged AS (
  SELECT * FROM initial i WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.cost_id = i.cost_id)
  UNION ALL SELECT * FROM batch)"""


def sql_with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
