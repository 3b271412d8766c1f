"""Driver queries over the cost facts (q01-q13): each exercises a group of operators on
the whole ``orders`` table and has a DuckDB twin in :data:`ORACLE`.

Queries that test a sink write to a fresh folder under the session's checkpoint dir and
read the result back; the others call the pure layer only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..dataset import Dataset, Lake, Run
from ..operators.aggregates import grouped_sum
from ..operators.changes import (INCREMENTAL, SNAPSHOT, affected_partitions, changed_keys,
                                 dedup_latest)
from ..operators.groups import (check_within_groups, recompute_groups, replace_groups_result,
                                rows_in_groups)
from ..operators.merge import merge_result
from ..operators.rows import map_changed_result
from ..session import fixed, scratch_root
from ..sinks.tables import record_affected, upsert, write, write_bronze
from ..sources.tables import affected, read, table_exists
from . import orders_facts as of
from .orders_facts import (GROUPS, KEYS, SQL_BATCH, SQL_CORRECTED, SQL_FACTS, SQL_INITIAL,
                           SQL_MERGED, SQL_SNAPSHOT, as_double, sql_with)

OUT_COLS = ["cost_id", "cost_period", "cost_center", "amount"]


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of.cost_facts(of.table(spark, sf_dir, "orders"))


def _batch(facts: DataFrame) -> DataFrame:
    """The run-2 batch, deduplicated and fixed once in the checkpoint folder: every query
    below uses it in several places (pre-image, post-image, merge), and a fixed batch is one
    scan of a staged table instead of a dedup shuffle repeated in each of them."""
    return fixed(dedup_latest(of.incremental_batch(facts), KEYS))


def _lake(spark: SparkSession, run_ts: str = "r1") -> Lake:
    return Lake(spark, scratch_root(spark, "costs"), Run(run_ts))


# ------------------------------------------------------------------ q01  S1, K1

def q01_scan(spark, sf_dir):
    lake = _lake(spark)
    write(lake, of.SILVER, _facts(spark, sf_dir), "overwrite")
    return as_double(read(lake, of.SILVER), "amount")


# ------------------------------------------------------------------ q02  S2, K2, P2, P5, C10

def q02_bronze_retry(spark, sf_dir):
    """Three runs land one third of the facts each (run = key % 3); run r1 is retried.
    The retry replaces its own slice: no row is doubled."""
    facts = _facts(spark, sf_dir)
    lake = _lake(spark)
    for r in (0, 1, 2, 1):
        write_bronze(lake.at(f"r{r}"), of.BRONZE, facts.where((F.col("cost_id") % 3) == r))
    bronze = read(lake, of.BRONZE)
    return as_double(bronze.select(*OUT_COLS, "run_ts"), "amount")


# ------------------------------------------------------------------ q05  A3, K3, S10

def _lineitem_ds(schema):
    return Dataset("silver", "orders", "lineitem", schema,
                   key=("l_orderkey", "l_linenumber"), partition_by=("l_returnflag",))


def q05_dedup_create(spark, sf_dir):
    """First upsert of a batch with repeated keys: the table is created (K3, S10) from
    the batch deduplicated to the latest row per key (A3)."""
    li = of.table(spark, sf_dir, "lineitem")
    ds = _lineitem_ds(li.schema)
    lake = _lake(spark)
    assert not table_exists(lake, ds)
    upsert(lake, ds, li, INCREMENTAL, order_cols=("l_shipdate",))
    return read(lake, ds)


# ------------------------------------------------------------------ q06  K4, J6

def q06_merge_incremental(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    batch = _batch(facts)
    return as_double(merge_result(of.initial_load(facts), batch, KEYS, INCREMENTAL), "amount")


# ------------------------------------------------------------------ q07  K5, J4, C8

def _snapshot_lake(spark, sf_dir) -> Lake:
    facts = _facts(spark, sf_dir)
    lake = _lake(spark, "r1")
    upsert(lake, of.SILVER, of.initial_load(facts), SNAPSHOT)
    lake2 = lake.at("r2")
    upsert(lake2, of.SILVER, of.snapshot_batch(facts), SNAPSHOT)
    return lake2


def q07_merge_snapshot(spark, sf_dir):
    """Silver after a snapshot upsert written to Parquet: updates, moves and deletes."""
    return as_double(read(_snapshot_lake(spark, sf_dir), of.SILVER), "amount")


def q07d_deleted_keys(spark, sf_dir):
    """The deleted keys the snapshot upsert recorded in its change set."""
    return affected(_snapshot_lake(spark, sf_dir), of.SILVER, "deleted_keys")


# ------------------------------------------------------------------ q08  C1, C3, J1, O3, P4

def q08_affected_partitions(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    batch = _batch(facts)
    return affected_partitions(of.initial_load(facts), batch, KEYS, GROUPS, INCREMENTAL)


# ------------------------------------------------------------------ q09  S9, K7, C2, A2

def q09_changed_keys(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    lake = _lake(spark, "r2")
    record_affected(lake, of.SILVER, keys=changed_keys(of.incremental_batch(facts), KEYS))
    return affected(lake, of.SILVER, "keys")


# ------------------------------------------------------------------ q10  C4, S3, K6, J2, A1, U1

def gold_after_incremental(facts: DataFrame) -> DataFrame:
    """Gold after run 2, computed the scoped way: only the affected groups are
    recomputed from all their rows, and replace their old values."""
    target = of.initial_load(facts)
    batch = _batch(facts)
    # the small per-hop tables are fixed once, as the pipeline stores them: gold as it
    # stood, and the run's change set
    gold_before = fixed(grouped_sum(target, GROUPS, "amount"))
    changed = fixed(affected_partitions(target, batch, KEYS, GROUPS, INCREMENTAL))
    merged = merge_result(target, batch, KEYS, INCREMENTAL)
    groups, fresh = recompute_groups(merged, changed, GROUPS, lambda f: grouped_sum(f, GROUPS, "amount"))
    return replace_groups_result(gold_before, fresh, groups, GROUPS)


def q10_recompute_groups(spark, sf_dir):
    return as_double(gold_after_incremental(_facts(spark, sf_dir)), "amount")


# ------------------------------------------------------------------ q11  P6, P7, F11, J5, C9

def q11_null_groups(spark, sf_dir):
    """Rows of a group set that contains NULL centers: NULL matches NULL. The group set
    is the pre-image of the moved rows; the J5 guard checks the rows stay inside it."""
    facts = of.with_null_center(_facts(spark, sf_dir))
    groups = facts.where((F.col("cost_id") % of.MOVE_MOD) == of.MOVE_REM).select(*GROUPS).distinct()
    rows = rows_in_groups(facts, groups, GROUPS)
    check_within_groups(rows, groups, GROUPS)
    return as_double(rows, "amount")


# ------------------------------------------------------------------ q12  C5, S4, J3, U2

def price_band(rows: DataFrame) -> DataFrame:
    """A row transform (the user function of a row-level step)."""
    return rows.withColumn(
        "price_band",
        F.when(F.col("amount") < 50000, F.lit("small"))
         .when(F.col("amount") < 200000, F.lit("medium"))
         .otherwise(F.lit("large")))


def q12_map_changed(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    batch = _batch(facts)
    merged = merge_result(of.initial_load(facts), batch, KEYS, INCREMENTAL)
    out = map_changed_result(merged, changed_keys(batch, KEYS), KEYS, price_band)
    return as_double(out, "amount")


# ------------------------------------------------------------------ q13  C6, C7, A4, W3, D8

def quarter_of(period_col: str = "cost_period"):
    month = F.substring(F.col(period_col), 6, 2).cast("int")
    return F.concat(F.substring(F.col(period_col), 1, 4), F.lit("-Q"),
                    ((month + 2) / 3).cast("int").cast("string"))


def month_stats(facts: DataFrame) -> DataFrame:
    return facts.groupBy("cost_period").agg(
        F.sum("amount").alias("total"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min("amount").alias("lowest"),
        F.max("amount").alias("highest"),
        F.countDistinct("cost_center").alias("n_centers"))


def quarter_stats(months: DataFrame) -> DataFrame:
    return (months.withColumn("quarter", quarter_of()).groupBy("quarter").agg(
        F.sum("total").alias("total"),
        F.sum("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_months"),
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
        F.max("n_centers").alias("max_centers")))


def q13_quarter_rollup(spark, sf_dir):
    """Two hops. Hop 1 recomputes month totals at a coarser grain than the source
    partitions (period only, C6) and emits the requested months (C7). Hop 2 maps them to
    quarters, a derived group column (D8), and recomputes those quarters from the months."""
    facts = _facts(spark, sf_dir)
    target = of.initial_load(facts)
    batch = _batch(facts)
    changed = fixed(affected_partitions(target, batch, KEYS, GROUPS, INCREMENTAL))
    merged = merge_result(target, batch, KEYS, INCREMENTAL)

    # each hop's (small) table is fixed once, as the pipeline stores it
    months_before = fixed(month_stats(target))
    m_groups, m_new = recompute_groups(merged, changed, ["cost_period"], month_stats)
    m_groups = fixed(m_groups)
    months_after = fixed(replace_groups_result(months_before, m_new, m_groups, ["cost_period"]))

    quarters_before = quarter_stats(months_before)
    q_changed = m_groups.withColumn("quarter", quarter_of())
    q_groups, q_new = recompute_groups(months_after.withColumn("quarter", quarter_of()), q_changed,
                                       ["quarter"], lambda f: quarter_stats(f.drop("quarter")))
    out = replace_groups_result(quarters_before, q_new, q_groups, ["quarter"])
    out = out.withColumn("mean_amount", F.col("total").cast("double") / F.col("n_rows"))
    return as_double(out, "total", "lowest", "highest")


# ------------------------------------------------------------------ q12b  C5 apply, X2

ROWS_DS = Dataset("gold", "costs", "fact_bands",
                  StructType(list(of.FACT_SCHEMA.fields) + [StructField("price_band", StringType(), True)]),
                  key=KEYS, partition_by=GROUPS)


def q12b_map_changed_apply(spark, sf_dir):
    """Row-level target kept in step with silver over two snapshot runs on a real lake:
    changed keys are re-transformed and upserted, deleted keys are deleted (X2)."""
    from ..operators.rows import map_changed
    facts = _facts(spark, sf_dir)
    lake = _lake(spark, "r1")
    for run, batch in (("r1", of.initial_load(facts)), ("r2", of.snapshot_batch(facts))):
        lk = lake.at(run)
        upsert(lk, of.SILVER, batch, SNAPSHOT)
        map_changed(lk, of.SILVER, ROWS_DS, price_band)
    return as_double(read(lake, ROWS_DS), "amount")


# ------------------------------------------------------------------ q13b  C4, C6, C7, K6 apply

GOLD_MONTH = Dataset("gold", "costs", "by_month",
                     of.GOLD.sub_schema(["cost_period", "amount"]), partition_by=("cost_period",))


def q13b_two_hops_apply(spark, sf_dir):
    """Two recompute hops on a real lake after the incremental run: silver to gold by
    (period, center), then gold to months (a coarser grain) from gold's own change set."""
    from ..operators.recompute import recompute
    facts = _facts(spark, sf_dir)
    lake = _lake(spark, "r1")
    for run, batch in (("r1", of.initial_load(facts)), ("r2", of.incremental_batch(facts))):
        lk = lake.at(run)
        upsert(lk, of.SILVER, batch, INCREMENTAL)
        recompute(lk, of.SILVER, of.GOLD, GROUPS, lambda f: grouped_sum(f, GROUPS, "amount"))
        recompute(lk, of.GOLD, GOLD_MONTH, ["cost_period"], lambda f: grouped_sum(f, ["cost_period"], "amount"))
    return as_double(read(lake, GOLD_MONTH), "amount")


QUERIES = {
    "q01_scan": q01_scan,
    "q02_bronze_retry": q02_bronze_retry,
    "q05_dedup_create": q05_dedup_create,
    "q06_merge_incremental": q06_merge_incremental,
    "q07_merge_snapshot": q07_merge_snapshot,
    "q07d_deleted_keys": q07d_deleted_keys,
    "q08_affected_partitions": q08_affected_partitions,
    "q09_changed_keys": q09_changed_keys,
    "q10_recompute_groups": q10_recompute_groups,
    "q11_null_groups": q11_null_groups,
    "q12_map_changed": q12_map_changed,
    "q13_quarter_rollup": q13_quarter_rollup,
    "q12b_map_changed_apply": q12b_map_changed_apply,
    "q13b_two_hops_apply": q13b_two_hops_apply,
}

_LI_COLS = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus"]

_QUARTER_SQL = "substr(cost_period, 1, 4) || '-Q' || CAST((CAST(substr(cost_period, 6, 2) AS INTEGER) + 2) // 3 AS VARCHAR)"

ORACLE = {
    "q01_scan": sql_with(SQL_FACTS)
    + "SELECT cost_id, cost_period, cost_center, CAST(amount AS DOUBLE) AS amount FROM facts",

    "q02_bronze_retry": sql_with(SQL_FACTS)
    + "SELECT cost_id, cost_period, cost_center, CAST(amount AS DOUBLE) AS amount, "
      "'r' || CAST(cost_id % 3 AS VARCHAR) AS run_ts FROM facts",

    "q05_dedup_create": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
    "ORDER BY l_shipdate DESC NULLS LAST, "
    + ", ".join(f"{c} DESC NULLS LAST" for c in _LI_COLS)
    + ") AS rn FROM lineitem) WHERE rn = 1",

    "q06_merge_incremental": sql_with(SQL_FACTS, SQL_INITIAL, SQL_CORRECTED, SQL_BATCH, SQL_MERGED)
    + "SELECT cost_id, cost_period, cost_center, CAST(amount AS DOUBLE) AS amount FROM merged",

    "q07_merge_snapshot": sql_with(SQL_FACTS, SQL_CORRECTED, SQL_SNAPSHOT)
    + "SELECT cost_id, cost_period, cost_center, CAST(amount AS DOUBLE) AS amount FROM snap",

    "q07d_deleted_keys": sql_with(SQL_FACTS, SQL_INITIAL, SQL_CORRECTED, SQL_SNAPSHOT)
    + "SELECT cost_id FROM initial i WHERE NOT EXISTS (SELECT 1 FROM snap s WHERE s.cost_id = i.cost_id)",

    "q08_affected_partitions": sql_with(SQL_FACTS, SQL_INITIAL, SQL_CORRECTED, SQL_BATCH)
    + "SELECT cost_period, cost_center FROM initial i WHERE EXISTS (SELECT 1 FROM batch b WHERE b.cost_id = i.cost_id)\n"
      "UNION SELECT cost_period, cost_center FROM batch",

    "q09_changed_keys": sql_with(SQL_FACTS, SQL_CORRECTED, SQL_BATCH)
    + "SELECT DISTINCT cost_id FROM batch",

    "q10_recompute_groups": sql_with(SQL_FACTS, SQL_INITIAL, SQL_CORRECTED, SQL_BATCH, SQL_MERGED)
    + "SELECT cost_period, cost_center, CAST(SUM(amount) AS DOUBLE) AS amount FROM merged GROUP BY 1, 2",

    "q11_null_groups": sql_with(SQL_FACTS)
    + """, nf AS (SELECT cost_id, cost_period, CASE WHEN cost_center = '5-LOW' THEN NULL ELSE cost_center END AS cost_center, amount FROM facts),
g AS (SELECT DISTINCT cost_period, cost_center FROM nf WHERE cost_id % 50 = 0)
SELECT cost_id, cost_period, cost_center, CAST(amount AS DOUBLE) AS amount FROM nf
WHERE EXISTS (SELECT 1 FROM g WHERE g.cost_period IS NOT DISTINCT FROM nf.cost_period
                               AND g.cost_center IS NOT DISTINCT FROM nf.cost_center)""",

    "q12_map_changed": sql_with(SQL_FACTS, SQL_CORRECTED, SQL_BATCH)
    + """SELECT cost_id, cost_period, cost_center, CAST(amount AS DOUBLE) AS amount,
  CASE WHEN amount < 50000 THEN 'small' WHEN amount < 200000 THEN 'medium' ELSE 'large' END AS price_band
FROM batch""",

    "q12b_map_changed_apply": sql_with(SQL_FACTS, SQL_CORRECTED, SQL_SNAPSHOT)
    + """SELECT cost_id, cost_period, cost_center, CAST(amount AS DOUBLE) AS amount,
  CASE WHEN amount < 50000 THEN 'small' WHEN amount < 200000 THEN 'medium' ELSE 'large' END AS price_band
FROM snap""",

    "q13b_two_hops_apply": sql_with(SQL_FACTS, SQL_INITIAL, SQL_CORRECTED, SQL_BATCH, SQL_MERGED)
    + "SELECT cost_period, CAST(SUM(amount) AS DOUBLE) AS amount FROM merged GROUP BY 1",

    "q13_quarter_rollup": sql_with(SQL_FACTS, SQL_INITIAL, SQL_CORRECTED, SQL_BATCH, SQL_MERGED)
    + f""", m AS (SELECT cost_period, SUM(amount) AS total, COUNT(*) AS n_rows, MIN(amount) AS lowest,
                  MAX(amount) AS highest, COUNT(DISTINCT cost_center) AS n_centers
           FROM merged GROUP BY cost_period)
SELECT {_QUARTER_SQL} AS quarter, CAST(SUM(total) AS DOUBLE) AS total, CAST(SUM(n_rows) AS BIGINT) AS n_rows,
       COUNT(*) AS n_months, CAST(MIN(lowest) AS DOUBLE) AS lowest, CAST(MAX(highest) AS DOUBLE) AS highest,
       MAX(n_centers) AS max_centers,
       CAST(SUM(total) AS DOUBLE) / CAST(SUM(n_rows) AS BIGINT) AS mean_amount
FROM m GROUP BY 1""",
}
