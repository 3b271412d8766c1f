"""Driver queries for the table operators the design describes (D1-D7, D9): time travel,
SCD2 history, tombstones, quality rules, run audit, ranged backfill, mean per parent
group and compaction. Runs are r1 (first load) and r2 (the late/corrected batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import RUN_COL, Lake, Run
from ..operators.aggregates import grouped_sum
from ..operators.changes import SNAPSHOT, dedup_latest
from ..operators.groups import replace_groups_result, rows_in_groups
from ..operators.history import as_of, merge_with_tombstones, scd2
from ..operators.merge import merge_result
from ..operators.quality import quality_checks
from ..session import fixed, scratch_root
from ..sinks.maintenance import audited_upsert, compact
from ..sinks.tables import write
from ..sources.tables import read
from . import orders_facts as of
from .orders_facts import (GROUPS, KEYS, SQL_BATCH, SQL_CORRECTED, SQL_FACTS, SQL_INITIAL,
                           SQL_MERGED, SQL_SNAPSHOT, as_double, sql_with)

# fixed values of these scenarios
TOMBSTONE_MOD = 20
BACKFILL_FROM, BACKFILL_TO = "1996-01", "1996-12"
LI_KEYS = ("l_orderkey", "l_linenumber")


def _facts(spark, sf_dir):
    return of.cost_facts(of.table(spark, sf_dir, "orders"))


def _bronze(facts: DataFrame) -> DataFrame:
    """Two landed runs as bronze keeps them."""
    return (of.initial_load(facts).withColumn(RUN_COL, F.lit("r1"))
            .unionByName(of.incremental_batch(facts).withColumn(RUN_COL, F.lit("r2"))))


# ------------------------------------------------------------------ q21  D1

def q21_as_of(spark, sf_dir):
    """The incremental table as of run r2, replayed from bronze."""
    return as_double(as_of(_bronze(_facts(spark, sf_dir)), KEYS, "r2"), "amount")


def q21b_as_of_snapshot(spark, sf_dir):
    """A snapshot source as of run r2: the newest slice up to r2 (r3 is ignored)."""
    facts = _facts(spark, sf_dir)
    bronze = (of.initial_load(facts).withColumn(RUN_COL, F.lit("r1"))
              .unionByName(of.snapshot_batch(facts).withColumn(RUN_COL, F.lit("r2")))
              .unionByName(of.corrected(facts).withColumn(RUN_COL, F.lit("r3"))))
    return as_double(as_of(bronze, KEYS, "r2", SNAPSHOT), "amount")


# ------------------------------------------------------------------ q22  D2

def q22_scd2(spark, sf_dir):
    hist = scd2(_bronze(_facts(spark, sf_dir)), KEYS, ["cost_period", "cost_center", "amount"])
    return as_double(hist, "amount")


# ------------------------------------------------------------------ q23  D3

def q23_tombstones(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    batch = of.incremental_batch(facts).withColumn("is_deleted", (F.col("cost_id") % TOMBSTONE_MOD) == 0)
    return as_double(merge_with_tombstones(of.initial_load(facts), batch, KEYS), "amount")


# ------------------------------------------------------------------ q24  D4

def q24_quality(spark, sf_dir):
    return quality_checks(of.table(spark, sf_dir, "lineitem"), LI_KEYS, ("l_returnflag",))


# ------------------------------------------------------------------ q25  D5

def q25_audit(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    lake = Lake(spark, scratch_root(spark, "audit"), Run("r1"))
    audited_upsert(lake, of.SILVER, of.initial_load(facts))
    return audited_upsert(lake.at("r2"), of.SILVER, of.incremental_batch(facts))


# ------------------------------------------------------------------ q26  D6

def q26_ranged_backfill(spark, sf_dir):
    """Gold of the first load, then a ranged backfill of the 1996 groups over the merged
    facts: only those groups take new values."""
    facts = _facts(spark, sf_dir)
    target = of.initial_load(facts)
    merged = merge_result(target, fixed(dedup_latest(of.incremental_batch(facts), KEYS)), KEYS)
    gold_before = fixed(grouped_sum(target, GROUPS, "amount"))
    groups = fixed(merged.select(*GROUPS).distinct()
                   .where(F.col("cost_period").between(BACKFILL_FROM, BACKFILL_TO)))
    fresh = grouped_sum(rows_in_groups(merged, groups, GROUPS), GROUPS, "amount")
    return as_double(replace_groups_result(gold_before, fresh, groups, GROUPS), "amount")


# ------------------------------------------------------------------ q27  D7

def q27_mean_per_order(spark, sf_dir):
    """Mean item price per parent order over the deduplicated items (exact: decimal sum
    over count)."""
    li = dedup_latest(of.table(spark, sf_dir, "lineitem"), LI_KEYS, ("l_shipdate",))
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_items"),
        (F.sum(price).cast("double") / F.count(F.lit(1))).alias("mean_price"))


# ------------------------------------------------------------------ q28  D9

def q28_compaction(spark, sf_dir):
    """Silver appended in three slices (three files per partition), then compacted:
    same rows, one rewrite per partition."""
    facts = _facts(spark, sf_dir)
    lake = Lake(spark, scratch_root(spark, "compact"), Run("r1"))
    for r in range(3):
        write(lake, of.SILVER, facts.where((F.col("cost_id") % 3) == r), "overwrite" if r == 0 else "append")
    compact(lake, of.SILVER, read(lake, of.SILVER).select(*GROUPS).distinct())
    return as_double(read(lake, of.SILVER), "amount")


QUERIES = {
    "q21_as_of": q21_as_of,
    "q21b_as_of_snapshot": q21b_as_of_snapshot,
    "q22_scd2": q22_scd2,
    "q23_tombstones": q23_tombstones,
    "q24_quality": q24_quality,
    "q25_audit": q25_audit,
    "q26_ranged_backfill": q26_ranged_backfill,
    "q27_mean_per_order": q27_mean_per_order,
    "q28_compaction": q28_compaction,
}

_OUT = "cost_id, cost_period, cost_center, CAST(amount AS DOUBLE) AS amount"
_BRONZE = "bronze AS (SELECT *, 'r1' AS run_ts FROM initial UNION ALL SELECT *, 'r2' AS run_ts FROM batch)"
_LI_DEDUP = ("li AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
             "ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC NULLS LAST, l_suppkey DESC NULLS LAST, "
             "l_quantity DESC NULLS LAST, l_extendedprice DESC NULLS LAST, l_discount DESC NULLS LAST, "
             "l_tax DESC NULLS LAST, l_returnflag DESC NULLS LAST, l_linestatus DESC NULLS LAST) AS rn "
             "FROM lineitem) WHERE rn = 1)")

ORACLE = {
    "q21_as_of": sql_with(SQL_FACTS, SQL_INITIAL, SQL_CORRECTED, SQL_BATCH, SQL_MERGED) + f"SELECT {_OUT} FROM merged",

    "q21b_as_of_snapshot": sql_with(SQL_FACTS, SQL_CORRECTED, SQL_SNAPSHOT) + f"SELECT {_OUT} FROM snap",

    "q22_scd2": sql_with(SQL_FACTS, SQL_INITIAL, SQL_CORRECTED, SQL_BATCH, _BRONZE) + f""",
v AS (SELECT *, lag(cost_period) OVER w AS pp, lag(cost_center) OVER w AS pc, lag(amount) OVER w AS pa,
             lag(run_ts) OVER w AS pr
      FROM bronze WINDOW w AS (PARTITION BY cost_id ORDER BY run_ts)),
n AS (SELECT * FROM v WHERE pr IS NULL OR NOT (cost_period IS NOT DISTINCT FROM pp
        AND cost_center IS NOT DISTINCT FROM pc AND amount IS NOT DISTINCT FROM pa))
SELECT {_OUT}, run_ts AS valid_from,
       lead(run_ts) OVER (PARTITION BY cost_id ORDER BY run_ts) AS valid_to,
       lead(run_ts) OVER (PARTITION BY cost_id ORDER BY run_ts) IS NULL AS is_current
FROM n""",

    "q23_tombstones": sql_with(SQL_FACTS, SQL_INITIAL, SQL_CORRECTED, SQL_BATCH, SQL_MERGED)
    + f"SELECT {_OUT} FROM merged WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.cost_id = merged.cost_id "
      f"AND b.cost_id % {TOMBSTONE_MOD} = 0)",

    "q24_quality": """SELECT 'null_key' AS rule,
       CAST(count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS BIGINT) AS failing_rows FROM lineitem
UNION ALL SELECT 'null_partition', CAST(count(*) FILTER (WHERE l_returnflag IS NULL) AS BIGINT) FROM lineitem
UNION ALL SELECT 'duplicate_key', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (
  SELECT count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
  GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",

    "q25_audit": sql_with(SQL_FACTS, SQL_INITIAL, SQL_CORRECTED, SQL_BATCH, SQL_MERGED) + """,
aff AS (SELECT cost_period, cost_center FROM initial i WHERE EXISTS (SELECT 1 FROM batch b WHERE b.cost_id = i.cost_id)
        UNION SELECT cost_period, cost_center FROM batch)
SELECT 'r1' AS run_ts, 'silver/costs/fact' AS dataset, (SELECT count(*) FROM initial) AS rows_in,
       (SELECT count(*) FROM initial) AS rows_written,
       (SELECT count(DISTINCT cost_id) FROM initial) AS changed_keys,
       (SELECT count(*) FROM (SELECT DISTINCT cost_period, cost_center FROM initial)) AS affected_partitions,
       CAST(0 AS BIGINT) AS deleted_keys
UNION ALL
SELECT 'r2', 'silver/costs/fact', (SELECT count(*) FROM batch),
       (SELECT count(*) FROM merged m WHERE EXISTS (SELECT 1 FROM aff a WHERE a.cost_period = m.cost_period
                                                     AND a.cost_center = m.cost_center)),
       (SELECT count(DISTINCT cost_id) FROM batch), (SELECT count(*) FROM aff),
       CAST(0 AS BIGINT)""",

    "q26_ranged_backfill": sql_with(SQL_FACTS, SQL_INITIAL, SQL_CORRECTED, SQL_BATCH, SQL_MERGED) + f""",
g AS (SELECT DISTINCT cost_period, cost_center FROM merged WHERE cost_period BETWEEN '{BACKFILL_FROM}' AND '{BACKFILL_TO}')
SELECT cost_period, cost_center, CAST(SUM(amount) AS DOUBLE) AS amount FROM merged m
WHERE EXISTS (SELECT 1 FROM g WHERE g.cost_period = m.cost_period AND g.cost_center = m.cost_center) GROUP BY 1, 2
UNION ALL
SELECT cost_period, cost_center, CAST(SUM(amount) AS DOUBLE) AS amount FROM initial i
WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.cost_period = i.cost_period AND g.cost_center = i.cost_center) GROUP BY 1, 2""",

    "q27_mean_per_order": f"""WITH {_LI_DEDUP}
SELECT l_orderkey, count(*) AS n_items,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_price
FROM li GROUP BY l_orderkey""",

    "q28_compaction": sql_with(SQL_FACTS) + f"SELECT {_OUT} FROM facts",
}
