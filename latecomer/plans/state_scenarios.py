"""Driver queries q43 to q45: aggregates of hot groups from the states of their slices, a backfill that stops and goes on, and
as-of states from checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, LongType, StringType, StructField, StructType

from ..dataset import RUN_COL, Dataset, Lake, bronze_schema, bucketed
from ..operators.changes import SNAPSHOT
from ..operators.ranges import backfill_in_ranges, progress
from ..operators.states import SLICE_COL, mean, recompute_states, slice_states, state_fields, states_schema
from ..session import scratch_root
from ..sinks.checkpoints import checkpoint, checkpoints, state_as_of
from ..sinks.tables import upsert, write, write_bronze
from ..sources.tables import read
from . import orders_facts as of
from .orders_facts import SQL_FACTS, sql_with

# fixed values of the scenarios
SLICES, BUCKETS = 32, 16
HOT, HOT_EVERY = "HOT", 3                   # a third of all rows are in one group
UPDATED, EMPTIED, LATE = 5, 6, 7            # slices that the second run touches
LATE_EVERY = 9
TOTAL = DecimalType(28, 2)
GROUP = StructType([StructField("cost_center", StringType())])
RANGES, FIRST = 4, 2
GONE = "1985-03"
SLICE_OF, EMPTY_RUN, RETRIED_BY = 6, 3, 100


def _rows_with_slices(orders):
    """Facts with a hot group; the slice follows from the key by plain arithmetic, so that SQL can name it."""
    facts = of.cost_facts(orders)
    return facts.select("cost_id", F.when(F.col("cost_id") % HOT_EVERY == 0, HOT).otherwise(F.col("cost_center")).alias("cost_center"),
                        "amount", F.pmod("cost_id", F.lit(SLICES)).cast("int").alias(SLICE_COL))


def q43_hot_group_states(spark, sf_dir):
    """Aggregates of all groups after a second run with updates in one slice, deletes in another (all its rows of the hot group)
    and late rows in a third; with the slices and rows that the second run read again."""
    rows = _rows_with_slices(of.table(spark, sf_dir, "orders"))
    lake = Lake(spark, scratch_root(spark, "states"))
    schema = StructType([StructField("cost_id", LongType()), *GROUP.fields, StructField("amount", of.AMOUNT),
                         StructField(SLICE_COL, IntegerType())])
    by = ("cost_center", SLICE_COL)
    facts = bucketed("silver", "states", "fact", schema, of.KEYS, by, BUCKETS)
    run = StructField("run", StringType())
    states = bucketed("gold", "states", "by_slice", StructType([*states_schema(GROUP, of.AMOUNT, TOTAL).fields, run]), by, by, BUCKETS)
    gold = bucketed("gold", "states", "by_center", StructType([*GROUP.fields, *state_fields(of.AMOUNT, TOTAL)]),
                    ("cost_center",), ("cost_center",), BUCKETS)
    late = (F.col(SLICE_COL) == LATE) & (F.col("cost_id") % LATE_EVERY == 0)
    raised = (rows.where(F.col(SLICE_COL) == UPDATED)
              .withColumn("amount", (F.col("amount") + 1).cast(of.AMOUNT)))
    gone = rows.where((F.col(SLICE_COL) == EMPTIED) & (F.col("cost_center") == HOT))
    for name, batch, deleted in (("r1", rows.where(~late), None), ("r2", raised.unionByName(rows.where(late)), gone)):
        upsert(lake.at(name), facts, batch, delete_keys=deleted)
        recompute_states(lake.at(name), facts, states, gold, ("cost_center",),
                         lambda f, name=name: slice_states(f, ("cost_center",), "amount").withColumn("run", F.lit(name)))
    again = F.col("run") == "r2"
    reads = read(lake, states).groupBy("cost_center").agg(
        F.count(F.lit(1)).alias("slices"), F.count_if(again).alias("slices_again"),
        F.sum(F.when(again, F.col("n_rows")).otherwise(0)).alias("rows_again"))
    return of.as_double(read(lake, gold).select("cost_center", "n_rows", "total", "least", "greatest", mean()),
                        "total", "least", "greatest").join(reads, "cost_center")


def q44_resumed_backfill(spark, sf_dir):
    """Totals of a backfill that stopped after two of its ranges and was resumed: the attempt that computed each group, and the
    range that its month lies in."""
    facts = of.cost_facts(of.table(spark, sf_dir, "orders"))
    lake = Lake(spark, scratch_root(spark, "ranges"))
    gold = Dataset("gold", "costs", "by_range", StructType([*of.GOLD.schema.fields, StructField("attempt", StringType())]),
                   partition_by=("cost_period",))
    upsert(lake.at("r1"), of.SILVER, facts)
    write(lake, gold, spark.range(1).select(F.lit(GONE).alias("cost_period"), F.lit("gone").alias("cost_center"),
                                            F.lit(0).cast(TOTAL).alias("amount"), F.lit("old").alias("attempt")))

    def attempt(name, at_most):
        return backfill_in_ranges(
            lake.at("r2"), "all", of.SILVER, gold, of.GROUPS, lambda f: f.groupBy(*of.GROUPS).agg(
                F.sum("amount").alias("amount")).withColumn("attempt", F.lit(name)), "cost_period", RANGES, at_most)

    attempt("first", FIRST)
    attempt("second", None)
    attempt("third", None)                              # nothing is left
    found = progress(lake, "all", of.SILVER, gold, "cost_period").select("range_no", "lower", "upper", "rows", "done")
    sums = of.as_double(read(lake, gold), "amount")
    return sums.join(F.broadcast(found), F.col("cost_period").between(F.col("lower"), F.col("upper"))).select(
        *of.GROUPS, "amount", "attempt", "range_no", "rows", "done")


def q45_as_of_checkpoints(spark, sf_dir):
    """State of an incremental source after each of five runs, from checkpoints after r2 and r4, the second of which a retried
    run r4 removes; and of a snapshot source whose r3 delivered nothing. Counts and totals by the run that delivered a row."""
    facts = of.cost_facts(of.table(spark, sf_dir, "orders"))
    lake = Lake(spark, scratch_root(spark, "replay"))
    slices, snaps = (Dataset("bronze", "costs", name, bronze_schema(of.FACT_SCHEMA), of.KEYS, (RUN_COL,)) for name in ("slices", "snaps"))
    runs = [f"r{k}" for k in range(1, 6)]

    def batch(k, more=0):
        found = facts if k == 1 else facts.where(F.col("cost_id") % SLICE_OF == k)
        return found.withColumn("amount", (F.col("amount") + k + more).cast(of.AMOUNT))

    for k, run in enumerate(runs, 1):
        write_bronze(lake.at(run), slices, batch(k))
        if k != EMPTY_RUN:
            write_bronze(lake.at(run), snaps, batch(k))
        if k % 2 == 0:
            checkpoint(lake, slices, of.KEYS, run)
    write_bronze(lake.at("r4"), slices, batch(4, RETRIED_BY))
    held = sorted(checkpoints(lake, slices))
    all_runs = spark.range(1, 6).select(F.concat(F.lit("r"), "id").alias(RUN_COL))
    out = None
    for run in runs:
        used = max((h for h in held if h <= run), default=None)
        for name, state in (("slices", state_as_of(lake, slices, of.KEYS, run)),
                            ("snaps", state_as_of(lake, snaps, of.KEYS, run, SNAPSHOT, runs=all_runs))):
            one = state.groupBy(RUN_COL).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount")).select(
                F.lit(name).alias("source"), F.lit(run).alias("as_of"), F.col(RUN_COL).alias("delivered"), "n", "amount",
                F.lit(used if name == "slices" else None).cast("string").alias("checkpoint"))
            out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"q45_as_of_checkpoints": q45_as_of_checkpoints, "q43_hot_group_states": q43_hot_group_states, "q44_resumed_backfill": q44_resumed_backfill}

ORACLE = {
    "q45_as_of_checkpoints": sql_with(SQL_FACTS) + f""", k AS (SELECT unnest(range(1, 6)) AS k),
b AS (SELECT k, cost_id, amount + k + CASE WHEN k = 4 THEN {RETRIED_BY} ELSE 0 END AS amount, amount + k AS plain
  FROM facts CROSS JOIN k WHERE k = 1 OR cost_id % {SLICE_OF} = k),
s AS (SELECT t.k AS upto, b.* FROM k t JOIN b ON b.k <= t.k QUALIFY row_number() OVER (PARTITION BY t.k, cost_id ORDER BY b.k DESC) = 1)
SELECT 'slices' AS source, 'r' || upto AS as_of, 'r' || k AS delivered, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount,
  CASE WHEN upto >= 2 THEN 'r2' END AS checkpoint FROM s GROUP BY upto, k
UNION ALL SELECT 'snaps', 'r' || k, 'r' || k, count(*), CAST(sum(plain) AS DOUBLE), NULL FROM b WHERE k <> {EMPTY_RUN} GROUP BY k""",

    "q43_hot_group_states": sql_with(SQL_FACTS) + f""", t AS (
  SELECT cost_id % {SLICES} AS slice, cost_id % {LATE_EVERY} = 0 AS ninth,
    CASE WHEN cost_id % {HOT_EVERY} = 0 THEN '{HOT}' ELSE cost_center END AS cost_center,
    CASE WHEN cost_id % {SLICES} = {UPDATED} THEN amount + 1 ELSE amount END AS amount FROM facts),
s AS (SELECT *, (slice = {UPDATED} OR (slice = {LATE} AND bool_or(ninth) OVER (PARTITION BY cost_center, slice))) AS again
  FROM t WHERE NOT (slice = {EMPTIED} AND cost_center = '{HOT}'))
SELECT cost_center, count(*) AS n_rows, CAST(sum(amount) AS DOUBLE) AS total, CAST(min(amount) AS DOUBLE) AS least,
  CAST(max(amount) AS DOUBLE) AS greatest, CAST(sum(amount) AS DOUBLE) / count(amount) AS mean, count(DISTINCT slice) AS slices,
  count(DISTINCT slice) FILTER (WHERE again) AS slices_again, count(*) FILTER (WHERE again) AS rows_again
FROM s GROUP BY cost_center""",

    "q44_resumed_backfill": sql_with(SQL_FACTS) + f""", h AS (SELECT cost_period, count(*) AS n FROM facts GROUP BY 1),
r AS (SELECT cost_period, n, ((sum(n) OVER (ORDER BY cost_period) - n) * {RANGES}) // sum(n) OVER () AS range_no FROM h),
p AS (SELECT range_no, sum(n) AS rows FROM r GROUP BY 1)
SELECT f.cost_period, cost_center, CAST(sum(amount) AS DOUBLE) AS amount,
  CASE WHEN range_no < {FIRST} THEN 'first' ELSE 'second' END AS attempt, CAST(range_no AS INTEGER) AS range_no,
  CAST(p.rows AS BIGINT) AS rows, true AS done
FROM facts f JOIN r USING (cost_period) JOIN p USING (range_no) GROUP BY f.cost_period, cost_center, range_no, p.rows""",
}
