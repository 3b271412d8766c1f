"""Driver queries q39 to q42: changes at the grain of parents in a few folders, upserts that find keys by an index, and a
history that is maintained while runs arrive late, and the clustering of fragmented partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, LongType, StringType, StructField, StructType

from ..dataset import Dataset, Lake, bucketed
from ..operators.changes import SNAPSHOT, dedup_latest
from ..operators.recompute import recompute
from ..operators.versions import apply_run, history_dataset, versions
from ..session import scratch_root, stage
from ..sinks.index import index_of
from ..sinks.maintenance import cluster, layout
from ..sinks.tables import upsert, write
from ..sources.tables import read
from . import orders_facts as of
from .history_scenarios import _LI_DEDUP, LI_KEYS
from .orders_facts import SQL_BATCH, SQL_CORRECTED, SQL_FACTS, SQL_INITIAL, SQL_MERGED, SQL_SNAPSHOT, sql_with

# fixed values of the scenarios
PRICE = DecimalType(18, 2)
ITEM = StructType([StructField("l_orderkey", LongType()), StructField("l_linenumber", IntegerType()), StructField("price", PRICE)])
MEAN = StructType([StructField("l_orderkey", LongType()), StructField("n_items", LongType()), StructField("total", DecimalType(28, 2)),
                   StructField("run", StringType())])
PARENTS, RAISED, EMPTIED, SHORTENED = 100, 7, 8, 9       # remainders of the parent's number
BUCKETS = 16
DELETED, REBORN, REBORN_IN = 13, 26, "1996-07"
LATE_LACKS, LATE_RAISES = 17, 4
WHOLE = "1997-05"


def mean_per_parent(run: str):
    return lambda items: items.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("price").cast(DecimalType(28, 2)).alias("total")).withColumn("run", F.lit(run))


def parent_datasets(buckets: int = BUCKETS) -> tuple[Dataset, Dataset]:
    items = bucketed("silver", "items", "item", ITEM, LI_KEYS, ("l_orderkey",), buckets, index_buckets=buckets)
    return items, bucketed("gold", "items", "mean_per_order", MEAN, ("l_orderkey",), ("l_orderkey",), buckets)


def item_facts(lineitem: DataFrame) -> DataFrame:
    return dedup_latest(lineitem, LI_KEYS, ("l_shipdate",)).select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast(PRICE).alias("price"))


def q39_parent_groups(spark, sf_dir):
    """Mean price per parent order after a batch that changes the items of about one parent in a hundred, empties as many and
    shortens as many; every row names the run that computed it. Parents lie in a fixed number of folders."""
    facts = item_facts(of.table(spark, sf_dir, "lineitem"))
    lake = Lake(spark, scratch_root(spark, "parents"))
    items, means = parent_datasets()
    rest = F.col("l_orderkey") % PARENTS
    first = F.col("l_linenumber") == 1
    upsert(lake.at("r1"), items, facts)
    recompute(lake.at("r1"), items, means, ("l_orderkey",), mean_per_parent("r1"))
    raised = facts.where((rest == RAISED) & first).withColumn("price", (F.col("price") + 1).cast(PRICE))
    upsert(lake.at("r2"), items, raised, delete_keys=facts.where((rest == EMPTIED) | ((rest == SHORTENED) & first)))
    recompute(lake.at("r2"), items, means, ("l_orderkey",), mean_per_parent("r2"))
    return read(lake, means).select("l_orderkey", "n_items", (F.col("total").cast("double") / F.col("n_items")).alias("mean_price"), "run")


def q40_key_index(spark, sf_dir):
    """The index after three runs with late, moved, deleted and reborn keys: where each key of the table lies."""
    facts = of.cost_facts(of.table(spark, sf_dir, "orders"))
    lake = Lake(spark, scratch_root(spark, "index"))
    silver = Dataset("silver", "costs", "indexed", of.FACT_SCHEMA, of.KEYS, ("cost_period",), index_buckets=BUCKETS)
    upsert(lake.at("r1"), silver, of.initial_load(facts))
    upsert(lake.at("r2"), silver, of.incremental_batch(facts), delete_keys=facts.where(F.col("cost_id") % DELETED == 0))
    upsert(lake.at("r3"), silver, facts.where(F.col("cost_id") % REBORN == 0).withColumn("cost_period", F.lit(REBORN_IN)))
    found = read(lake, index_of(silver)).select("cost_id", F.col("cost_period").alias("index_period"))
    return found.join(read(lake, silver).select("cost_id", "cost_period"), "cost_id", "full")


def q41_late_history(spark, sf_dir):
    """Versions of all orders after four snapshots, the second of which arrives after the third: versions are split, closed by
    absence, reborn and merged."""
    facts = of.cost_facts(of.table(spark, sf_dir, "orders"))
    lake = Lake(spark, scratch_root(spark, "versions"))
    hist = history_dataset("costs", "versions", of.FACT_SCHEMA, of.KEYS, buckets=BUCKETS)
    late = facts.where(F.col("cost_id") % LATE_LACKS != 0).withColumn("amount", F.when(
        F.col("cost_id") % LATE_RAISES == 0, F.col("amount") + 5).otherwise(F.col("amount")).cast(of.AMOUNT))
    for run, batch in (("r1", of.initial_load(facts)), ("r3", of.snapshot_batch(facts)), ("r2", late), ("r4", of.corrected(facts))):
        apply_run(lake.at(run), hist, batch, SNAPSHOT)
    return of.as_double(versions(lake, hist), "amount")


def q42_clustering(spark, sf_dir):
    """Files and rows of each period before and after a clustering of a table written in three slices; one period was
    written whole."""
    facts = of.cost_facts(of.table(spark, sf_dir, "orders"))
    lake = Lake(spark, scratch_root(spark, "cluster"))
    silver = Dataset("silver", "costs", "sliced", of.FACT_SCHEMA, of.KEYS, ("cost_period",))
    whole = F.col("cost_period") == WHOLE
    for k in range(3):
        slice_of = facts.where((~whole & (F.col("cost_id") % 3 == k)) | (whole & F.lit(k == 0)))
        write(lake, silver, slice_of, "overwrite" if k == 0 else "append")
    before = stage(layout(lake, silver), "before")[0].select("cost_period", F.col("files").alias("files_before"))
    cluster(lake, silver, ("cost_id", "amount"))
    after = layout(lake, silver).select("cost_period", F.col("files").alias("files_after"), "rows")
    sums = read(lake, silver).groupBy("cost_period").agg(F.sum("amount").cast("double").alias("amount"))
    return before.join(after, "cost_period", "full").join(sums, "cost_period", "full")


QUERIES = {"q42_clustering": q42_clustering, "q41_late_history": q41_late_history, "q39_parent_groups": q39_parent_groups, "q40_key_index": q40_key_index}

ORACLE = {
    "q42_clustering": sql_with(SQL_FACTS) + f"""SELECT cost_period, CASE WHEN cost_period = '{WHOLE}' THEN 1
  ELSE count(DISTINCT cost_id % 3) END AS files_before, 1 AS files_after, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS amount
FROM facts GROUP BY 1""",

    "q41_late_history": sql_with(SQL_FACTS, SQL_INITIAL, SQL_CORRECTED, SQL_SNAPSHOT) + f""", b AS (SELECT 1 AS n, * FROM initial
  UNION ALL SELECT 2, cost_id, cost_period, cost_center, CASE WHEN cost_id % {LATE_RAISES} = 0 THEN amount + 5 ELSE amount END
    FROM facts WHERE cost_id % {LATE_LACKS} <> 0
  UNION ALL SELECT 3, * FROM snap UNION ALL SELECT 4, * FROM corrected),
g AS (SELECT k.cost_id, r.n, cost_period, cost_center, amount, b.cost_id IS NOT NULL AS here
  FROM (SELECT DISTINCT cost_id FROM b) k CROSS JOIN (SELECT unnest(range(1, 5)) AS n) r LEFT JOIN b ON b.cost_id = k.cost_id AND b.n = r.n),
w AS (SELECT *, lag(here) OVER o AS ph, lag(cost_period) OVER o AS pp, lag(cost_center) OVER o AS pc, lag(amount) OVER o AS pa
  FROM g WINDOW o AS (PARTITION BY cost_id ORDER BY n)),
e AS (SELECT *, lead(n) OVER (PARTITION BY cost_id ORDER BY n) AS nx FROM w WHERE ph IS NULL OR here <> ph
  OR cost_period IS DISTINCT FROM pp OR cost_center IS DISTINCT FROM pc OR amount IS DISTINCT FROM pa)
SELECT cost_id, cost_period, cost_center, CAST(amount AS DOUBLE) AS amount, 'r' || n AS valid_from, 'r' || nx AS valid_to,
  nx IS NULL AS is_current FROM e WHERE here""",

    "q39_parent_groups": f"""WITH {_LI_DEDUP}, i AS (SELECT l_orderkey, l_linenumber,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS price, l_orderkey % {PARENTS} AS part, l_linenumber = 1 AS first FROM li)
SELECT l_orderkey, count(*) FILTER (WHERE NOT (part = {SHORTENED} AND first)) AS n_items,
  CAST(sum(CASE WHEN part = {RAISED} AND first THEN price + 1 ELSE price END) FILTER (WHERE NOT (part = {SHORTENED} AND first)) AS DOUBLE)
    / count(*) FILTER (WHERE NOT (part = {SHORTENED} AND first)) AS mean_price,
  CASE WHEN part IN ({RAISED}, {SHORTENED}) AND bool_or(first) THEN 'r2' ELSE 'r1' END AS run
FROM i WHERE part <> {EMPTIED} GROUP BY l_orderkey, part HAVING count(*) FILTER (WHERE NOT (part = {SHORTENED} AND first)) > 0""",

    "q40_key_index": sql_with(SQL_FACTS, SQL_INITIAL, SQL_CORRECTED, SQL_BATCH, SQL_MERGED) + f""", t AS (
  SELECT cost_id, cost_period FROM merged WHERE cost_id % {DELETED} <> 0
  UNION ALL SELECT cost_id, '{REBORN_IN}' FROM facts WHERE cost_id % {REBORN} = 0)
SELECT cost_id, cost_period AS index_period, cost_period FROM t""",
}
