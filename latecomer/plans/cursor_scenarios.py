"""Driver query q38: hops that skip runs, repeat them or read at their own pace.

Three runs of the whole ``orders`` table change different groups; every gold row names the run that computed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..dataset import Dataset, Lake, bucketed
from ..operators.aggregates import grouped_sum
from ..operators.recompute import recompute
from ..operators.rows import map_changed
from ..session import scratch_root
from ..sinks.cursor import subscribe, unread
from ..sinks.tables import upsert
from ..sources.tables import read
from . import orders_facts as of
from .orders_facts import GROUPS, SQL_FACTS, as_double, sql_with

BUCKETS = 8
# fixed values of the scenario: the centers that runs r2 and r3 change
CHANGED = {"r2": ("1996", "1-URGENT"), "r3": ("1998", "3-MEDIUM")}


def _batch(facts: DataFrame, run: str) -> DataFrame:
    year, center = CHANGED[run]
    return facts.where(F.col("cost_period").startswith(year) & (F.col("cost_center") == center)).withColumn(
        "amount", (F.col("amount") + int(run[1:])).cast(of.AMOUNT))


def q38_skipped_hops(spark, sf_dir):
    """The reader ``late`` skips run r2 and repeats r3; ``prompt`` reads in every run; ``rows`` maps changed keys and
    skips r2. The counts of unread runs are those after r2 and at the end."""
    facts = of.cost_facts(of.table(spark, sf_dir, "orders"))
    lake = Lake(spark, scratch_root(spark, "cursor"))
    silver = bucketed("silver", "costs", "fact_by_group", of.FACT_SCHEMA, of.KEYS, GROUPS, buckets=BUCKETS)
    summed = StructType([*grouped_sum(facts, GROUPS, "amount").schema.fields, StructField("run", StringType())])
    late, prompt = (bucketed("gold", "costs", name, summed, (), GROUPS, buckets=BUCKETS) for name in ("late", "prompt"))
    rows = Dataset("gold", "costs", "rows", of.FACT_SCHEMA, of.KEYS, ("cost_center",))
    readers = (late, prompt, rows)
    for reader in readers:
        subscribe(lake, silver, reader)

    def hop(run: str, target: Dataset) -> None:
        if target is rows:
            map_changed(lake.at(run), silver, rows, lambda r: r.select(*of.FACT_SCHEMA.names))
        else:
            recompute(lake.at(run), silver, target, GROUPS,
                      lambda f: grouped_sum(f, GROUPS, "amount").withColumn("run", F.lit(run)))

    left = {}
    for run, targets in (("r1", readers), ("r2", (prompt,)), ("r3", (late, prompt, rows, late))):
        upsert(lake.at(run), silver, facts if run == "r1" else _batch(facts, run))
        for target in targets:
            hop(run, target)
        left[run] = [len(unread(lake, silver, reader)) for reader in readers]
    sums = read(lake, rows).groupBy(*GROUPS).agg(F.sum("amount").alias("amount")).withColumn("run", F.lit("-"))
    out = None
    for k, (name, df) in enumerate((("late", read(lake, late)), ("prompt", read(lake, prompt)), ("rows", sums))):
        one = as_double(df, "amount").select(F.lit(name).alias("reader"), *GROUPS, "amount", "run",
                                             F.lit(left["r2"][k]).alias("unread_r2"), F.lit(left["r3"][k]).alias("unread_r3"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"q38_skipped_hops": q38_skipped_hops}

ORACLE = {
    "q38_skipped_hops": sql_with(SQL_FACTS) + f""", c AS (SELECT *, CASE
    WHEN cost_period LIKE '{CHANGED["r2"][0]}%' AND cost_center = '{CHANGED["r2"][1]}' THEN 2
    WHEN cost_period LIKE '{CHANGED["r3"][0]}%' AND cost_center = '{CHANGED["r3"][1]}' THEN 3 ELSE 1 END AS run FROM facts),
s AS (SELECT cost_period, cost_center, run, CAST(SUM(CASE WHEN run > 1 THEN amount + run ELSE amount END) AS DOUBLE) AS amount
  FROM c GROUP BY 1, 2, 3)
SELECT 'late' AS reader, cost_period, cost_center, amount, CASE WHEN run > 1 THEN 'r3' ELSE 'r1' END AS run, 1 AS unread_r2, 0 AS unread_r3 FROM s
UNION ALL SELECT 'prompt', cost_period, cost_center, amount, 'r' || run, 0, 0 FROM s
UNION ALL SELECT 'rows', cost_period, cost_center, amount, '-', 1, 0 FROM s""",
}
