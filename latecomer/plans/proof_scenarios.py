"""Driver queries (q30-q37) that would show it if scoped work missed, lost or redid something.

Each one runs a small lake over the whole ``orders`` table and reads the result back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..dataset import Dataset, Lake, bronze_schema
from ..operators.aggregates import grouped_sum
from ..operators.recompute import backfill, recompute
from ..operators.rows import map_changed
from ..operators.history import split_tombstones
from ..session import scratch_root
from ..sinks.maintenance import expire_markers
from ..sinks.tables import replace_groups, upsert, write_bronze
from ..sources.tables import LEVELS, affected, read, read_new
from . import orders_facts as of
from . import template
from .orders_facts import GROUPS, SQL_FACTS, as_double, sql_with

# fixed values of the scenarios
FEW_PERIOD, FEW_CENTERS = "1995-03", ("1-URGENT", "3-MEDIUM", "5-LOW")
REPLACED = ("1995-01", "1996-02")
LOST_CENTER = "5-LOW"
RANGE = ("1995-01", "1995-06")
NAMED = ("1997-03", "2-HIGH")
FLAG_MOD = 11


def _facts(spark, sf_dir):
    return of.cost_facts(of.table(spark, sf_dir, "orders"))


def _lake(spark, label):
    return Lake(spark, scratch_root(spark, label))


def _sum(f: DataFrame) -> DataFrame:
    return grouped_sum(f, GROUPS, "amount")


# ------------------------------------------------------------------ q30  S3, K5, K6, C4, C8

TYPED = ("flag", "num", "at", "label")


def _typed(facts: DataFrame) -> DataFrame:
    k = F.col("cost_id")
    return facts.select(
        "cost_id", F.when(k % 3 == 0, F.lit(True)).when(k % 3 == 1, F.lit(False)).alias("flag"),
        F.when(k % 4 == 0, F.lit(1e10)).when(k % 4 == 1, F.lit(0.5)).alias("num"),
        F.when(k % 2 == 0, F.timestamp_millis(F.lit(1577836800500))).alias("at"),
        F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.lit("a b/c%")).alias("label"), "amount")


def q30_typed_groups(spark, sf_dir):
    """Groups of boolean, double, timestamp and text columns with NULL and ''; the second run is
    a snapshot that empties the groups of one combination. '' counts as NULL in a partition column."""
    facts = _typed(_facts(spark, sf_dir))
    silver = Dataset("silver", "typed", "fact", facts.schema, ("cost_id",), TYPED)
    gold = Dataset("gold", "typed", "sums", _typed_sum(facts).schema, (), TYPED)
    lake = _lake(spark, "typed")
    for run, batch in (("r1", facts), ("r2", facts.where("NOT (flag <=> true AND num <=> 1e10)"))):
        upsert(lake.at(run), silver, batch, "snapshot")
        recompute(lake.at(run), silver, gold, TYPED, _typed_sum)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return as_double(read(lake, gold), "amount").select(
        text("flag").alias("flag"), F.coalesce("num", F.lit(-1.0)).alias("num"), text("label").alias("label"),
        F.coalesce(F.unix_millis("at"), F.lit(-1)).alias("at_ms"), "amount")


def _typed_sum(f: DataFrame) -> DataFrame:
    return grouped_sum(f, TYPED, "amount")


# ------------------------------------------------------------------ q31  few groups change

def q31_few_groups(spark, sf_dir):
    """The second batch touches three groups; every gold row names the run that computed it, so
    a full recompute would show."""
    facts = _facts(spark, sf_dir)
    lake = _lake(spark, "few")
    gold = Dataset("gold", "costs", "by_run", StructType([*_sum(facts).schema.fields, StructField("run", StringType())]),
                   (), ("cost_period",))
    silver = Dataset("silver", "costs", "fact_by_period", of.FACT_SCHEMA, of.KEYS, GROUPS)
    few = facts.where((F.col("cost_period") == FEW_PERIOD) & F.col("cost_center").isin(*FEW_CENTERS)).withColumn(
        "amount", (F.col("amount") + 1).cast(of.AMOUNT))
    for run, batch in (("r1", facts), ("r2", few)):
        upsert(lake.at(run), silver, batch)
        recompute(lake.at(run), silver, gold, GROUPS, lambda f, run=run: _sum(f).withColumn("run", F.lit(run)))
    return as_double(read(lake, gold), "amount")


# ------------------------------------------------------------------ q32  K6 coarser, C7 aggregate -> map

def q32_coarser_replace(spark, sf_dir):
    """Two periods are replaced in a table partitioned by (period, center), one center of them
    is gone; a map step follows the change set of the replace, then an aggregate follows the map."""
    facts = _facts(spark, sf_dir)
    sums = _sum(facts)
    by_group = Dataset("gold", "costs", "replaced", sums.schema, GROUPS, GROUPS)
    halves = Dataset("gold", "costs", "halves", sums.select(*GROUPS, F.lit(0.0).alias("half")).schema, GROUPS,
                     ("cost_period",))
    months = Dataset("gold", "costs", "half_by_month", StructType([
        StructField("cost_period", StringType()), StructField("half", DoubleType())]), (), ("cost_period",))
    lake = _lake(spark, "coarser")
    two = facts.where(F.col("cost_period").isin(*REPLACED))
    for run, rows, scope in (("r1", facts, facts), ("r2", two.where(F.col("cost_center") != LOST_CENTER), two)):
        now = lake.at(run)
        replace_groups(now, by_group, _sum(rows), scope.select("cost_period").distinct(), ["cost_period"])
        map_changed(now, by_group, halves, lambda r: r.select(*GROUPS, (F.col("amount").cast("double") / 2).alias("half")))
        recompute(now, halves, months, ("cost_period",), lambda f: f.groupBy("cost_period").agg(
            F.round(F.sum("half"), 4).alias("half")))
    return read(lake, months)


# ------------------------------------------------------------------ q33  D6, P6, P7

def q33_backfill(spark, sf_dir):
    """Full backfill; then the source changes without a recompute, and a ranged backfill and one
    of a named group bring only their groups up to date. A center of the range has left the source."""
    facts = _facts(spark, sf_dir)
    lake = _lake(spark, "backfill")
    gold = Dataset("gold", "costs", "backfilled", _sum(facts).schema, (), ("cost_period",))
    upsert(lake.at("r1"), of.SILVER, facts, "snapshot")
    backfill(lake.at("r1"), of.SILVER, gold, GROUPS, _sum)
    upsert(lake.at("r2"), of.SILVER, facts.where(F.col("cost_center") != LOST_CENTER).withColumn(
        "amount", (F.col("amount") + 1).cast(of.AMOUNT)), "snapshot")
    backfill(lake.at("r3"), of.SILVER, gold, GROUPS, _sum, lower=RANGE[0], upper=RANGE[1], on="cost_period")
    backfill(lake.at("r4"), of.SILVER, gold, GROUPS, _sum, named_groups=[NAMED])
    return as_double(read(lake, gold), "amount")


# ------------------------------------------------------------------ q34  W3, X4

def q34_template(spark, sf_dir):
    """The template pipeline: an order arrives up to twice in a run (the later arrival is smaller), and the
    second snapshot drops some."""
    facts = _facts(spark, sf_dir).select(F.col("cost_id").cast("string").alias("id"), F.col("cost_period").alias("period"),
                                         F.round(F.col("amount"), 0).cast("double").alias("amount"), "cost_id")
    twice = facts.withColumn("no", F.lit(1)).unionByName(
        facts.where("cost_id % 2 = 0").withColumn("amount", F.col("amount") - 1).withColumn("no", F.lit(2)))
    lake = _lake(spark, "template")
    template.run(lake.at("r1"), "orders", twice, arrival_col="no")
    template.run(lake.at("r2"), "orders", twice.where(f"cost_id % {FLAG_MOD} <> 0"), arrival_col="no")
    return read(lake, template.datasets("orders")[2])


# ------------------------------------------------------------------ q35  D10

def q35_expired_markers(spark, sf_dir):
    """Rows left in the change channel of three runs after those before the third are expired."""
    facts = _facts(spark, sf_dir)
    lake = _lake(spark, "expire")
    silver = Dataset("silver", "costs", "expiring", of.FACT_SCHEMA, of.KEYS, ("cost_period",))
    for run, batch in (("r1", facts), ("r2", facts.where("cost_id % 13 <> 0")), ("r3", facts.where("cost_id % 7 <> 0"))):
        upsert(lake.at(run), silver, batch, "snapshot")
    expire_markers(lake, silver, "r3")
    left = [affected(lake, silver, level, run).agg(F.count("*").alias("n")).select(
        F.lit(run).alias("run_ts"), F.lit(level).alias("level"), "n") for run in ("r1", "r2", "r3") for level in LEVELS]
    out = left[0]
    for frame in left[1:]:
        out = out.unionByName(frame)
    return out


# ------------------------------------------------------------------ q36  P2, F9, F10

def q36_audit_columns(spark, sf_dir):
    """Rows of a landing by run and by whether their landing time is an ISO instant."""
    facts = _facts(spark, sf_dir)
    bronze = Dataset("bronze", "costs", "stamped", bronze_schema(of.FACT_SCHEMA), partition_by=("run_ts",))
    lake = _lake(spark, "audit").at("r1")
    write_bronze(lake, bronze, facts)
    iso = F.col("ingested_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}(Z|[+-]\d\d:\d\d)$")
    return read_new(lake, bronze).groupBy("run_ts", iso.alias("iso_time"), "cost_period").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ q37  D3, D8 apply forms

def q37_tombstones_by_quarter(spark, sf_dir):
    """A batch with deletion flags, then quarters recomputed from a table partitioned by month."""
    facts = _facts(spark, sf_dir)
    lake = _lake(spark, "tombstones")
    silver = Dataset("silver", "costs", "monthly", of.FACT_SCHEMA, of.KEYS, ("cost_period",))
    quarter = lambda d: d.withColumn("quarter", F.concat(
        F.substring("cost_period", 1, 4), F.lit("-Q"), F.ceil(F.substring("cost_period", 6, 2).cast("int") / 3).cast("string")))
    total = lambda f: grouped_sum(f, ("quarter",), "amount")
    gold = Dataset("gold", "costs", "by_quarter", total(quarter(facts)).schema, (), ("quarter",))
    upsert(lake.at("r1"), silver, facts)
    recompute(lake.at("r1"), silver, gold, ("quarter",), total, derive=quarter)
    flagged = facts.where(f"cost_id % {FLAG_MOD} = 0").withColumn("is_deleted", F.col("cost_id") % 2 == 0).withColumn(
        "amount", (F.col("amount") + 1).cast(of.AMOUNT))
    rows, gone = split_tombstones(flagged, of.KEYS)
    upsert(lake.at("r2"), silver, rows, delete_keys=gone)
    recompute(lake.at("r2"), silver, gold, ("quarter",), total, derive=quarter)
    return as_double(read(lake, gold), "amount")


QUERIES = {
    "q30_typed_groups": q30_typed_groups,
    "q31_few_groups": q31_few_groups,
    "q32_coarser_replace": q32_coarser_replace,
    "q33_backfill": q33_backfill,
    "q34_template": q34_template,
    "q35_expired_markers": q35_expired_markers,
    "q36_audit_columns": q36_audit_columns,
    "q37_tombstones_by_quarter": q37_tombstones_by_quarter,
}

_SUM = "CAST(SUM(amount) AS DOUBLE) AS amount"

ORACLE = {
    "q30_typed_groups": sql_with(SQL_FACTS) + f""", t AS (SELECT CASE cost_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag,
  CASE cost_id % 4 WHEN 0 THEN CAST(1e10 AS DOUBLE) WHEN 1 THEN CAST(0.5 AS DOUBLE) END AS num,
  CASE WHEN cost_id % 2 = 0 THEN CAST(1577836800500 AS BIGINT) END AS at_ms,
  CASE WHEN cost_id % 5 = 1 THEN 'a b/c%' END AS label, amount FROM facts)
SELECT coalesce(CAST(flag AS VARCHAR), 'none') AS flag, coalesce(num, -1) AS num, coalesce(at_ms, -1) AS at_ms,
  coalesce(label, 'none') AS label, {_SUM} FROM t WHERE NOT (coalesce(flag, false) AND coalesce(num = 1e10, false))
GROUP BY 1, 2, 3, 4""",

    "q31_few_groups": sql_with(SQL_FACTS) + f""", c AS (SELECT *, cost_period = '{FEW_PERIOD}' AND cost_center IN {FEW_CENTERS} AS hit
  FROM facts)
SELECT cost_period, cost_center, CAST(SUM(CASE WHEN hit THEN amount + 1 ELSE amount END) AS DOUBLE) AS amount,
  CASE WHEN hit THEN 'r2' ELSE 'r1' END AS run FROM c GROUP BY 1, 2, 4""",

    "q32_coarser_replace": sql_with(SQL_FACTS) + f""", s AS (SELECT cost_period, cost_center, SUM(amount) AS amount FROM facts
  WHERE cost_period NOT IN {REPLACED} OR cost_center <> '{LOST_CENTER}' GROUP BY 1, 2)
SELECT cost_period, round(SUM(CAST(amount AS DOUBLE) / 2), 4) AS half FROM s GROUP BY 1""",

    "q33_backfill": sql_with(SQL_FACTS) + f""", c AS (SELECT *, cost_period BETWEEN '{RANGE[0]}' AND '{RANGE[1]}' AS ranged,
  cost_period = '{NAMED[0]}' AND cost_center = '{NAMED[1]}' AS named FROM facts)
SELECT cost_period, cost_center, CAST(SUM(CASE WHEN ranged OR named THEN amount + 1 ELSE amount END) AS DOUBLE) AS amount
FROM c WHERE NOT (ranged AND cost_center = '{LOST_CENTER}') GROUP BY 1, 2""",

    "q34_template": sql_with(SQL_FACTS) + f"""SELECT cost_period AS period,
  SUM(CAST(round(amount, 0) AS DOUBLE) - CASE WHEN cost_id % 2 = 0 THEN 1 ELSE 0 END) AS amount
FROM facts WHERE cost_id % {FLAG_MOD} <> 0 GROUP BY 1""",

    "q35_expired_markers": sql_with(SQL_FACTS) + """, b AS (SELECT * FROM facts WHERE cost_id % 13 <> 0),
c AS (SELECT * FROM facts WHERE cost_id % 7 <> 0),
n AS (SELECT 'keys' AS level, count(*) AS n FROM c UNION ALL
  SELECT 'partitions', count(*) FROM (SELECT cost_period FROM b UNION SELECT cost_period FROM c) UNION ALL
  SELECT 'deleted_keys', count(*) FROM b WHERE cost_id % 7 = 0)
SELECT r.run_ts, n.level, CASE WHEN r.run_ts = 'r3' THEN n.n ELSE 0 END AS n
FROM (VALUES ('r1'), ('r2'), ('r3')) r(run_ts), n""",

    "q36_audit_columns": sql_with(SQL_FACTS)
    + "SELECT 'r1' AS run_ts, true AS iso_time, cost_period, count(*) AS n FROM facts GROUP BY 3",

    "q37_tombstones_by_quarter": sql_with(SQL_FACTS) + f"""SELECT substr(cost_period, 1, 4) || '-Q'
  || CAST((CAST(substr(cost_period, 6, 2) AS INTEGER) + 2) // 3 AS VARCHAR) AS quarter,
  CAST(SUM(CASE WHEN cost_id % {FLAG_MOD} = 0 THEN amount + 1 ELSE amount END) AS DOUBLE) AS amount
FROM facts WHERE NOT (cost_id % {FLAG_MOD} = 0 AND cost_id % 2 = 0) GROUP BY 1""",
}
