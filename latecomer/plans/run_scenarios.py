"""Driver queries running the two complete pipelines over several runs (q17, q20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dataset import Lake
from ..session import scratch_root
from ..sinks.landing import feature_collections, json_of, land_text, record_arrays
from ..sources.tables import read
from . import costs, earthquakes
from . import orders_facts as of
from .event_scenarios import PER_DOC, SQL_LAT, SQL_LON, event_features, land_event_feed
from .geo_scenarios import PLACE_LAT_MOD, PLACE_LAT_MULT, PLACE_LON_MOD, PLACE_LON_MULT, supplier_places
from .orders_facts import (SQL_BATCH, SQL_CORRECTED, SQL_FACTS, SQL_INITIAL, SQL_MERGED,
                           SQL_SNAPSHOT, as_double, sql_with)

# fixed values of the pipeline scenarios
SPLIT_DAY = "2024-01-16"          # run 1 lands the days before, run 2 the days from here on
REVISION_DAY = "2024-01-20"       # feed day on which the revisions are published
REVISION_MOD, REVISION_REM = 7, 3
REVISION_MAG = 0.5
REVISION_DELAY_MS = 86_400_000


# ------------------------------------------------------------------ q17  W1

def _land_cost_records(spark, facts, path):
    """The run's records as arrays of JSON records (bounded documents), in one folder."""
    rec = facts.select("cost_id", F.lit("all").alias("part"),
                       json_of(*[F.col(c) for c in ("cost_id", "cost_period", "cost_center", "amount")]).alias("rec"))
    docs = record_arrays(rec, "rec", "part", "cost_id", PER_DOC)
    docs.select("value").write.mode("overwrite").text(path)


def q17_costs_three_runs(spark, sf_dir):
    """Three snapshot runs: the first load; late rows, updates and moves (run twice: a
    retry in the middle); then removed rows. Gold holds the final per-group totals."""
    facts = of.cost_facts(of.table(spark, sf_dir, "orders"))
    root = scratch_root(spark, "costs-pipeline")
    lake = Lake(spark, root)
    runs = [("r1", of.initial_load(facts)), ("r2", of.corrected(facts)), ("r2", of.corrected(facts)),
            ("r3", of.snapshot_batch(facts))]
    for run_ts, batch in runs:
        path = f"{root}/landing/{run_ts}"
        _land_cost_records(spark, batch, path)
        costs.run(lake.at(run_ts), path)
    return as_double(read(lake, of.GOLD), "amount")


# ------------------------------------------------------------------ q20  W2

def q20_earthquakes_two_runs(spark, sf_dir):
    """Two runs over a landed feed: run 1 backfills the days before the split, run 2 the
    days after plus revisions of earlier events (bigger magnitude, later update time).
    Gold is enriched with the nearest place and the significance class."""
    events = of.table(spark, sf_dir, "events")
    root = scratch_root(spark, "quake-pipeline")
    feed = land_event_feed(spark, events, f"{root}/feed")
    early = F.col("ts") < F.to_date(F.lit(SPLIT_DAY)).cast("timestamp_ntz")
    revised = (events.where(early & ((F.col("event_id") % REVISION_MOD) == REVISION_REM))
               .withColumn("value", F.col("value") + F.lit(REVISION_MAG)))
    rev_feats = event_features(revised, REVISION_DELAY_MS).withColumn("event_date", F.lit(REVISION_DAY))
    land_text(feature_collections(rev_feats, "feature", "event_date", "event_id", PER_DOC),
              f"{root}/revisions", "event_date")
    places = supplier_places(spark, sf_dir)
    lake = Lake(spark, root)
    earthquakes.run(lake.at("r1"), [feed, f"{root}/revisions"], places, None, SPLIT_DAY)
    earthquakes.run(lake.at("r2"), [feed, f"{root}/revisions"], places, SPLIT_DAY, None)
    # the serving copy, as its readers see it
    copy = spark.read.schema(earthquakes.GOLD.schema).parquet(f"{root}/serving/earthquake_events")
    return copy.select("id", "event_date", "mag", "sig", "sig_class", "country_code", "city",
                       F.unix_millis("updated").alias("updated_ms"))


# ------------------------------------------------------------------ q29  streaming form

def q29_stream_propagation(spark, sf_dir):
    """The first load, then the late/corrected batch, land as files; a file stream with
    an available-now trigger runs after each landing (two scheduled runs, one micro-batch
    each). Gold equals the batch computation of q10."""
    from ..operators.aggregates import grouped_sum
    from ..streaming.feed import start_file_stream

    facts = of.cost_facts(of.table(spark, sf_dir, "orders"))
    root = scratch_root(spark, "stream")
    lake = Lake(spark, root)
    source = f"{root}/landing"
    for i, batch in enumerate((of.initial_load(facts), of.incremental_batch(facts))):
        batch.write.mode("append").parquet(source)
        q = start_file_stream(spark, source, of.FACT_SCHEMA, lake, of.SILVER, of.GOLD, of.GROUPS,
                              lambda f: grouped_sum(f, of.GROUPS, "amount"))
        q.awaitTermination()
    return as_double(read(lake, of.GOLD), "amount")


# ------------------------------------------------------------------ q18b  A5 over the enriched feed

def q18b_events_by_country(spark, sf_dir):
    """The BI chart of the earthquake feed: enriched events counted by country code, most
    frequent first (ties by code), top 1000 rows. Events without coordinates count
    under a NULL country."""
    from ..operators.aggregates import top_counts
    from ..sources.geojson import features_to_rows, normalize_features, read_feed
    events = of.table(spark, sf_dir, "events")
    feed = land_event_feed(spark, events)
    flat = normalize_features(features_to_rows(read_feed(spark, feed)))
    enriched = earthquakes.enrich(flat, supplier_places(spark, sf_dir))
    return top_counts(enriched, "country_code", 1000, "count")


QUERIES = {
    "q17_costs_three_runs": q17_costs_three_runs,
    "q20_earthquakes_two_runs": q20_earthquakes_two_runs,
    "q29_stream_propagation": q29_stream_propagation,
    "q18b_events_by_country": q18b_events_by_country,
}

_REV = f"(event_id % {REVISION_MOD} = {REVISION_REM} AND ts < TIMESTAMP '{SPLIT_DAY}')"

ORACLE = {
    "q18b_events_by_country": f"""WITH pts AS (SELECT event_id, radians({SQL_LAT}) AS la, radians({SQL_LON}) AS lo
                FROM events WHERE event_type <> 'error'),
pls AS (SELECT s_suppkey, n_name,
               radians(CAST((s_suppkey * {PLACE_LAT_MULT}) % {PLACE_LAT_MOD} AS DOUBLE) / 100 - 80) AS la,
               radians(CAST((s_suppkey * {PLACE_LON_MULT}) % {PLACE_LON_MOD} AS DOUBLE) / 100 - 179.99) AS lo
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
d AS (SELECT p.event_id, s.n_name,
             row_number() OVER (PARTITION BY p.event_id ORDER BY
               power(cos(p.la) * cos(p.lo) - cos(s.la) * cos(s.lo), 2)
             + power(cos(p.la) * sin(p.lo) - cos(s.la) * sin(s.lo), 2)
             + power(sin(p.la) - sin(s.la), 2), s.s_suppkey) AS rn
      FROM pts p CROSS JOIN pls s),
c AS (SELECT e.event_id, d.n_name AS country_code FROM events e LEFT JOIN d ON d.event_id = e.event_id AND d.rn = 1)
SELECT country_code, COUNT(*) AS count FROM c GROUP BY country_code
ORDER BY count DESC, country_code ASC NULLS LAST LIMIT 1000""",

    "q29_stream_propagation": sql_with(SQL_FACTS, SQL_INITIAL, SQL_CORRECTED, SQL_BATCH, SQL_MERGED)
    + "SELECT cost_period, cost_center, CAST(SUM(amount) AS DOUBLE) AS amount FROM merged GROUP BY 1, 2",

    "q17_costs_three_runs": sql_with(SQL_FACTS, SQL_CORRECTED, SQL_SNAPSHOT)
    + "SELECT cost_period, cost_center, CAST(SUM(amount) AS DOUBLE) AS amount FROM snap GROUP BY 1, 2",

    "q20_earthquakes_two_runs": f"""WITH ev AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN {_REV} THEN value + {REVISION_MAG} ELSE value END AS value,
         CASE WHEN {_REV} THEN {REVISION_DELAY_MS} ELSE 0 END AS off
  FROM events),
pts AS (SELECT event_id, radians({SQL_LAT}) AS la, radians({SQL_LON}) AS lo FROM ev WHERE event_type <> 'error'),
pls AS (SELECT s_suppkey, s_name, n_name,
               radians(CAST((s_suppkey * {PLACE_LAT_MULT}) % {PLACE_LAT_MOD} AS DOUBLE) / 100 - 80) AS la,
               radians(CAST((s_suppkey * {PLACE_LON_MULT}) % {PLACE_LON_MOD} AS DOUBLE) / 100 - 179.99) AS lo
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
d AS (SELECT p.event_id, s.s_name, s.n_name,
             row_number() OVER (PARTITION BY p.event_id ORDER BY
               power(cos(p.la) * cos(p.lo) - cos(s.la) * cos(s.lo), 2)
             + power(cos(p.la) * sin(p.lo) - cos(s.la) * sin(s.lo), 2)
             + power(sin(p.la) - sin(s.la), 2), s.s_suppkey) AS rn
      FROM pts p CROSS JOIN pls s),
sg AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS sig FROM ev)
SELECT 'ev' || CAST(sg.event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d') AS event_date, value AS mag, sig,
       CASE WHEN sig < 100 THEN 'Low' WHEN sig < 500 THEN 'Moderate' ELSE 'High' END AS sig_class,
       d.n_name AS country_code, d.s_name AS city,
       epoch_us(ts) // 1000 + (sg.event_id % 7) * 60000 + off AS updated_ms
FROM sg LEFT JOIN d ON d.event_id = sg.event_id AND d.rn = 1""",
}
