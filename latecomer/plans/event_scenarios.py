"""Driver queries over ``events`` (q03, q04, q14, q15): day windows, JSON records,
GeoJSON features and significance classes.

``events`` stands for the earthquake feed. Each event becomes a GeoJSON feature by
fixed arithmetic (so DuckDB can derive the same values): longitude, latitude and depth
from the ids, magnitude = ``value``, significance = ``floor(value * 10)``. Error events
carry no geometry and no significance, view events carry no depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions.scalar import (day_string, day_window, epoch_ms_to_date_string, in_window,
                                ntz_epoch_ms, sig_class)
from ..session import scratch_root
from ..sinks.landing import feature_collections, json_of, land_text, record_arrays
from ..sources.geojson import features_to_rows, normalize_features, read_feed
from ..sources.records import cast_to, read_records
from .orders_facts import table

# fixed values of the feature rendering
LON_MULT, LON_MOD = 7919, 36000
LAT_MULT, LAT_MOD = 104729, 17000
DEPTH_MOD = 700
ZONES = 40
UPDATE_STEP_MS, UPDATE_MOD = 60000, 7
PER_DOC = 256
LOGICAL_DAY = "2024-01-15"


def event_longitude() -> F.Column:
    return ((F.col("event_id") * LON_MULT) % LON_MOD).cast("double") / 100.0 - 180.0


def event_latitude() -> F.Column:
    return ((F.col("event_id") * LAT_MULT) % LAT_MOD).cast("double") / 100.0 - 85.0


def event_depth() -> F.Column:
    return (F.col("user_id") % DEPTH_MOD).cast("double") / 10.0


def event_sig() -> F.Column:
    return F.when(F.col("event_type") == "error", F.lit(None).cast("bigint")) \
        .otherwise(F.floor(F.col("value") * 10).cast("bigint"))


def event_features(events: DataFrame, update_offset_ms: int = 0) -> DataFrame:
    """each event as a compact GeoJSON feature, with the UTC day and a sequence
    number used to pack bounded documents."""
    ms = ntz_epoch_ms("ts")
    coords = (F.when(F.col("event_type") == "view", F.array(event_longitude(), event_latitude()))
               .otherwise(F.array(event_longitude(), event_latitude(), event_depth())))
    geometry = F.when(F.col("event_type") == "error", F.lit(None)) \
        .otherwise(F.struct(F.lit("Point").alias("type"), coords.alias("coordinates")))
    props = F.struct(
        F.col("value").alias("mag"),
        F.concat(F.lit("zone-"), (F.col("user_id") % ZONES).cast("string")).alias("place"),
        ms.alias("time"),
        (ms + (F.col("event_id") % UPDATE_MOD) * UPDATE_STEP_MS + F.lit(update_offset_ms)).alias("updated"),
        F.lit("reviewed").alias("status"),
        event_sig().alias("sig"),
        F.col("event_type").alias("magType"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("title"),
    )
    feature = json_of(F.lit("Feature").alias("type"),
                      F.concat(F.lit("ev"), F.col("event_id").cast("string")).alias("id"),
                      props.alias("properties"), geometry.alias("geometry"))
    return events.select(F.col("event_id"), epoch_ms_to_date_string(ms).alias("event_date"),
                         feature.alias("feature"))


def land_event_feed(spark: SparkSession, events: DataFrame, path: str | None = None) -> str:
    """Land the events as a daily GeoJSON feed; returns the feed folder."""
    path = path or scratch_root(spark, "feed")
    docs = feature_collections(event_features(events), "feature", "event_date", "event_id", PER_DOC)
    land_text(docs, path, "event_date")
    return path


# ------------------------------------------------------------------ q03  S6, F5, F6

def q03_day_window(spark, sf_dir):
    start, end = day_window(LOGICAL_DAY)
    ev = table(spark, sf_dir, "events").where(in_window("ts", start, end))
    return ev.select("event_id", "user_id", "event_type", "value", day_string("ts").alias("event_date"))


# ------------------------------------------------------------------ q04  P1, F8, S8, U3

RAW_RECORD = StructType([
    StructField("cost_id", LongType(), True),
    StructField("cost_period", StringType(), True),
    StructField("cost_center", StringType(), True),
    StructField("amount", DoubleType(), True),
])
CLEAN_RECORD = StructType([
    StructField("cost_id", StringType(), True),
    StructField("cost_period", StringType(), True),
    StructField("cost_center", StringType(), True),
    StructField("amount", DoubleType(), True),
])


def q04_json_records(spark, sf_dir):
    """Events written as arrays of flat JSON records, read back with a fixed schema and
    cast to the clean schema through a frame pipe."""
    ev = table(spark, sf_dir, "events")
    rec = ev.select(
        "event_id", day_string("ts").alias("day"),
        json_of(F.col("event_id").alias("cost_id"), F.date_format("ts", "yyyy-MM").alias("cost_period"),
                F.col("event_type").alias("cost_center"), F.col("value").alias("amount")).alias("rec"))
    path = scratch_root(spark, "records")
    land_text(record_arrays(rec, "rec", "day", "event_id", PER_DOC), path, "day")
    raw = read_records(spark, path, RAW_RECORD, multi_line=False)
    return raw.transform(lambda df: cast_to(df, CLEAN_RECORD))


# ------------------------------------------------------------------ q14  S5, S7, F1-F4, F7, P3

def q14_geojson_flatten(spark, sf_dir):
    """The whole feed landed per day, backfilled in one scan, exploded to features and
    flattened to the analysis columns (missing coordinates give NULLs)."""
    path = land_event_feed(spark, table(spark, sf_dir, "events"))
    rows = features_to_rows(read_feed(spark, path))
    flat = normalize_features(rows)
    return flat.select("id", "longitude", "latitude", "elevation", "title", "place_description",
                       "sig", "mag", "magType",
                       F.unix_millis("time").alias("time_ms"), F.unix_millis("updated").alias("updated_ms"),
                       "event_date")


# ------------------------------------------------------------------ q15  P8

def q15_sig_class(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", event_sig().alias("sig"))
    return ev.withColumn("sig_class", sig_class("sig"))


QUERIES = {
    "q03_day_window": q03_day_window,
    "q04_json_records": q04_json_records,
    "q14_geojson_flatten": q14_geojson_flatten,
    "q15_sig_class": q15_sig_class,
}

SQL_EVENT_SIG = "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END"
SQL_LON = f"CAST((event_id * {LON_MULT}) % {LON_MOD} AS DOUBLE) / 100 - 180"
SQL_LAT = f"CAST((event_id * {LAT_MULT}) % {LAT_MOD} AS DOUBLE) / 100 - 85"
SQL_DEPTH = f"CAST(user_id % {DEPTH_MOD} AS DOUBLE) / 10"

ORACLE = {
    "q03_day_window": f"""SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d') AS event_date
FROM events WHERE ts >= TIMESTAMP '{LOGICAL_DAY}' AND ts < TIMESTAMP '{LOGICAL_DAY}' + INTERVAL 1 DAY""",

    "q04_json_records": """SELECT CAST(event_id AS VARCHAR) AS cost_id, strftime(ts, '%Y-%m') AS cost_period,
       event_type AS cost_center, value AS amount FROM events""",

    "q14_geojson_flatten": f"""SELECT 'ev' || CAST(event_id AS VARCHAR) AS id,
  CASE WHEN event_type = 'error' THEN NULL ELSE {SQL_LON} END AS longitude,
  CASE WHEN event_type = 'error' THEN NULL ELSE {SQL_LAT} END AS latitude,
  CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE {SQL_DEPTH} END AS elevation,
  'event ' || CAST(event_id AS VARCHAR) AS title,
  'zone-' || CAST(user_id % {ZONES} AS VARCHAR) AS place_description,
  {SQL_EVENT_SIG} AS sig,
  value AS mag, event_type AS magType,
  epoch_us(ts) // 1000 AS time_ms, epoch_us(ts) // 1000 + (event_id % {UPDATE_MOD}) * {UPDATE_STEP_MS} AS updated_ms,
  strftime(ts, '%Y-%m-%d') AS event_date
FROM events""",

    "q15_sig_class": f"""SELECT event_id, {SQL_EVENT_SIG} AS sig,
  CASE WHEN {SQL_EVENT_SIG} < 100 THEN 'Low' WHEN {SQL_EVENT_SIG} < 500 THEN 'Moderate' ELSE 'High' END AS sig_class
FROM events""",
}
