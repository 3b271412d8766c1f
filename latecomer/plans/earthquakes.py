"""W2, the earthquakes pipeline: day feed -> raw features -> typed silver -> enriched gold
-> serving copy.

extract:   the feed of the run's days (S7, a backfill is a range of days in one scan),
           one row per feature with its JSON kept whole (S5), bronze (K2)
normalize: this run's slice (S2), typed flatten (P3), incremental upsert by ``id``
           (K4): revised events update in place, other days are never deleted
enrich:    only the events changed this run (C5): nearest place (J7) gives country
           code and city, plus the significance class (P8); upsert by ``id``
publish:   replace the serving copy with the whole gold table (K8)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, LongType, StringType, StructField, StructType,
                               TimestampType)

from ..dataset import Dataset, Lake, bronze_schema
from ..functions.scalar import day_window, sig_class
from ..operators.nearest import with_nearest
from ..operators.rows import map_changed
from ..sinks.serving import publish_files, publish_jdbc
from ..sinks.tables import upsert, write_bronze
from ..sources.geojson import BRONZE_PAYLOAD, features_to_rows, normalize_features, read_feed
from ..sources.tables import read, read_new

SOURCE_MODE = "incremental"   # a day's fetch is not the whole source: never delete

SILVER_SCHEMA = StructType([
    StructField("id", StringType(), True),
    StructField("longitude", DoubleType(), True),
    StructField("latitude", DoubleType(), True),
    StructField("elevation", DoubleType(), True),
    StructField("title", StringType(), True),
    StructField("place_description", StringType(), True),
    StructField("sig", LongType(), True),
    StructField("mag", DoubleType(), True),
    StructField("magType", StringType(), True),
    StructField("time", TimestampType(), True),
    StructField("updated", TimestampType(), True),
    StructField("event_date", StringType(), True),
])
GOLD_SCHEMA = StructType(list(SILVER_SCHEMA.fields) + [
    StructField("country_code", StringType(), True),
    StructField("city", StringType(), True),
    StructField("sig_class", StringType(), True),
])

BRONZE = Dataset("bronze", "earthquakes", "raw", bronze_schema(BRONZE_PAYLOAD), partition_by=("run_ts",))
SILVER = Dataset("silver", "earthquakes", "events", SILVER_SCHEMA, key=("id",), partition_by=("event_date",))
GOLD = Dataset("gold", "earthquakes", "events_enriched", GOLD_SCHEMA, key=("id",), partition_by=("event_date",))

ORDER = ("updated",)          # the latest revision of an event wins within a batch


def extract(lake: Lake, feed_paths, start: str | None = None, end: str | None = None) -> None:
    if start is None and end is None:
        start, end = day_window(lake.run.logical_date)
    paths = [feed_paths] if isinstance(feed_paths, str) else list(feed_paths)
    docs = None
    for p in paths:
        d = read_feed(lake.spark, p, start, end)
        docs = d if docs is None else docs.unionByName(d)
    write_bronze(lake, BRONZE, features_to_rows(docs))


def normalize(lake: Lake) -> None:
    upsert(lake, SILVER, normalize_features(read_new(lake, BRONZE)), SOURCE_MODE, order_cols=ORDER)


def enrich(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Country code and city of the nearest place, and the significance class. Rows
    without coordinates get NULL place columns (no failure); the rows' ids may be NULL or repeat."""
    return with_nearest(rows, places, "place_id", {"cc": "country_code", "name": "city"}, "latitude", "longitude").withColumn(
        "sig_class", sig_class("sig"))


def enrich_changed(lake: Lake, places: DataFrame) -> bool:
    return map_changed(lake, SILVER, GOLD, lambda rows: enrich(rows, places), order_cols=ORDER)


def publish(lake: Lake, path: str | None = None, url: str | None = None,
            table: str = "earthquake_events", properties: dict | None = None) -> None:
    gold = read(lake, GOLD)
    if url:
        publish_jdbc(gold, url, table, properties)
    else:
        publish_files(gold, path or f"{lake.root.rstrip('/')}/serving/{table}")


def run(lake: Lake, feed_paths, places: DataFrame, start: str | None = None, end: str | None = None,
        publish_path: str | None = None) -> None:
    extract(lake, feed_paths, start, end)
    normalize(lake)
    enrich_changed(lake, places)
    publish(lake, publish_path)
