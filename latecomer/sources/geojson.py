"""GeoJSON feed landing.

A feed is landed as text files under one folder per day (``event_date=YYYY-MM-DD``);
each file holds FeatureCollection documents, one per line (or one per file with
``whole_files=True``). A backfill over a range of days is one scan with a partition
filter; each document is exploded into one row per feature that keeps the feature's
JSON text whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, LongType, StringType, StructField,
                               StructType)

from ..functions.scalar import (epoch_ms_to_date_string, epoch_ms_to_timestamp, item,
                                parse_json_strict)

BRONZE_PAYLOAD = StructType([StructField("id", StringType(), True), StructField("raw", StringType(), True)])

_COLLECTION = StructType([StructField("features", ArrayType(StringType()), True)])

# fixed contract of the feed: the fields the analysis needs (extra ones are ignored)
FEATURE_SCHEMA = StructType([
    StructField("id", StringType(), True),
    StructField("properties", StructType([
        StructField("mag", DoubleType(), True),
        StructField("place", StringType(), True),
        StructField("time", LongType(), True),
        StructField("updated", LongType(), True),
        StructField("sig", LongType(), True),
        StructField("magType", StringType(), True),
        StructField("title", StringType(), True),
    ]), True),
    StructField("geometry", StructType([
        StructField("coordinates", ArrayType(DoubleType()), True),
    ]), True),
])

_ID_ONLY = StructType([StructField("id", StringType(), True)])


def read_feed(spark: SparkSession, path: str, start: Column | str | None = None, end: Column | str | None = None,
              whole_files: bool = False) -> DataFrame:
    """Landed documents of the days in ``[start, end)`` (all days when unbounded).
    ``event_date`` is a string partition column whatever the session's inference says."""
    reader = spark.read.schema("value string, event_date string").option("basePath", path)
    # text() has its own wholetext argument (default False) that would override an option
    docs = reader.text(path, wholetext=whole_files)
    day = lambda d: F.lit(d) if isinstance(d, str) else F.date_format(d, "yyyy-MM-dd")
    if start is not None:
        docs = docs.where(F.col("event_date") >= day(start))
    if end is not None:
        docs = docs.where(F.col("event_date") < day(end))
    return docs


def features_to_rows(docs: DataFrame, text_col: str = "value") -> DataFrame:
    """One row per feature, ``id`` plus the feature's JSON kept whole. A document
    without (or with null) ``features`` gives no rows; one that is not JSON raises."""
    feats = docs.select(F.explode(parse_json_strict(text_col, _COLLECTION).features).alias("raw"))
    return feats.select(parse_json_strict("raw", _ID_ONLY).id.alias("id"), "raw")


def normalize_features(raw: DataFrame) -> DataFrame:
    """Typed flatten of the raw feature JSON to the analysis columns.
    Malformed JSON raises. ``time`` / ``updated`` are instants; ``event_date`` is the
    UTC day of ``time``."""
    f = parse_json_strict("raw", FEATURE_SCHEMA).alias("f")
    d = raw.select(f)
    coords = F.col("f.geometry.coordinates")
    return d.select(
        F.col("f.id").alias("id"),
        item(coords, 0).alias("longitude"),
        item(coords, 1).alias("latitude"),
        item(coords, 2).alias("elevation"),
        F.col("f.properties.title").alias("title"),
        F.col("f.properties.place").alias("place_description"),
        F.col("f.properties.sig").alias("sig"),
        F.col("f.properties.mag").alias("mag"),
        F.col("f.properties.magType").alias("magType"),
        epoch_ms_to_timestamp("f.properties.time").alias("time"),
        epoch_ms_to_timestamp("f.properties.updated").alias("updated"),
        epoch_ms_to_date_string("f.properties.time").alias("event_date"),
    )
