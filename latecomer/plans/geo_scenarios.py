"""Driver queries for the nearest-place join and the BI metric (q16, q18).

Places stand for a reverse-geocoding gazetteer: suppliers, with the supplier name as the
city and the supplier's nation as the country code. Points are customers. Coordinates
come from fixed arithmetic on the keys, so DuckDB derives the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import top_counts
from ..operators.nearest import nearest_place
from .orders_facts import table

# fixed values of the coordinate rule
POINT_LAT_MULT, POINT_LAT_MOD = 7919, 17001
POINT_LON_MULT, POINT_LON_MOD = 104729, 36001
PLACE_LAT_MULT, PLACE_LAT_MOD = 15485863, 16001
PLACE_LON_MULT, PLACE_LON_MOD = 32452843, 35999
BI_ROW_LIMIT = 1000


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey", "c_nationkey",
        (((F.col("c_custkey") * POINT_LAT_MULT) % POINT_LAT_MOD).cast("double") / 100.0 - 85.0).alias("lat"),
        (((F.col("c_custkey") * POINT_LON_MULT) % POINT_LON_MOD).cast("double") / 100.0 - 180.0).alias("lon"))


def supplier_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place_id, name, cc, lat, lon). ``nation`` has 25 rows by definition of the
    schema, a fixed bound, so it is broadcast."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    return (s.join(n, s.s_nationkey == n.n_nationkey, "left")
            .select(F.col("s_suppkey").alias("place_id"), F.col("s_name").alias("name"),
                    F.col("n_name").alias("cc"),
                    (((F.col("s_suppkey") * PLACE_LAT_MULT) % PLACE_LAT_MOD).cast("double") / 100.0 - 80.0).alias("lat"),
                    (((F.col("s_suppkey") * PLACE_LON_MULT) % PLACE_LON_MOD).cast("double") / 100.0 - 179.99).alias("lon")))


# ------------------------------------------------------------------ q16  J7

def q16_nearest_place(spark, sf_dir):
    pts = customer_points(spark, sf_dir)
    places = supplier_places(spark, sf_dir)
    near = nearest_place(pts, places, "c_custkey", "place_id")
    return near.select("c_custkey", F.col("place_id").alias("s_suppkey"))


# ------------------------------------------------------------------ q18  A5, O1, O2

def q18_top_countries(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey, "left").select(F.col("n_name").alias("country_code"))
    return top_counts(rows, "country_code", BI_ROW_LIMIT, "count")


QUERIES = {
    "q16_nearest_place": q16_nearest_place,
    "q18_top_countries": q18_top_countries,
}

SQL_POINTS = f"""pts AS (
  SELECT c_custkey,
         radians(CAST((c_custkey * {POINT_LAT_MULT}) % {POINT_LAT_MOD} AS DOUBLE) / 100 - 85) AS la,
         radians(CAST((c_custkey * {POINT_LON_MULT}) % {POINT_LON_MOD} AS DOUBLE) / 100 - 180) AS lo
  FROM customer)"""
SQL_PLACES = f"""pls AS (
  SELECT s_suppkey,
         radians(CAST((s_suppkey * {PLACE_LAT_MULT}) % {PLACE_LAT_MOD} AS DOUBLE) / 100 - 80) AS la,
         radians(CAST((s_suppkey * {PLACE_LON_MULT}) % {PLACE_LON_MOD} AS DOUBLE) / 100 - 179.99) AS lo
  FROM supplier)"""
SQL_NEAREST = f"""WITH {SQL_POINTS}, {SQL_PLACES},
d AS (
  SELECT p.c_custkey, s.s_suppkey,
         power(cos(p.la) * cos(p.lo) - cos(s.la) * cos(s.lo), 2)
       + power(cos(p.la) * sin(p.lo) - cos(s.la) * sin(s.lo), 2)
       + power(sin(p.la) - sin(s.la), 2) AS d2
  FROM pts p CROSS JOIN pls s),
r AS (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY d2, s_suppkey) AS rn FROM d)
SELECT c_custkey, s_suppkey FROM r WHERE rn = 1"""

ORACLE = {
    "q16_nearest_place": SQL_NEAREST,
    "q18_top_countries": f"""SELECT n_name AS country_code, COUNT(*) AS count
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY count DESC, country_code ASC NULLS LAST LIMIT {BI_ROW_LIMIT}""",
}
