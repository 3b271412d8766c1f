"""JSON-records source (S8) and cast-to-schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import fs


def read_records(spark: SparkSession, path: str, schema: StructType, multi_line: bool = True,
                 arrival_col: str | None = None) -> DataFrame:
    """Files holding arrays of flat records (``multi_line``) or JSON Lines, read with
    a fixed schema; malformed input raises. No input gives a typed empty frame.
    ``arrival_col`` adds the arrival number of each record."""
    if not fs.exists(spark, path):
        empty = spark.createDataFrame([], schema)
        return empty if arrival_col is None else empty.withColumn(arrival_col, F.lit(None).cast("string"))
    rows = (spark.read.schema(schema).option("multiLine", str(multi_line).lower())
            .option("mode", "FAILFAST").json(path))
    return rows if arrival_col is None else rows.withColumn(arrival_col, arrival())


def arrival() -> Column:
    """Sortable arrival number of a file record: file, place in the file, position. Later records of a
    landing are greater, so it orders corrections of one key within a batch."""
    return F.format_string("%s:%020d:%020d", "_metadata.file_path", "_metadata.file_block_start",
                           F.monotonically_increasing_id())


def cast_to(df: DataFrame, schema: StructType, also=()) -> DataFrame:
    """Select and cast to a declared schema. A value that does not convert raises,
    whatever the session's ANSI setting (a plain cast would turn it into NULL with ANSI
    off): the cast is tried, and a non-NULL input with a NULL result is an error."""
    cols = []
    for f in schema.fields:
        src = F.col(f.name)
        if df.schema[f.name].dataType == f.dataType:
            cols.append(src.alias(f.name))
            continue
        tried = src.try_cast(f.dataType)
        bad = F.raise_error(F.concat(F.lit(f"cannot cast {f.name} to {f.dataType.simpleString()}: "),
                                     src.cast("string")))
        cols.append(F.when(src.isNotNull() & tried.isNull(), bad).otherwise(tried).alias(f.name))
    return df.select(*cols, *also)
