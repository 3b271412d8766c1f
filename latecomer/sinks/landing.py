"""Landing raw documents (the feed side of S5/S7/S8): rows are packed into documents of
a bounded number of records, so no document (and no task) grows with the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack_documents(rows: DataFrame, json_col: str, day_col: str, seq_col: str,
                   per_doc: int, prefix: str, suffix: str) -> DataFrame:
    """One text document per (day, block of ``per_doc`` consecutive ``seq`` values):
    ``prefix + record, record, ... + suffix``. Groups are bounded by ``per_doc``."""
    block = F.floor(F.col(seq_col) / F.lit(per_doc))
    return (rows.groupBy(F.col(day_col).alias(day_col), block.alias("_block"))
            .agg(F.concat(F.lit(prefix), F.array_join(F.collect_list(json_col), ","), F.lit(suffix)).alias("value"))
            .select("value", day_col))


def feature_collections(rows: DataFrame, json_col: str, day_col: str, seq_col: str,
                        per_doc: int = 256) -> DataFrame:
    return pack_documents(rows, json_col, day_col, seq_col, per_doc,
                          '{"type":"FeatureCollection","features":[', "]}")


def record_arrays(rows: DataFrame, json_col: str, day_col: str, seq_col: str,
                  per_doc: int = 256) -> DataFrame:
    return pack_documents(rows, json_col, day_col, seq_col, per_doc, "[", "]")


def land_text(docs: DataFrame, path: str, day_col: str, mode: str = "overwrite") -> None:
    """Write documents one per line under ``day_col=...`` folders."""
    (docs.select("value", day_col).hint("rebalance", F.col(day_col)).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy(day_col).text(path))


def json_of(*cols: Column) -> Column:
    """compact JSON text of a record."""
    return F.to_json(F.struct(*cols))
