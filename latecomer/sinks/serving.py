"""Publishing a gold table to a serving store (K8)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def publish_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None,
                 mode: str = "overwrite", batch_size: int = 10000) -> None:
    """Replace ``table`` in a JDBC database with ``df``; each task writes its own rows over
    its own connection (no row passes through the driver)."""
    (df.write.mode(mode).option("batchsize", str(batch_size))
     .jdbc(url, table, properties=properties or {}))


def publish_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Replace a file-based serving copy (what a SQL engine over the lake reads)."""
    df.write.mode(mode).format(fmt).save(path)
