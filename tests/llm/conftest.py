import uuid

import pytest


@pytest.fixture()
def frame(spark):
    """Rows to a DataFrame with extra columns whose names clash with names used inside the operators."""
    def make(rows, schema="doc_id bigint, text string"):
        return spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS key", "1 AS id", "2 AS n", "'y' AS `a.b`")
    return make


@pytest.fixture()
def folder(tmp_path):
    """Writes tables as the Parquet files of a data folder of its own."""
    def write(**tables):
        root = f"{tmp_path}/{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{root}/{name}.parquet")
        return root
    return write
