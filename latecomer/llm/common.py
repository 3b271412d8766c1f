"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import release, stage

#: White space that separates words: U+0020 and U+0009-U+000D (``bytes.split`` uses the same set).
SPACE = " \\t-\\r"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers (once per application), so that they can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    handle, name = tempfile.mkstemp(prefix=f"{package.name}-", suffix=".zip")   # Spark serves it to the executors
    os.close(handle)
    with zipfile.ZipFile(name, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)


def arrow(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the Python workers and any column names.

    The columns go by position, so names with dots or of any other kind don't matter.
    """
    ship(df.sparkSession)
    fields = schema if isinstance(schema, T.StructType) else T.DataType.fromDDL(schema)
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(fields)])

    def run(batches):
        for batch in function(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, plain.names)

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, plain).toDF(*fields.names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named ``__c0``, ``__c1``, ... and the name each column now has.

    An operator that keeps all columns of its input works on these, so none clashes with its own.
    """
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


#: Folders staged within the :func:`scope` that is open, by application.
_HELD: dict[str, list[str]] = {}
#: Folders of the last stage, which its lazy result may still read.
_LEFT: dict[str, list[str]] = {}


def staged(df: DataFrame, label: str = "llm", compression: str | None = None) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back (lineage cut).

    Nothing reads the write's shuffle files again. Spark deletes them when the driver collects their owners, which
    with a large heap may take hours; the collection asked for here keeps the disk to what is in use.
    """
    return staged_at(df, label, compression)[0]


def staged_at(df: DataFrame, label: str = "llm", compression: str | None = None) -> tuple[DataFrame, str]:
    """:func:`staged` with the folder, for a caller that releases it before the end of its stage."""
    out, path = stage(df, label, compression)
    held = _HELD.get(df.sparkSession.sparkContext.applicationId)
    if held is not None:
        held.append(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out, path


@contextmanager
def scope(spark: SparkSession, docs: DataFrame):
    """One stage of a pipeline on ``docs``. The tables that the stage before staged are released first: its result has been
    written, and ``docs`` reads that. A folder that ``docs`` still reads is kept."""
    app = spark.sparkContext.applicationId
    left = _LEFT.pop(app, [])
    read = docs.inputFiles() if left else []
    for path in left:
        if not any(f"/{path.rsplit('/', 1)[-1]}/" in file for file in read):
            release(path, spark)
    _HELD[app] = []
    try:
        yield
    finally:
        # tables staged outside of a stage aren't the pipeline's
        _LEFT[app] = _HELD.pop(app)


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for NULL.

    Most texts hold spaces and line feeds only; a split at one character needs no regular expression.
    """
    plain = F.replace(text, F.lit("\n"), F.lit(" "))
    parts = F.when(plain.rlike("[\\t-\\r]"), F.split(plain, f"[{SPACE}]+")).otherwise(F.split(plain, " "))
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def text_key(text: Column) -> Column:
    """64-bit hash that tells apart rows of one id with different texts (NULL has its own value)."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text))
