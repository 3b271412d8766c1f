"""Consumption cursors (C7, S9, D10): which recorded changes of a table each of its readers has taken in.

Every recorded change set gets a commit: one row (run, commit id) in the table's commit log, replaced when the run is
retried. A reader (a downstream table) has a cursor: the commits it has consumed. What it hasn't consumed, in whatever order
runs were committed, skipped or retried, is what a hop takes in next:

* a hop that was skipped in one run takes that run's changes in with the next one;
* a run that is retried after a reader consumed it has a new commit, so the reader takes it in again;
* a hop that fails leaves its cursor where it was, as the cursor is written last;
* change sets may only be expired once every subscribed reader has consumed them.

Both tables hold one row a run and reader until the run expires; their rows (ids, no data) are what reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import quote

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import fs
from ..dataset import RUN_COL, Dataset, Lake

COMMITS = StructType([StructField("commit", StringType(), True), StructField(RUN_COL, StringType(), True)])
CURSORS = StructType([StructField("commit", StringType(), True), StructField("reader", StringType(), True),
                      StructField(RUN_COL, StringType(), True)])
#: The cursor row of a reader that has subscribed; it belongs to no run and never expires.
SUBSCRIBED = "subscribed"


def reader_name(target: Dataset) -> str:
    return quote(target.rel(), safe="")


def commits(lake: Lake, source: Dataset) -> set[tuple[str, str]]:
    """(run, commit id) of every change set of ``source`` that hasn't expired."""
    path = lake.marker_path(source, "commits")
    if not fs.exists(lake.spark, path):
        return set()
    rows = lake.spark.read.schema(COMMITS).option("basePath", path).parquet(path)
    return {(r[1], r[0]) for r in rows.collect()}


def cursors(lake: Lake, source: Dataset) -> dict[str, set[tuple[str, str]]]:
    """reader -> (run, commit id) consumed, for every subscribed reader of ``source``."""
    path = lake.cursor_path(source)
    out: dict[str, set[tuple[str, str]]] = {}
    if fs.exists(lake.spark, path):
        for commit, reader, run in lake.spark.read.schema(CURSORS).option("basePath", path).parquet(path).collect():
            out.setdefault(reader, set()).add((run, commit))
    return out


def subscribe(lake: Lake, source: Dataset, target: Dataset) -> None:
    """Make ``target`` a reader of ``source``: from now on no change set expires that it hasn't consumed."""
    if reader_name(target) not in cursors(lake, source):
        _append(lake, source, reader_name(target), [(SUBSCRIBED, SUBSCRIBED)])


def unread(lake: Lake, source: Dataset, target: Dataset) -> set[tuple[str, str]]:
    """Commits of ``source`` that ``target`` hasn't consumed."""
    return commits(lake, source) - cursors(lake, source).get(reader_name(target), set())


def pending(lake: Lake, source: Dataset, target: Dataset) -> tuple[list[str], set[tuple[str, str]]]:
    """What a hop takes in: the runs whose changes it needs, and the commits to :func:`consume` after it.

    The current run's own changes are always among them, so that a hop can be repeated in its run."""
    known = commits(lake, source)
    missing = known - cursors(lake, source).get(reader_name(target), set())
    return sorted({run for run, _ in missing} | {run for run, _ in known if run == lake.run.run_ts}), missing


def consume(lake: Lake, source: Dataset, target: Dataset, taken: Iterable[tuple[str, str]]) -> None:
    """Move the cursor of ``target`` past the commits ``taken``."""
    taken = sorted(taken)
    if taken:
        _append(lake, source, reader_name(target), taken)


def _append(lake: Lake, source: Dataset, reader: str, taken: list[tuple[str, str]]) -> None:
    path = lake.cursor_path(source)
    rows = lake.spark.range(0, 1, 1, 1).select(F.inline(F.array(*[F.struct(
        F.lit(commit).alias("commit"), F.lit(reader).alias("reader"), F.lit(run).alias(RUN_COL)) for run, commit in taken])))
    rows.write.mode("append").partitionBy("reader", RUN_COL).parquet(path)
    lake.spark.catalog.refreshByPath(path)


def unread_before(lake: Lake, source: Dataset, before_run: str) -> dict[str, list[str]]:
    """reader -> runs before ``before_run`` that it hasn't consumed."""
    known = commits(lake, source)
    left = {reader: sorted({run for run, _ in known - taken if run < before_run})
            for reader, taken in cursors(lake, source).items()}
    return {reader: runs for reader, runs in left.items() if runs}


def forget(lake: Lake, source: Dataset, before_run: str) -> None:
    """Drop commits and cursor rows of runs before ``before_run`` (their change sets have expired)."""
    for path, schema in ((lake.marker_path(source, "commits"), COMMITS), (lake.cursor_path(source), CURSORS)):
        if not fs.exists(lake.spark, path):
            continue
        rows = lake.spark.read.schema(schema).option("basePath", path).parquet(path)
        old = rows.where((F.col(RUN_COL) < F.lit(before_run)) & (F.col(RUN_COL) != F.lit(SUBSCRIBED))).select(
            F.regexp_replace("_metadata.file_path", "/[^/]*$", "")).distinct()
        for row in old.collect():
            fs.delete(lake.spark, row[0], encoded=True)
        lake.spark.catalog.refreshByPath(path)
