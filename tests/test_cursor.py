"""Consumption cursors: no change of a source is lost or taken in twice without need, whatever hops do."""

import pytest
from pyspark.sql import functions as F

from latecomer.dataset import Dataset, Lake
from latecomer.operators.recompute import recompute
from latecomer.operators.rows import map_changed
from latecomer.sinks.cursor import commits, cursors, pending, subscribe, unread
from latecomer.sinks.maintenance import expire_markers
from latecomer.sinks.tables import upsert
from latecomer.sources.tables import affected, read
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

FACT = StructType([StructField("id", LongType()), StructField("g", StringType()), StructField("v", DoubleType())])
SUMS = StructType([StructField("g", StringType()), StructField("v", DoubleType())])
SILVER = Dataset("silver", "c", "fact", FACT, ("id",), ("g",))
GOLD = Dataset("gold", "c", "sums", SUMS, (), ("g",))
OTHER = Dataset("gold", "c", "other", SUMS, (), ("g",))
COPY = Dataset("gold", "c", "copy", FACT, ("id",), ("g",))


@pytest.fixture()
def lake(spark, lake_root):
    return Lake(spark, lake_root)


def put(lake, run, rows, mode="incremental", **more):
    upsert(lake.at(run), SILVER, lake.spark.createDataFrame(rows, FACT), mode, **more)


def total(lake, run, target=GOLD):
    return recompute(lake.at(run), SILVER, target, ("g",), lambda f: f.groupBy("g").agg(F.sum("v").alias("v")))


def rows(lake, ds):
    return sorted(tuple(r) for r in read(lake, ds).collect())


def test_skipped_run_is_taken_in_later(lake):
    put(lake, "r1", [(1, "A", 1.0), (2, "B", 2.0)])
    total(lake, "r1")
    put(lake, "r2", [(3, "A", 5.0)])
    put(lake, "r3", [(4, "B", 7.0)])
    assert len(unread(lake, SILVER, GOLD)) == 2
    assert total(lake, "r3")
    assert rows(lake, GOLD) == [("A", 6.0), ("B", 9.0)]
    assert unread(lake, SILVER, GOLD) == set()
    # the hop's own change set names both groups for the next one
    assert {r.g for r in affected(lake, GOLD, "partitions", "r3").collect()} == {"A", "B"}


def test_nothing_new_is_a_no_op_and_a_repeated_hop_redoes_its_run(lake):
    put(lake, "r1", [(1, "A", 1.0)])
    assert total(lake, "r1") and total(lake, "r1")
    assert not total(lake, "r2") and rows(lake, GOLD) == [("A", 1.0)]


def test_retried_source_run_is_taken_in_again(lake):
    put(lake, "r1", [(1, "A", 1.0)])
    total(lake, "r1")
    put(lake, "r2", [(2, "A", 2.0)])
    total(lake, "r2")
    put(lake, "r2", [(2, "A", 2.0), (3, "C", 3.0)])            # the run is repeated with more rows, after the hop
    assert [run for run, _ in unread(lake, SILVER, GOLD)] == ["r2"]
    assert total(lake, "r3")
    assert rows(lake, GOLD) == [("A", 3.0), ("C", 3.0)]


def test_run_committed_after_a_later_one(lake):
    put(lake, "r3", [(1, "A", 1.0)])
    total(lake, "r3")
    put(lake, "r2", [(2, "B", 2.0)])                           # arrives after r3 was consumed
    assert total(lake, "r4") and rows(lake, GOLD) == [("A", 1.0), ("B", 2.0)]


def test_failed_hop_keeps_its_cursor(lake):
    put(lake, "r1", [(1, "A", 1.0)])
    with pytest.raises(ValueError):
        recompute(lake.at("r1"), SILVER, GOLD, ("g",), lambda f: f.select(F.lit("other").alias("g"), "v"))
    assert len(unread(lake, SILVER, GOLD)) == 1
    assert total(lake, "r2") and rows(lake, GOLD) == [("A", 1.0)]


def test_readers_move_on_their_own_and_expiry_waits(lake):
    for target in (GOLD, OTHER):
        subscribe(lake, SILVER, target)
        subscribe(lake, SILVER, target)
    put(lake, "r1", [(1, "A", 1.0)])
    total(lake, "r1")
    put(lake, "r2", [(1, "A", 2.0)])
    total(lake, "r2")
    with pytest.raises(ValueError, match="readers still need"):
        expire_markers(lake, SILVER, "r2")
    assert len(commits(lake, SILVER)) == 2
    assert pending(lake.at("r3"), SILVER, OTHER)[0] == ["r1", "r2"]
    total(lake, "r3", OTHER)
    assert rows(lake, OTHER) == rows(lake, GOLD) == [("A", 2.0)]
    assert expire_markers(lake, SILVER, "r2") == ["keys/r1", "partitions/r1"]
    assert [run for run, _ in commits(lake, SILVER)] == ["r2"]
    assert all({run for run, _ in taken} == {"r2", "subscribed"} for taken in cursors(lake, SILVER).values())


def test_key_deleted_and_reborn_between_two_hops(lake):
    """The mapped copy skips the deleting run and the one that brings the key back."""
    put(lake, "r1", [(1, "A", 1.0), (2, "B", 2.0), (3, "B", 3.0)], "snapshot")
    map_changed(lake.at("r1"), SILVER, COPY, lambda r: r)
    put(lake, "r2", [(1, "A", 1.0)], "snapshot")
    put(lake, "r3", [(1, "A", 1.0), (2, "C", 9.0)], "snapshot")
    assert map_changed(lake.at("r3"), SILVER, COPY, lambda r: r)
    assert rows(lake, COPY) == rows(lake, SILVER) == [(1, "A", 1.0), (2, "C", 9.0)]


def test_several_hops_deep(lake):
    """The middle hop skips a run; the last one skips the run in which the middle one caught up."""
    top = Dataset("gold", "c", "top", StructType([StructField("g", StringType()), StructField("v", DoubleType())]), (), ("g",))
    last = lambda run: recompute(lake.at(run), GOLD, top, ("g",), lambda f: f.select("g", (F.col("v") * 10).alias("v")))
    put(lake, "r1", [(1, "A", 1.0), (2, "B", 1.0)])
    total(lake, "r1")
    last("r1")
    put(lake, "r2", [(3, "A", 1.0)])
    put(lake, "r3", [(4, "B", 1.0)])
    total(lake, "r3")
    put(lake, "r4", [(5, "C", 1.0)])
    total(lake, "r4")
    last("r4")
    assert rows(lake, top) == [("A", 20.0), ("B", 20.0), ("C", 10.0)]


def test_query_has_groups_of_every_run():
    import duckdb

    from latecomer.plans.cursor_scenarios import ORACLE

    from .conftest import SF_SMALL
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{SF_SMALL}/orders.parquet')")
    found = con.execute(f"SELECT DISTINCT reader, run FROM ({ORACLE['q38_skipped_hops']})").fetchall()
    assert {("prompt", "r1"), ("prompt", "r2"), ("prompt", "r3"), ("late", "r1"), ("late", "r3")} <= set(found)
