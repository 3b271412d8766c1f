"""The maintained history against one rebuilt from all landed runs."""

import random

import pytest
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from latecomer.dataset import Lake
from latecomer.operators.versions import apply_run, history_dataset, intervals, versions, versions_of

ROW = StructType([StructField("id", LongType()), StructField("v", StringType()), StructField("w", DoubleType())])
HIST = history_dataset("h", "hist", ROW, ("id",), buckets=4)


@pytest.fixture()
def lake(spark, lake_root):
    return Lake(spark, lake_root)


def take(lake, run, rows, mode="snapshot", **more):
    apply_run(lake.at(run), HIST, lake.spark.createDataFrame([(k, v, None) for k, v in rows], ROW), mode, **more)


def held(lake):
    return sorted(((r.id, r.v, r.valid_from, r.valid_to) for r in versions(lake, HIST).collect()), key=str)


def rebuilt(lake, slices, mode="snapshot"):
    rows = [(k, v, None, run) for run, s in slices.items() for k, v in s]
    bronze = lake.spark.createDataFrame(rows, StructType([*ROW.fields, StructField("run_ts", StringType())]))
    runs = lake.spark.createDataFrame([(r,) for r in slices], "run_ts string")
    out = versions_of(bronze, ("id",), ("v", "w"), mode, runs=runs)
    return sorted(((r.id, r.v, r.valid_from, r.valid_to) for r in out.collect()), key=str)


def test_late_run_splits_a_confirmed_version(lake):
    take(lake, "r1", [(1, "a")], "incremental")
    take(lake, "r3", [(1, "a")], "incremental")                 # confirms, no new version
    assert held(lake) == [(1, "a", "r1", None)]
    take(lake, "r2", [(1, "b")], "incremental")
    assert held(lake) == [(1, "a", "r1", "r2"), (1, "a", "r3", None), (1, "b", "r2", "r3")]
    take(lake, "r2", [(1, "a")], "incremental")                 # the late run again, corrected: all one version
    assert held(lake) == [(1, "a", "r1", None)]


def test_delete_and_rebirth(lake):
    take(lake, "r1", [(1, "a"), (2, "x"), (None, "n")])
    take(lake, "r2", [(2, "x")])
    take(lake, "r3", [(1, "a"), (2, "y"), (None, "n")])
    assert held(lake) == sorted([(1, "a", "r1", "r2"), (1, "a", "r3", None), (2, "x", "r1", "r3"), (2, "y", "r3", None),
                                 (None, "n", "r1", "r2"), (None, "n", "r3", None)], key=str)
    take(lake, "r4", [], "incremental", deleted_keys=lake.spark.createDataFrame([(2,)], "id bigint"))
    assert (2, "y", "r3", "r4") in held(lake)


def test_snapshots_in_any_order_equal_a_rebuild(lake):
    draw = random.Random(4)
    slices = {f"r{n}": [(k, draw.choice("ab")) for k in draw.sample(range(8), draw.randrange(0, 7))] for n in (1, 3, 2, 5, 4)}
    slices["r5"] = []                                           # an empty snapshot, then a late one before it
    done = {}
    for run, rows in slices.items():
        take(lake, run, rows)
        done[run] = rows
        assert held(lake) == rebuilt(lake, done), run
    take(lake, "r3", slices["r1"])                              # a run repeated with other rows
    assert held(lake) == rebuilt(lake, done | {"r3": slices["r1"]})


def test_versions_are_cut_without_windows(spark, lake, capsys):
    """neither the join of a run in order nor the cut of a late one sorts the keys' rows for windows."""
    seen = spark.createDataFrame([(1, "a", None, False, "r1"), (1, "a", None, False, "r2"), (None, "a", None, False, "r2"),
                                  (1, None, None, True, "r3"), (1, "a", 1.0, False, "r4")],
                                 StructType([*ROW.fields, StructField("is_deleted", BooleanType()), StructField("run_ts", StringType())]))
    out = intervals(seen, ["id"], ["v", "w"])
    assert sorted((tuple(r) for r in out.collect()), key=str) == [
        (1, "a", 1.0, "r4", None, False, ["r4"]), (1, "a", None, "r1", "r3", False, ["r1", "r2"]),
        (1, None, None, "r3", "r4", True, ["r3"]), (None, "a", None, "r2", None, False, ["r2"])]
    out.explain()
    assert "Window" not in capsys.readouterr().out


@pytest.mark.parametrize("again", [False, True])
def test_runs_in_order_and_retried_equal_a_rebuild(lake, again):
    """NULL keys, NULL values, deletions, rebirths; every run in order, and each one taken in twice."""
    slices = {"r1": [(1, "a"), (None, "n"), (2, None)], "r2": [(1, "a"), (2, "b"), (3, "c")], "r3": [(2, "b"), (None, "n")],
              "r4": [(1, "a"), (2, None), (3, "c"), (None, "n")]}
    for run, rows in slices.items():
        take(lake, run, rows)
        if again:
            take(lake, run, rows)
    assert held(lake) == rebuilt(lake, slices)
