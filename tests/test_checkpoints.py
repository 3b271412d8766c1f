"""As-of states from checkpoints."""

import random
import re

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from latecomer.dataset import Dataset, Lake, bronze_schema
from latecomer.operators.changes import SNAPSHOT
from latecomer.sinks.checkpoints import checkpoint, checkpoints, state_as_of
from latecomer.sinks.tables import write_bronze

ROW = StructType([StructField("id", LongType()), StructField("v", StringType())])
BRONZE = Dataset("bronze", "c", "raw", bronze_schema(ROW), ("id",), ("run_ts",))


@pytest.fixture()
def lake(spark, lake_root):
    return Lake(spark, lake_root)


def land(lake, run, rows):
    write_bronze(lake.at(run), BRONZE, lake.spark.createDataFrame(rows, ROW))


def state(lake, run, **options):
    return {r.id: (r.v, r.run_ts) for r in state_as_of(lake, BRONZE, ("id",), run, **options).collect()}


def test_states_equal_a_replay_and_read_later_slices_only(lake):
    rng = random.Random(2)
    now, want = {}, {}
    for k in range(1, 7):
        run = f"r{k}"
        rows = [(rng.choice([None, *range(30)]), f"{run}-{i}") for i in range(8)]
        land(lake, run, rows)
        for i in {i for i, _ in rows}:
            now[i] = (max(v for j, v in rows if j == i), run)                  # ties within a run go by the value
        want[run] = dict(now)
        if k in (2, 4):
            checkpoint(lake, BRONZE, ("id",), run)
    assert sorted(checkpoints(lake, BRONZE)) == ["r2", "r4"]
    for run, rows in want.items():
        assert state(lake, run) == rows
    assert state(lake, "r0") == {}
    later = state_as_of(lake, BRONZE, ("id",), "r5")
    plan = later._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*run_ts#\d+ > r4", plan)      # only r5 of the slices
    assert any("_checkpoints" in p for p in later.inputFiles())
    at_checkpoint = state_as_of(lake, BRONZE, ("id",), "r4").inputFiles()
    assert at_checkpoint and all("_checkpoints" in p for p in at_checkpoint)


def test_a_retried_run_removes_later_checkpoints(lake):
    land(lake, "r1", [(1, "a"), (2, "b")])
    checkpoint(lake, BRONZE, ("id",), "r1")
    land(lake, "r3", [(2, "c")])
    checkpoint(lake, BRONZE, ("id",), "r3")
    land(lake, "r2", [(1, "late"), (2, "late")])                               # arrives after r3
    assert sorted(checkpoints(lake, BRONZE)) == ["r1"]
    assert state(lake, "r3") == {1: ("late", "r2"), 2: ("c", "r3")}
    checkpoint(lake, BRONZE, ("id",), "r3")
    checkpoint(lake, BRONZE, ("id",), "r3")
    assert state(lake, "r3") == {1: ("late", "r2"), 2: ("c", "r3")} and sorted(checkpoints(lake, BRONZE)) == ["r1", "r3"]


def test_snapshots(lake):
    land(lake, "r1", [(1, "a"), (2, "b")])
    land(lake, "r3", [(1, "c")])
    runs = lake.spark.createDataFrame([("r1",), ("r2",), ("r3",)], "run_ts string")
    assert state(lake, "r2", mode=SNAPSHOT) == {1: ("a", "r1"), 2: ("b", "r1")}
    assert state(lake, "r2", mode=SNAPSHOT, runs=runs) == {} and state(lake, "r0", mode=SNAPSHOT, runs=runs) == {}
    assert state(lake, "r3", mode=SNAPSHOT, runs=runs) == {1: ("c", "r3")}
