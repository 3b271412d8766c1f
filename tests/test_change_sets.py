"""Change sets at size: what an upsert reads, joins and writes to record what it changes."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from latecomer.dataset import Dataset, Lake, bucketed
from latecomer.sinks import index
from latecomer.sinks.tables import _folders_affected, record_affected, upsert
from latecomer.sources.tables import affected, empty, read, read_keys

FACT = StructType([StructField("id", LongType()), StructField("period", StringType()), StructField("v", DoubleType())])
FACTS = Dataset("silver", "c", "fact", FACT, ("id",), ("period",))
ITEMS = bucketed("silver", "c", "item", FACT, ("id",), ("period",), buckets=4, index_buckets=4)


@pytest.fixture()
def lake(spark, lake_root):
    return Lake(spark, lake_root)


def frame(lake, rows):
    return lake.spark.createDataFrame(rows, FACT)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def stages(spark):
    sc, found = spark.sparkContext, []
    sc.setJobGroup("stages", "stages")
    yield found
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    found.extend(s for j in tracker.getJobIdsForGroup("stages") for s in tracker.getJobInfo(j).stageIds)


@pytest.mark.parametrize("ds", [FACTS, ITEMS])
def test_deleted_keys_are_computed_once(lake, ds):
    rows = [(k, f"p{k % 3}", 1.0) for k in range(30)]
    upsert(lake.at("r1"), ds, frame(lake, rows))
    read_rows = lake.spark.sparkContext.accumulator(0)

    @F.udf(BooleanType())
    def counted(_):
        read_rows.add(1)
        return True

    gone = frame(lake, rows[:4] + rows[:1] + [(99, "p0", 1.0), (None, "p0", 1.0)]).where(counted("v"))
    upsert(lake.at("r2"), ds, frame(lake, [(5, "p1", 2.0)]), delete_keys=gone)
    assert read_rows.value == 7
    assert {r.id for r in read(lake, ds).collect()} == set(range(4, 30))
    assert {r.id for r in affected(lake.at("r2"), ds, "deleted_keys").collect()} == {0, 1, 2, 3}


def test_a_batch_in_every_partition_needs_no_join(lake):
    target = frame(lake, [(k, f"p{k % 3}", 1.0) for k in range(30)] + [(40, None, 1.0)])
    parts, _ = _folders_affected(target, frame(lake, [(1, "p0", 2.0), (50, "p1", 2.0), (2, "p2", 2.0), (51, None, 1.0)]), ["id"], ["period"])
    assert "Join" not in plan(parts)
    assert sorted(parts.collect(), key=str) == sorted([("p0",), ("p1",), ("p2",), (None,)], key=str)


def test_partitions_that_rows_leave_are_affected(lake):
    target = frame(lake, [(1, "p0", 1.0), (2, "p1", 1.0), (3, "p2", 1.0), (4, None, 1.0), (None, "p3", 1.0)])
    parts, _ = _folders_affected(target, frame(lake, [(1, "p9", 2.0), (4, "p9", 2.0), (None, "p9", 1.0)]), ["id"], ["period"])
    assert sorted(parts.collect(), key=str) == sorted([("p0",), ("p9",), (None,)], key=str)


def test_unique_keys_are_recorded_without_a_shuffle(lake):
    keys = lake.spark.range(0, 100, 1, 4).select("id")
    with stages(lake.spark) as found:
        record_affected(lake.at("r1"), FACTS, keys=keys, unique_keys=True)
    assert len(found) == 2                                  # the keys and the commit
    # another run starts afresh, a retry keeps what the first attempt recorded
    record_affected(lake.at("r2"), FACTS, keys=keys.where("id < 5"), unique_keys=True)
    record_affected(lake.at("r2"), FACTS, keys=keys.where("id BETWEEN 3 AND 7"), unique_keys=True)
    assert sorted(r.id for r in affected(lake.at("r2"), FACTS, "keys").collect()) == list(range(8))
    assert affected(lake.at("r1"), FACTS, "keys").count() == 100


def test_a_batch_with_repeated_and_null_keys_records_each_key_once(lake):
    rows = [(1, "p0", 1.0), (1, "p1", 2.0), (None, "p0", 1.0), (None, "p1", 3.0), (2, "p0", 1.0)]
    for run in ("r1", "r2", "r2"):
        upsert(lake.at(run), FACTS, frame(lake, rows))
        assert sorted(affected(lake.at(run), FACTS, "keys").collect(), key=str) == sorted([(1,), (2,), (None,)], key=str)


def test_index_of_a_new_table_needs_no_distinct(lake):
    upsert(lake.at("r1"), ITEMS, frame(lake, [(k % 20, f"p{k % 3}", 1.0) for k in range(60)] + [(None, "p0", 1.0)]))
    assert "Exchange" not in plan(index._rows(ITEMS, read(lake, ITEMS), True))
    assert sorted(r.id for r in read(lake, index.index_of(ITEMS)).collect()) == list(range(20))


def test_rows_of_keys_that_come_twice_are_read_once(lake):
    upsert(lake.at("r1"), FACTS, frame(lake, [(k, f"p{k % 3}", 1.0) for k in range(30)]))
    asked = read_keys(lake, FACTS, frame(lake, [(1, "", 0.0), (1, "", 0.0), (None, "", 0.0), (77, "", 0.0)]))
    assert [r.id for r in asked.collect()] == [1]
    assert plan(asked).count("HashAggregate") == 0


def test_an_empty_frame_needs_no_python(lake):
    made = empty(lake, FACT)
    assert made.schema == FACT and made.count() == 0 and "ExistingRDD" not in plan(made)
