"""Mergeable states of hot groups (A4) and the restartable backfill."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from latecomer.dataset import Dataset, Lake, bucketed
from latecomer.operators import states as S
from latecomer.operators.ranges import NULL_RANGE, backfill_in_ranges, balanced_ranges, progress
from latecomer.sinks.tables import upsert, write
from latecomer.sources.tables import read

ROW = StructType([StructField("id", LongType()), StructField("g", StringType()), StructField("v", LongType())])
GROUP = StructType([ROW["g"]])
FACTS = bucketed("silver", "s", "fact", StructType([*ROW.fields, StructField("slice", IntegerType())]), ("id",), ("g", "slice"), 4)
STATES = bucketed("gold", "s", "state", StructType([*S.states_schema(GROUP, LongType(), LongType()).fields,
                                                    StructField("run", StringType())]), ("g", "slice"), ("g", "slice"), 4)
GOLD = bucketed("gold", "s", "total", StructType([*GROUP.fields, *S.state_fields(LongType(), LongType())]), ("g",), ("g",), 4)


@pytest.fixture()
def lake(spark, lake_root):
    return Lake(spark, lake_root)


def run_states(lake, run, rows, gone=None):
    df = S.sliced(lake.spark.createDataFrame(rows, ROW), ["id"], 8)
    gone = None if gone is None else S.sliced(lake.spark.createDataFrame(gone, ROW), ["id"], 8)
    upsert(lake.at(run), FACTS, df, delete_keys=gone)
    return S.recompute_states(lake.at(run), FACTS, STATES, GOLD, ("g",), lambda f: S.slice_states(f, ("g",), "v")
                              .withColumn("run", F.lit(run)))


def plain(rows):
    out = {}
    for _, g, v in rows:
        out.setdefault(g, []).append(v)
    known = {g: [v for v in vs if v is not None] for g, vs in out.items()}
    return {g: (len(vs), len(known[g]), sum(known[g]) if known[g] else None, min(known[g], default=None),
                max(known[g], default=None)) for g, vs in out.items()}


def totals(lake):
    return {r.g: (r.n_rows, r.n_values, r.total, r.least, r.greatest) for r in read(lake, GOLD).collect()}


def test_states_follow_inserts_updates_moves_and_deletes(lake):
    rng = random.Random(4)
    groups = ["hot", "a", "b", None, ""]
    now = {i: (i, "hot" if i % 3 == 0 else rng.choice(groups), rng.choice([None, *range(50)])) for i in range(300)}
    now[900] = (900, "nulls", None)
    run_states(lake, "r1", list(now.values()))
    assert totals(lake)["nulls"] == (1, 0, None, None, None)
    for k in range(2, 4):
        batch = {i: (i, rng.choice(groups), rng.randrange(-50, 99)) for i in rng.sample(range(320), 12)}
        gone = [now[i] for i in rng.sample(sorted(set(now) - set(batch)), 5)]
        now = {i: r for i, r in (now | batch).items() if r not in gone}
        assert run_states(lake, f"r{k}", list(batch.values()), gone)
        assert totals(lake) == plain(now.values())


def test_one_late_row_reads_one_slice(lake):
    rows = [(i, "hot", i) for i in range(400)] + [(i, f"g{i}", i) for i in range(400, 420)]
    run_states(lake, "r1", rows)
    run_states(lake, "r2", [(1000, "hot", 5000)])
    again = read(lake, STATES).where("run = 'r2'").collect()
    assert len(again) == 1 and again[0].g == "hot" and again[0].n_rows < 120
    assert totals(lake)["hot"] == (401, 401, sum(range(400)) + 5000, 0, 5000)


def test_distinct_values_are_counted_within_the_stated_error(spark):
    rows = spark.range(60000).select(F.col("id"), F.lit("g").alias("g"), (F.col("id") % 20000).alias("v"))
    parts = S.slice_states(S.sliced(rows, ["id"], 16), ("g",), "v")
    found = S.merged(parts, ("g",)).select(S.n_distinct(), S.mean()).first()
    assert abs(found.n_distinct - 20000) < 4 * 0.016 * 20000 and found.mean == pytest.approx(9999.5)


def test_states_refuse_another_grain(lake):
    with pytest.raises(ValueError, match="changes must be recorded by"):
        S.recompute_states(lake, GOLD, STATES, GOLD, ("g",), lambda f: f)


SALES = Dataset("silver", "b", "sale", ROW, ("id",), ("g",))
SUMS = Dataset("gold", "b", "sum", StructType([ROW["g"], ROW["v"], StructField("attempt", StringType())]), partition_by=("g",))


def test_ranges_hold_like_rows(spark):
    rng = random.Random(9)
    counts = [(f"k{i:04d}", rng.randrange(1, 30)) for i in range(500)] + [("k0100x", 9000), (None, 70)]
    got = balanced_ranges(spark.createDataFrame(counts, "g string, n bigint"), "g", 8).collect()
    values = sorted(c for c in counts if c[0])
    total, before, want = sum(n for _, n in values), 0, {}
    for value, n in values:
        want.setdefault(before * 8 // total, []).append((value, n))
        before += n
    assert {r.range_no: (r.lower, r.upper, r.rows) for r in got if r.range_no != NULL_RANGE} == {
        k: (vs[0][0], vs[-1][0], sum(n for _, n in vs)) for k, vs in want.items()}
    assert [(r.lower, r.upper, r.rows) for r in got if r.range_no == NULL_RANGE] == [(None, None, 70)]
    assert balanced_ranges(spark.createDataFrame([], "g string, n bigint"), "g", 8).count() == 0


def test_a_backfill_goes_on_where_it_failed(lake):
    rows = [(i, None if i % 10 == 0 else f"m{i % 7}", i) for i in range(140)]
    upsert(lake.at("r1"), SALES, lake.spark.createDataFrame(rows, ROW))
    write(lake, SUMS, lake.spark.createDataFrame([("left", 1, "old"), ("m3", -1, "old")], SUMS.schema))
    calls = []

    def sums(attempt, fails_at=None):
        def aggregate(f):
            calls.append(attempt)
            if len(calls) == fails_at:
                raise RuntimeError("lost")
            return f.groupBy("g").agg(F.sum("v").alias("v")).withColumn("attempt", F.lit(attempt))
        return aggregate

    with pytest.raises(ValueError, match="hasn't been started"):
        progress(lake, "full", SALES, SUMS, "g")
    with pytest.raises(RuntimeError):
        backfill_in_ranges(lake.at("r2"), "full", SALES, SUMS, ("g",), sums("one", fails_at=3), "g", 3)
    state = {r.range_no: r.done for r in progress(lake, "full", SALES, SUMS, "g").collect()}
    assert state == {NULL_RANGE: True, 0: True, 1: False, 2: False}
    assert backfill_in_ranges(lake.at("r2"), "full", SALES, SUMS, ("g",), sums("two"), "g", 3, at_most=1) == [1]
    assert backfill_in_ranges(lake.at("r3"), "full", SALES, SUMS, ("g",), sums("three"), "g", 3) == [2]
    assert backfill_in_ranges(lake.at("r3"), "full", SALES, SUMS, ("g",), sums("four"), "g", 3) == []
    assert calls == ["one", "one", "one", "two", "three"]
    got = {r.g: (r.v, r.attempt) for r in read(lake, SUMS).collect()}
    want = {g: sum(v for _, h, v in rows if h == g) for g in {r[1] for r in rows}}
    assert {g: v for g, (v, _) in got.items()} == want                         # "left" is gone
    assert got[None][1] == "one" and {a for _, a in got.values()} == {"one", "two", "three"}
    with pytest.raises(ValueError, match="not a group column"):
        backfill_in_ranges(lake, "other", SALES, SUMS, ("g",), sums("x"), "id")
