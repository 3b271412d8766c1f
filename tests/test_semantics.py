"""The semantic decisions: NULL groups, retries, emptied groups, NULL keys, guards,
untouched files, bronze idempotence."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from latecomer.dataset import Dataset, Lake, Run, bronze_schema
from latecomer.operators.aggregates import grouped_sum
from latecomer.operators.changes import dedup_latest
from latecomer.operators.groups import group_predicate, rows_in_groups
from latecomer.operators.quality import quality_checks
from latecomer.operators.recompute import recompute
from latecomer.operators.rows import map_changed
from latecomer.session import local_path
from latecomer.sinks.maintenance import expire_markers
from latecomer.sinks.tables import replace_groups, upsert, write_bronze
from latecomer.sources.tables import affected, read, read_new, table_exists

SCHEMA = StructType([
    StructField("cost_id", StringType()), StructField("cost_period", StringType()),
    StructField("cost_center", StringType()), StructField("amount", DoubleType()),
])
G = ("cost_period", "cost_center")
SILVER = Dataset("silver", "costs", "fact", SCHEMA, key=("cost_id",), partition_by=G)
GOLD = Dataset("gold", "costs", "by_group", StructType([SCHEMA[c] for c in (*G, "amount")]), partition_by=G)
GOLD_P = Dataset("gold", "costs", "by_period", StructType([SCHEMA["cost_period"], SCHEMA["amount"]]),
                 partition_by=("cost_period",))
ROWS = Dataset("gold", "costs", "rows", SCHEMA, key=("cost_id",), partition_by=G)


def lk(spark, root, run):
    return Lake(spark, root, Run(run))


def df(spark, recs, schema=SCHEMA):
    return spark.createDataFrame(recs, schema)


def agg(lake):
    return recompute(lake, SILVER, GOLD, G, lambda f: grouped_sum(f, G, "amount"))


def gold(lake, ds=GOLD):
    return {tuple(r)[:-1]: r[-1] for r in read(lake, ds).collect()}


def test_null_group_recomputed_and_emptied(spark, lake_root):
    r1 = lk(spark, lake_root, "r1")
    upsert(r1, SILVER, df(spark, [("A", "05", None, 10.0), ("B", "05", None, 5.0), ("C", "05", "X", 1.0)]))
    agg(r1)
    assert gold(r1) == {("05", None): 15.0, ("05", "X"): 1.0}
    r2 = lk(spark, lake_root, "r2")
    upsert(r2, SILVER, df(spark, [("A", "05", None, 20.0)]))
    agg(r2)
    assert gold(r2) == {("05", None): 25.0, ("05", "X"): 1.0}
    # both NULL-group rows move away: the NULL partition empties and disappears
    r3 = lk(spark, lake_root, "r3")
    upsert(r3, SILVER, df(spark, [("A", "06", "Y", 20.0), ("B", "06", "Y", 5.0)]))
    agg(r3)
    assert gold(r3) == {("05", "X"): 1.0, ("06", "Y"): 25.0}
    names = os.listdir(os.path.join(local_path(r3.path(SILVER)), "cost_period=05"))
    assert not any("__HIVE_DEFAULT_PARTITION__" in n for n in names)


def test_rows_in_groups_null_safe(spark):
    rows = df(spark, [("A", "05", None, 1.0), ("B", "05", "X", 2.0), ("C", None, None, 3.0), ("D", "06", None, 4.0)])
    groups = spark.createDataFrame([("05", None), (None, None)], "cost_period string, cost_center string")
    assert sorted(r.cost_id for r in rows_in_groups(rows, groups, G).collect()) == ["A", "C"]


def test_retry_keeps_moved_partition(spark, lake_root):
    """Quirk X6: the first attempt of r2 moves A; the retry still marks the old group."""
    r1 = lk(spark, lake_root, "r1")
    upsert(r1, SILVER, df(spark, [("A", "05", "X", 100.0), ("C", "04", "X", 5.0)]), "snapshot")
    agg(r1)
    batch = [("A", "04", "X", 100.0), ("C", "04", "X", 5.0)]
    r2 = lk(spark, lake_root, "r2")
    upsert(r2, SILVER, df(spark, batch), "snapshot")          # attempt 1 crashes before aggregate
    upsert(r2, SILVER, df(spark, batch), "snapshot")          # retry
    assert {tuple(r) for r in affected(r2, SILVER, "partitions").collect()} == {("05", "X"), ("04", "X")}
    agg(r2)
    assert gold(r2) == {("04", "X"): 105.0}


def test_emptied_group_reaches_next_hop(spark, lake_root):
    """Quirk X3: the gold change set carries the requested groups, including emptied ones."""
    r1 = lk(spark, lake_root, "r1")
    upsert(r1, SILVER, df(spark, [("A", "05", "X", 1.0), ("B", "06", "X", 2.0)]))
    agg(r1)
    r2 = lk(spark, lake_root, "r2")
    upsert(r2, SILVER, df(spark, [("A", "06", "X", 1.0)]))
    agg(r2)
    assert {tuple(r) for r in affected(r2, GOLD, "partitions").collect()} == {("05", "X"), ("06", "X")}
    assert gold(r2) == {("06", "X"): 3.0}
    # hop 2 at a coarser grain picks the emptied month up
    recompute(r2, GOLD, GOLD_P, ("cost_period",), lambda f: grouped_sum(f, ("cost_period",), "amount"))
    assert gold(r2, GOLD_P) == {("06",): 3.0}


def test_snapshot_delete_reaches_row_level_target(spark, lake_root):
    """Quirk X2: deleted keys are propagated to row-level targets."""
    r1 = lk(spark, lake_root, "r1")
    upsert(r1, SILVER, df(spark, [("A", "05", "X", 1.0), ("B", "05", "X", 2.0)]), "snapshot")
    map_changed(r1, SILVER, ROWS, lambda rows: rows.withColumn("amount", F.col("amount") * 2))
    r2 = lk(spark, lake_root, "r2")
    upsert(r2, SILVER, df(spark, [("A", "05", "X", 3.0)]), "snapshot")
    map_changed(r2, SILVER, ROWS, lambda rows: rows.withColumn("amount", F.col("amount") * 2))
    assert {(r.cost_id, r.amount) for r in read(r2, ROWS).collect()} == {("A", 6.0)}


def test_dedup_last_by_order_with_full_tie_break(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c"), ("j", None, "z"), ("j", 0, "y")],
                                 "k string, ord int, v string")
    got = {r.k: (r.ord, r.v) for r in dedup_latest(rows, ["k"], ["ord"]).collect()}
    assert got == {"k": (2, "c"), "j": (0, "y")}


def test_null_keys_never_match_and_are_reported(spark, lake_root):
    """Quirk X9 kept: a NULL key is inserted again by every incremental run."""
    r1 = lk(spark, lake_root, "r1")
    upsert(r1, SILVER, df(spark, [(None, "05", "X", 1.0), ("A", "05", "X", 1.0)]))
    upsert(lk(spark, lake_root, "r2"), SILVER, df(spark, [(None, "05", "X", 1.0)]))
    rows = read(r1, SILVER)
    assert rows.where("cost_id is null").count() == 2
    checks = {r.rule: r.failing_rows for r in quality_checks(rows, ["cost_id"], G).collect()}
    assert checks == {"null_key": 2, "duplicate_key": 0, "null_partition": 0}


def test_all_null_sum_is_zero(spark):
    rows = df(spark, [("A", "05", "X", None)])
    assert grouped_sum(rows, G, "amount").collect()[0].amount == 0.0


def test_first_run_empty_batch_creates_table_without_marker(spark, lake_root):
    r1 = lk(spark, lake_root, "r1")
    upsert(r1, SILVER, df(spark, []))
    assert table_exists(r1, SILVER) and read(r1, SILVER).count() == 0
    assert affected(r1, SILVER, "partitions").isEmpty() and affected(r1, SILVER, "keys").isEmpty()
    assert agg(r1) is False


def test_guards(spark, lake_root):
    r1 = lk(spark, lake_root, "r1")
    with pytest.raises(ValueError):
        upsert(r1, Dataset("silver", "x", "nokey", SCHEMA, partition_by=G), df(spark, [("A", "05", "X", 1.0)]))
    empty_groups = spark.createDataFrame([], "cost_period string, cost_center string")
    with pytest.raises(ValueError, match="empty group set"):
        replace_groups(r1, GOLD, df(spark, []).select(*G, "amount"), empty_groups)
    groups = spark.createDataFrame([("05", "X")], "cost_period string, cost_center string")
    outside = spark.createDataFrame([("06", "X", 1.0)], GOLD.schema)
    with pytest.raises(ValueError, match="outside"):
        replace_groups(r1, GOLD, outside, groups)
    upsert(r1, SILVER, df(spark, [("A", "05", "X", 1.0)]))
    with pytest.raises(ValueError, match="partition grain"):
        recompute(r1, SILVER, GOLD_P, ("quarter",), lambda f: f)


def test_group_predicate_literals(spark):
    rows = df(spark, [("A", "05", "X", 1.0), ("B", "06", "Y", 1.0), ("C", "05", None, 1.0), ("D", "05", "Y", 1.0)])
    pred = group_predicate([("05", "X"), ("06", "Y"), ("05", None)], G)
    assert sorted(r.cost_id for r in rows.where(pred).collect()) == ["A", "B", "C"]
    with pytest.raises(ValueError):
        group_predicate([], G)


def test_untouched_partition_files_keep_name_and_time(spark, lake_root):
    r1 = lk(spark, lake_root, "r1")
    upsert(r1, SILVER, df(spark, [("A", "05", "X", 1.0), ("B", "06", "X", 2.0)]))
    d06 = os.path.join(local_path(r1.path(SILVER)), "cost_period=06", "cost_center=X")
    before = {n: os.stat(os.path.join(d06, n)).st_mtime_ns for n in os.listdir(d06)}
    upsert(lk(spark, lake_root, "r2"), SILVER, df(spark, [("A", "05", "X", 7.0)]))
    after = {n: os.stat(os.path.join(d06, n)).st_mtime_ns for n in os.listdir(d06)}
    assert before == after


def test_bronze_retry_is_idempotent(spark, lake_root):
    bronze = Dataset("bronze", "costs", "raw", bronze_schema(SCHEMA), partition_by=("run_ts",))
    rows = df(spark, [("A", "05", "X", 1.0), ("B", "05", "X", 2.0)])
    r1 = lk(spark, lake_root, "r1")
    write_bronze(r1, bronze, rows)
    r2 = lk(spark, lake_root, "r2")
    write_bronze(r2, bronze, rows)
    write_bronze(r2, bronze, rows)            # retry of r2
    assert read(r1, bronze).count() == 4 and read_new(r2, bronze).count() == 2
    write_bronze(r2, bronze, df(spark, []))   # an empty retry leaves no stale slice
    assert read_new(r2, bronze).count() == 0 and read_new(r1, bronze).count() == 2


def test_expire_markers(spark, lake_root):
    for run in ("r1", "r2", "r3"):
        upsert(lk(spark, lake_root, run), SILVER, df(spark, [(run, "05", "X", 1.0)]))
    r3 = lk(spark, lake_root, "r3")
    removed = expire_markers(r3, SILVER, "r3")
    assert {x.split("/")[1] for x in removed} == {"r1", "r2"}
    assert affected(r3, SILVER, "keys", "r1").isEmpty()
    assert [r.cost_id for r in affected(r3, SILVER, "keys").collect()] == ["r3"]


def test_null_key_rows_bypass_anti_join(spark):
    from latecomer.operators.changes import anti_by_key
    rows = df(spark, [(None, "05", "X", 1.0), ("A", "05", "X", 1.0), ("B", "05", "X", 1.0), (None, "06", "X", 2.0)])
    other = df(spark, [("A", "05", "X", 9.0), (None, "05", "X", 9.0)])
    got = sorted((r.cost_id or "-", r.cost_period) for r in anti_by_key(rows, other, ["cost_id"]).collect())
    assert got == [("-", "05"), ("-", "06"), ("B", "05")]


def test_exists_errors_propagate(spark, lake_root):
    """Quirk X5: only "not found" means missing; an unreachable store raises."""
    bad = Lake(spark, "nosuchscheme://bucket/lake", Run("r1"))
    with pytest.raises(Exception):
        table_exists(bad, SILVER)
    assert table_exists(lk(spark, lake_root, "r1"), SILVER) is False


def test_group_predicate_typed_literals(spark):
    import datetime as dt
    rows = spark.createDataFrame([(1, True, dt.date(2026, 5, 1)), (2, False, dt.date(2026, 5, 1)), (3, True, None)],
                                 "n int, b boolean, d date")
    pred = group_predicate([(1, True, dt.date(2026, 5, 1)), (3, True, None)], ["n", "b", "d"])
    assert sorted(r.n for r in rows.where(pred).collect()) == [1, 3]


def test_feed_without_features_and_bad_json(spark, lake_root):
    from latecomer.sources.geojson import features_to_rows, normalize_features
    docs = spark.createDataFrame([('{"type":"FeatureCollection"}',), ('{"type":"FeatureCollection","features":null}',),
                                  ('{"features":[{"id":"a","properties":{"mag":1.5}}]}',)], "value string")
    rows = features_to_rows(docs)
    assert [r.id for r in rows.collect()] == ["a"]
    flat = normalize_features(rows).collect()
    assert flat[0].mag == 1.5 and flat[0].longitude is None
    broken = spark.createDataFrame([("a", '{"id": "a", "properties": {"mag": ')], "id string, raw string")
    with pytest.raises(Exception):
        normalize_features(broken).collect()


def test_snapshot_only_changed_marks_and_rewrites_changed_partitions(spark, lake_root):
    """Quirk X7 option: a snapshot marks only partitions where a row was inserted,
    updated, moved or deleted; the others keep their files."""
    r1 = lk(spark, lake_root, "r1")
    base = [("A", "05", "X", 1.0), ("B", "05", "Y", 2.0), ("C", "06", "X", 3.0), ("D", "07", "X", 4.0)]
    upsert(r1, SILVER, df(spark, base), "snapshot")
    d06 = os.path.join(local_path(r1.path(SILVER)), "cost_period=06", "cost_center=X")
    before = {n: os.stat(os.path.join(d06, n)).st_mtime_ns for n in os.listdir(d06)}
    r2 = lk(spark, lake_root, "r2")
    snap = [("A", "05", "X", 1.5), ("B", "05", "Y", 2.0), ("C", "06", "X", 3.0), ("E", "08", "X", 5.0)]
    upsert(r2, SILVER, df(spark, snap), "snapshot", only_changed=True)
    assert {tuple(r) for r in affected(r2, SILVER, "partitions").collect()} == {("05", "X"), ("07", "X"), ("08", "X")}
    assert sorted(tuple(r) for r in read(r2, SILVER).collect()) == sorted(snap)
    after = {n: os.stat(os.path.join(d06, n)).st_mtime_ns for n in os.listdir(d06)}
    assert before == after


def test_unpartitioned_upsert_and_replace(spark, lake_root):
    flat = Dataset("silver", "costs", "flat", SCHEMA, key=("cost_id",))
    r1 = lk(spark, lake_root, "r1")
    upsert(r1, flat, df(spark, [("A", "05", "X", 1.0), ("B", "05", "X", 2.0)]))
    upsert(lk(spark, lake_root, "r2"), flat, df(spark, [("A", "05", "X", 5.0), ("C", "06", "X", 1.0)]))
    assert sorted((r.cost_id, r.amount) for r in read(r1, flat).collect()) == [("A", 5.0), ("B", 2.0), ("C", 1.0)]
    tot = Dataset("gold", "costs", "flat_totals", StructType([SCHEMA["cost_period"], SCHEMA["amount"]]))
    g = spark.createDataFrame([("05",), ("06",)], "cost_period string")
    replace_groups(r1, tot, spark.createDataFrame([("05", 7.0), ("06", 1.0)], tot.schema), g, ["cost_period"])
    replace_groups(r1, tot, spark.createDataFrame([("06", 2.0)], tot.schema), g.where("cost_period = '06'"),
                   ["cost_period"])
    assert sorted(tuple(r) for r in read(r1, tot).collect()) == [("05", 7.0), ("06", 2.0)]


def test_backfill_full_ranged_and_named(spark, lake_root):
    from latecomer.operators.recompute import backfill
    r1 = lk(spark, lake_root, "r1")
    upsert(r1, SILVER, df(spark, [("A", "05", "X", 1.0), ("B", "06", "X", 2.0), ("C", "07", None, 3.0)]))
    summed = lambda f: grouped_sum(f, G, "amount")
    assert backfill(r1, SILVER, GOLD, G, summed)
    assert gold(r1) == {("05", "X"): 1.0, ("06", "X"): 2.0, ("07", None): 3.0}
    upsert(lk(spark, lake_root, "r2"), SILVER, df(spark, [("A", "05", "X", 10.0), ("B", "06", "X", 20.0),
                                                         ("C", "07", None, 30.0)]))
    assert backfill(r1, SILVER, GOLD, G, summed, lower="06", upper="06", on="cost_period")
    assert gold(r1) == {("05", "X"): 1.0, ("06", "X"): 20.0, ("07", None): 3.0}
    assert backfill(r1, SILVER, GOLD, G, summed, named_groups=[("07", None)])
    assert gold(r1) == {("05", "X"): 1.0, ("06", "X"): 20.0, ("07", None): 30.0}
    assert not backfill(r1, SILVER, GOLD, G, summed, lower="09", on="cost_period")
    # a group that left the source leaves the target too
    upsert(lk(spark, lake_root, "r3"), SILVER, df(spark, [("A", "05", "X", 10.0)]), "snapshot")
    assert backfill(r1, SILVER, GOLD, G, summed, lower="06", upper="06", on="cost_period")
    assert gold(r1) == {("05", "X"): 1.0, ("07", None): 30.0}


def test_whole_file_feed_documents(spark, lake_root):
    from latecomer.sources.geojson import features_to_rows, read_feed
    d = os.path.join(lake_root, "feed", "event_date=2014-01-01")
    os.makedirs(d)
    with open(os.path.join(d, "day.json"), "w") as fh:      # one pretty-printed document per file
        fh.write('{\n  "type": "FeatureCollection",\n  "features": [\n    {"id": "a"},\n    {"id": "b"}\n  ]\n}\n')
    docs = read_feed(spark, os.path.join(lake_root, "feed"), "2014-01-01", "2014-01-02", whole_files=True)
    assert sorted(r.id for r in features_to_rows(docs).collect()) == ["a", "b"]


def test_json_records_multiline_and_missing_source(spark, lake_root):
    from latecomer.sources.records import read_records
    path = os.path.join(lake_root, "records")
    os.makedirs(path)
    with open(os.path.join(path, "batch.json"), "w") as fh:
        fh.write('[\n  {"cost_id": "A", "cost_period": "05", "cost_center": "X", "amount": 1.5},\n'
                 '  {"cost_id": "B", "cost_period": "05", "cost_center": "Y", "amount": 2}\n]\n')
    got = read_records(spark, path, SCHEMA, multi_line=True).collect()
    assert sorted((r.cost_id, r.amount) for r in got) == [("A", 1.5), ("B", 2.0)]
    none = read_records(spark, os.path.join(lake_root, "absent"), SCHEMA)
    assert none.count() == 0 and none.schema == SCHEMA


def test_scale_conf_sizes_partitions():
    from latecomer.session import scale_conf
    big = scale_conf(100 * 1024 ** 4, total_cores=4000, executor_memory_gb=16, cores_per_executor=4)
    assert big["spark.sql.files.maxPartitionBytes"] == "256m"
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 1024 ** 4 // (256 * 1024 ** 2)
    small = scale_conf(10 * 1024 ** 2, total_cores=8, executor_memory_gb=2, cores_per_executor=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert small["spark.sql.files.maxPartitionBytes"] == "64m"


def test_special_characters_in_partition_values(spark, lake_root):
    """Escaped folder names survive rewrite, removal of emptied folders and named-folder
    (globbed) reads."""
    odd = "a/b:c*d{e},f g"
    r1 = lk(spark, lake_root, "r1")
    upsert(r1, SILVER, df(spark, [("A", odd, "X", 1.0), ("B", odd, "Y", 2.0), ("C", "06", odd, 3.0)]))
    agg(r1)
    assert gold(r1) == {(odd, "X"): 1.0, (odd, "Y"): 2.0, ("06", odd): 3.0}
    r2 = lk(spark, lake_root, "r2")
    upsert(r2, SILVER, df(spark, [("A", "06", odd, 5.0), ("B", "06", odd, 5.0)]))   # odd month empties
    agg(r2)
    assert gold(r2) == {("06", odd): 13.0}
    assert {(r.cost_period, r.cost_center) for r in read(r2, SILVER).collect()} == {("06", odd)}
    recompute(r2, GOLD, GOLD_P, ("cost_period",), lambda f: grouped_sum(f, ("cost_period",), "amount"))
    assert gold(r2, GOLD_P) == {("06",): 13.0}


def test_compaction_merges_files_per_partition(spark, lake_root):
    from latecomer.sinks.maintenance import compact
    from latecomer.sinks.tables import write
    r1 = lk(spark, lake_root, "r1")
    rows = [(f"k{i}", "05", "X", float(i)) for i in range(30)] + [(f"j{i}", "06", "Y", 1.0) for i in range(9)]
    for part in range(3):
        write(r1, SILVER, df(spark, rows[part::3]), "overwrite" if part == 0 else "append")
    folder = os.path.join(local_path(r1.path(SILVER)), "cost_period=05", "cost_center=X")

    def parquet_files():
        return [n for n in os.listdir(folder) if n.endswith(".parquet")]
    assert len(parquet_files()) == 3
    compact(r1, SILVER, spark.createDataFrame([("05", "X")], "cost_period string, cost_center string"))
    assert len(parquet_files()) == 1
    assert sorted(tuple(r) for r in read(r1, SILVER).collect()) == sorted(rows)


def test_cast_to_schema_raises_on_bad_value(spark):
    """A value that does not convert is an error (ANSI), not a silent NULL."""
    from latecomer.sources.records import cast_to
    raw = spark.createDataFrame([("A", "05", "X", "12.5"), ("B", "05", "X", "not a number")],
                                "cost_id string, cost_period string, cost_center string, amount string")
    with pytest.raises(Exception):
        cast_to(raw, SCHEMA).collect()
    ok = cast_to(raw.where("cost_id = 'A'"), SCHEMA).collect()
    assert ok[0].amount == 12.5
