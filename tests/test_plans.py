"""Plan properties the design relies on at scale, read from the physical plan."""

from latecomer.dataset import Lake, Run
from latecomer.operators.changes import affected_partitions, dedup_latest
from latecomer.operators.groups import rows_in_groups
from latecomer.plans import orders_facts as of
from latecomer.sinks.tables import upsert
from latecomer.sources.tables import affected, read, read_groups, read_keys

from .conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _lake_with_change(spark, root):
    facts = of.cost_facts(of.table(spark, SF_SMALL, "orders"))
    lake = Lake(spark, root, Run("r1"))
    upsert(lake, of.SILVER, of.initial_load(facts))
    r2 = lake.at("r2")
    upsert(r2, of.SILVER, of.incremental_batch(facts).where("cost_id % 50 = 0"))
    return r2


def test_group_scan_prunes_partitions_dynamically(spark, lake_root):
    r2 = _lake_with_change(spark, lake_root)
    q = rows_in_groups(read(r2, of.SILVER), affected(r2, of.SILVER, "partitions"), of.GROUPS)
    p = plan(q)
    assert "dynamicpruningexpression" in p          # target folders pruned from the change set
    assert "run_ts = r2" in p or "(run_ts#" in p     # marker read pruned to this run


def test_map_step_reads_changed_partitions_only(spark, lake_root):
    r2 = _lake_with_change(spark, lake_root)
    changed = affected(r2, of.SILVER, "partitions")
    p = plan(read_keys(r2, of.SILVER, affected(r2, of.SILVER, "keys"), changed))
    assert "dynamicpruningexpression" in p
    assert read_groups(r2, of.SILVER, changed).count() > 0


def test_pre_image_lookup_reads_key_column_only(spark):
    facts = of.cost_facts(of.table(spark, SF_SMALL, "orders"))
    parts = affected_partitions(of.initial_load(facts), of.incremental_batch(facts), of.KEYS, of.GROUPS)
    p = plan(parts)
    scans = [line for line in p.splitlines() if "FileScan parquet" in line and "o_totalprice" in line]
    assert scans == []                               # keys and partition columns only: no measure read
    assert "HashAggregate" in p                      # distinct is combined map-side


def test_dedup_is_combined_before_the_shuffle(spark):
    li = of.table(spark, SF_SMALL, "lineitem")
    p = plan(dedup_latest(li, ["l_orderkey", "l_linenumber"], ["l_shipdate"]))
    assert "partial_max" in p                        # map-side reduction of hot keys
    assert "Window" not in p                         # no per-key window over unbounded groups
