"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Query timings run each driver query to completion into Spark's ``noop`` sink (no collect).
The ``scoped_*`` / ``full_recompute`` entries measure the claim of the design on a real
lake: after a batch touching 1 %, 10 % or 100 % of the groups, the scoped run (upsert +
recompute of the affected groups) costs in proportion to what changed, while a full
recompute reads and rewrites everything. The lake setup (first load) is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from latecomer.dataset import Lake  # noqa: E402
from latecomer.operators.aggregates import grouped_sum  # noqa: E402
from latecomer.operators.recompute import recompute  # noqa: E402
from latecomer.plans import orders_facts as of  # noqa: E402
from latecomer.plans.grain_scenarios import item_facts, mean_per_parent, parent_datasets  # noqa: E402
from latecomer.plans.registry import all_queries  # noqa: E402
from latecomer.session import build_session, scratch_root, stage  # noqa: E402
from latecomer.sinks.tables import upsert, write  # noqa: E402
from latecomer.sources.tables import read  # noqa: E402

HEADLINE = [
    "q10_recompute_groups", "q06_merge_incremental", "q08_affected_partitions",
    "q05_dedup_create", "q13_quarter_rollup", "q14_geojson_flatten", "q16_nearest_place",
    "q12_map_changed", "q11_null_groups", "q18_top_countries",
]


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    t = time.perf_counter()
    fn()
    return round(time.perf_counter() - t, 3)


def scoped_vs_full(spark, sf_dir: str, out: dict) -> None:
    facts = of.cost_facts(of.table(spark, sf_dir, "orders"))
    lake = Lake(spark, scratch_root(spark, "bench"))
    first = lake.at("r0")
    upsert(first, of.SILVER, facts, "incremental")
    recompute(first, of.SILVER, of.GOLD, of.GROUPS, lambda f: grouped_sum(f, of.GROUPS, "amount"))
    periods = [r.cost_period for r in facts.select("cost_period").distinct().orderBy("cost_period").collect()]
    for i, (label, share) in enumerate((("1pct", 0.01), ("10pct", 0.10), ("100pct", 1.0))):
        chosen = periods[: max(1, int(round(len(periods) * share)))]
        # a correction of every row in the chosen months (+1 on the amount)
        batch = (read(lake, of.SILVER).where(F.col("cost_period").isin(chosen))
                 .withColumn("amount", (F.col("amount") + F.lit(1)).cast(of.AMOUNT)))
        run = lake.at(f"r{i + 1}")
        out[f"merge_{label}"] = timed(lambda: upsert(run, of.SILVER, batch, "incremental"))
        out[f"scoped_recompute_{label}"] = timed(
            lambda: recompute(run, of.SILVER, of.GOLD, of.GROUPS, lambda f: grouped_sum(f, of.GROUPS, "amount")))
    full = of.Dataset("gold", "costs", "full_recompute", of.GOLD.schema, partition_by=of.GOLD.partition_by)
    out["full_recompute"] = timed(lambda: write(lake, full, grouped_sum(read(lake, of.SILVER), of.GROUPS, "amount")))


def parents_scoped_vs_full(spark, sf_dir: str, out: dict, copies: int) -> None:
    """Mean per parent order on a bucketed table of ``copies`` times the line items: a batch of 1 % of the parents, the scoped
    recompute of exactly those, and a full recompute (only with $BENCH_PARENTS, the number of copies)."""
    facts = item_facts(of.table(spark, sf_dir, "lineitem")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    facts = facts.withColumn("l_orderkey", F.col("l_orderkey") + F.col("copy").cast("long") * F.lit(10 ** 9).cast("long")).drop("copy")
    lake = Lake(spark, scratch_root(spark, "bench-parents"))
    items, means = parent_datasets(buckets=64)
    upsert(lake.at("r0"), items, facts)
    recompute(lake.at("r0"), items, means, ("l_orderkey",), mean_per_parent("r0"))
    batch, _ = stage(read(lake, items).where("l_orderkey % 100 = 7 AND l_linenumber = 1")
                     .withColumn("price", (F.col("price") + 1).cast("decimal(18,2)")))
    run = lake.at("r1")
    out["parents_merge_1pct"] = timed(lambda: upsert(run, items, batch))
    out["parents_scoped_1pct"] = timed(lambda: recompute(run, items, means, ("l_orderkey",), mean_per_parent("r1")))
    few, _ = stage(batch.where("l_orderkey % 20000 = 7"))
    run = lake.at("r2")
    out["parents_merge_few"] = timed(lambda: upsert(run, items, few))
    out["parents_scoped_few"] = timed(lambda: recompute(run, items, means, ("l_orderkey",), mean_per_parent("r2")))
    whole = parent_datasets(buckets=64)[1]
    whole = of.Dataset("gold", "items", "full_means", whole.schema, (), whole.partition_by, whole.group_by, whole.buckets)
    out["parents_full"] = timed(lambda: write(lake, whole, mean_per_parent("r0")(read(lake, items))))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", "latecomer-bench", shuffle_partitions=max(8, 2 * cpus),
                          extra={"spark.driver.memory": "8g"})
    qs = all_queries()
    times: dict[str, float] = {}
    run_noop(qs["q10_recompute_groups"](spark, sf_dir))          # warm-up (JIT, file listing)
    for name in HEADLINE:
        times[name] = timed(lambda: run_noop(qs[name](spark, sf_dir)))
    scoped_vs_full(spark, sf_dir, times)
    if os.environ.get("BENCH_PARENTS"):
        parents_scoped_vs_full(spark, sf_dir, times, int(os.environ["BENCH_PARENTS"]))
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
