"""Group-scoped reads and recompute (S3, J2, J5, P6, C4, C6, C9, K6 pure layer).

Group sets are DataFrames: selecting the rows of a set of groups is a semi join, which
Catalyst turns into dynamic partition pruning on a table partitioned by the group
columns. Only where the apply layer names partition folders does a group set (bounded by
the partition count, never rows) reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all_not_null(cols, prefix: str = "") -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{prefix}{c}").isNotNull() for c in cols])


def _any_null(cols, prefix: str = "") -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"{prefix}{c}").isNull() for c in cols])


def _null_safe_on(cols, left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b,
                  [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in cols])


def rows_in_groups(df: DataFrame, groups: DataFrame, cols, has_null: bool | None = None) -> DataFrame:
    """Rows of ``df`` whose ``cols`` tuple is one of ``groups`` (NULL matches NULL).

    Two disjoint branches (quirk X1 fixed, rule R1):
    * groups without NULLs, by plain equality -- this is what lets Spark prune partitions
      dynamically from the (small) group set;
    * groups holding a NULL, by ``<=>``, on rows pre-filtered to ``c IS NULL`` -- a static
      filter that also prunes the ``__HIVE_DEFAULT_PARTITION__`` folders only.
    ``has_null=False`` (the caller knows the set has no NULL) drops the second branch.
    """
    cols = list(cols)
    g = groups.select(*cols).distinct()
    plain = df.join(g.where(_all_not_null(cols)), cols, "left_semi")
    if has_null is False:
        return plain
    with_null = g.where(_any_null(cols)).alias("g")
    nullish = (df.where(_any_null(cols)).alias("t")
               .join(with_null, _null_safe_on(cols, "t", "g"), "left_semi")
               .select(*[F.col(f"t.{c}").alias(c) for c in df.columns]))
    return plain.unionByName(nullish)


def rows_outside_groups(df: DataFrame, groups: DataFrame, cols) -> DataFrame:
    """Rows of ``df`` whose ``cols`` tuple is NOT one of ``groups`` (null-safe anti join)."""
    cols = list(cols)
    g = groups.select(*cols).distinct().alias("g")
    return (df.alias("t").join(g, _null_safe_on(cols, "t", "g"), "left_anti")
            .select(*[F.col(f"t.{c}").alias(c) for c in df.columns]))


def check_groups(groups: DataFrame, cols, name: str = "groups") -> None:
    """C9 guards that need no data pass: columns present, set not empty."""
    missing = [c for c in cols if c not in groups.columns]
    if missing:
        raise ValueError(f"{name}: group columns {missing} are not in the change grain "
                         f"{groups.columns} (group columns must be a subset of the source partitions)")
    if groups.isEmpty():
        raise ValueError(f"{name}: empty group set; refusing a replace that would match nothing")


def check_within_groups(result: DataFrame, groups: DataFrame, cols, name: str = "result") -> None:
    """J5 guard: the new rows may only belong to the groups being replaced."""
    outside = rows_outside_groups(result.select(*cols), groups, cols)
    if not outside.isEmpty():
        sample = [tuple(r) for r in outside.limit(5).collect()]
        raise ValueError(f"{name}: rows outside the target group set, e.g. {sample}")


def group_predicate(groups, cols) -> Column:
    """A literal OR-of-ANDs Column for a few hand-named groups (e.g. a ranged
    backfill). NULL becomes ``IS NULL``. Change sets of any size use
    :func:`rows_in_groups` instead, which never leaves the cluster."""
    rows = list(dict.fromkeys(tuple(g) for g in groups))
    if not rows:
        raise ValueError("empty group set: refusing to build a predicate")

    def eq(c, v) -> Column:
        return F.col(c).isNull() if v is None else (F.col(c) == F.lit(v))

    ands = [reduce(lambda a, b: a & b, [eq(c, v) for c, v in zip(cols, r)]) for r in rows]
    return reduce(lambda a, b: a | b, ands)


def recompute_groups(source: DataFrame, changed: DataFrame, group_cols, aggregate,
                     has_null: bool | None = None, scoped: bool = False) -> tuple[DataFrame, DataFrame]:
    """C4 / C6 pure layer: groups = distinct projection of the change set onto
    ``group_cols`` (a subset of the source's partition grain); read *all* rows of those
    groups and apply the caller's aggregate. Returns ``(groups, new_rows)``.
    ``scoped=True``: ``source`` already holds exactly the rows of those groups."""
    cols = list(group_cols)
    missing = [c for c in cols if c not in changed.columns]
    if missing:
        raise ValueError(f"group columns {missing} are not in the source's partition grain {changed.columns}")
    groups = changed.select(*cols).distinct()
    facts = source if scoped else rows_in_groups(source, groups, cols, has_null=has_null)
    return groups, aggregate(facts)


def replace_groups_result(target: DataFrame, new_rows: DataFrame, groups: DataFrame, cols) -> DataFrame:
    """K6 pure layer: the table after replacing ``groups`` by ``new_rows``; groups that
    get no new rows disappear."""
    return rows_outside_groups(target, groups, cols).unionByName(new_rows.select(*target.columns))
