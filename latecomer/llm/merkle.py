"""Merkle manifest of a table: a hash tree per group and one over the groups, with a proof for every row.

A leaf is H of a row's fields, each ``-`` if NULL, else its UTF-8 byte count, ``:`` and its value; H is the lowercase hex sha256 of the
concatenated inputs, digests being taken as hex text. Within a group the leaves ascend by id; every ``arity`` consecutive nodes
(the last run may be shorter) become their H until one node, the subroot, is left. The subroots in order of their groups (NULL
first, then by UTF-8 bytes) give the root in the same way.

Method: sibling-shift self-joins. Nodes carry their number in the level. Each level is equijoined with itself on the computed number of
a sibling: number XOR 1 for binary trees, else the number of each other slot of the run. One join gives every node its siblings;
rows in slot zero then emit the parents. On the way back each node takes over its parent's path by one more equijoin,
so a proof costs a row one join a level of the shrinking tree, not one join of all leaves a level.

* **Numbers** come from a range partitioning of (group, id, leaf): row numbers within a partition plus the counts of the partitions
  before it. No task holds more than a partition, whatever share of the rows one group has.
* **Levels** are written to the shared checkpoint folder; a lost executor recomputes at most one level. Their number grows with the
  logarithm of the largest group. The driver sees that group's size and no rows.

Cases: rows of one id are ordered by their leaves, so equal rows are interchangeable; a NULL id comes first; a NULL or empty text, source or
language is its own value (``-`` or ``0:``); a lone leaf is its subroot, a lone subroot the root; an empty table gives an
empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import release, stage
from .common import table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One level of a proof: the digests of the run's slots before and after the node, each concatenated from left to right.
STEP = "struct<before:string,after:string>"
TAMPER_MOD = 7          # fixed value of the query: rows whose id's crc32 it divides are tampered with


def _framed(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    """H of a row's fields in the given order."""
    return F.sha2(F.concat(*[_framed(v) for v in values]), 256)


class _Scratch:
    """Staged tables of one tree; each is removed once nothing reads it any more."""

    def __init__(self):
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def put(self, df: DataFrame) -> DataFrame:
        out, path = stage(df, "merkle")
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        kept = self.paths.pop(id(df), None)
        if kept:
            release(kept[1], df.sparkSession)


def numbered(rows: DataFrame, group: str, order: list[str], scratch: _Scratch) -> DataFrame:
    """``rows`` with ``i`` (number from 0 within the group, by ``order``) and ``m`` (size of the group).

    ``order`` should tell rows apart or leave only rows whose order doesn't matter.
    """
    spread = rows.withColumn("tie", F.monotonically_increasing_id())      # splits a crowd of equal rows, too
    cut = scratch.put(spread.repartitionByRange(group, *order, "tie").withColumn("part", F.spark_partition_id()))
    counts = cut.groupBy(group, "part").agg(F.count("*").alias("here"))   # at most partitions times groups, usually far fewer
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"),
                            F.sum("here").over(Window.partitionBy(group)).alias("m"))
    local = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order, "tie"))
    return (cut.withColumn("local", local).join(offsets, [group, "part"])
            .withColumn("i", F.col("offset") + F.col("local") - 1).drop("local", "offset", "part", "tie"))


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Every node with its ``step``; one equijoin for each offset between slots."""
    slot = F.col("i") % arity
    out = nodes
    for k in range(1, arity):
        number = F.col("i").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("i") - slot + (slot + k) % arity
        shifted = nodes.select("g", F.col("i").alias(f"s{k}"), F.col("h").alias(f"h{k}"))
        out = out.withColumn(f"s{k}", number).join(shifted, ["g", f"s{k}"], "left")
    # the sibling at offset k is before the node if its slot wrapped round: k >= arity - slot
    before = [F.when(slot + k >= arity, F.col(f"h{k}")) for k in range(1, arity)]
    after = [F.when(slot + k < arity, F.col(f"h{k}")) for k in range(1, arity)]
    step = F.struct(F.concat_ws("", *before).alias("before"), F.concat_ws("", *after).alias("after"))
    return out.select(*nodes.columns, step.alias("step"))


def _grow(leaves: DataFrame, arity: int, scratch: _Scratch) -> tuple[list[DataFrame], DataFrame]:
    """(levels, tops): levels from the leaves up, each node with its ``step``; tops (g, h, height) are the nodes left alone."""
    levels, tops = [], leaves.where("m = 1").select("g", "h", F.lit(0).alias("height"))
    size = leaves.agg(F.max("m")).first()[0] or 0
    nodes = leaves
    while size > 1:
        level = scratch.put(_siblings(nodes.where("m > 1"), arity))
        if levels:
            scratch.drop(nodes)
        levels.append(level)
        nodes = scratch.put(level.where(F.col("i") % arity == 0).select(
            "g", (F.col("i") / arity).cast("long").alias("i"), F.ceil(F.col("m") / arity).cast("long").alias("m"),
            F.sha2(F.concat(F.col("h"), "step.after"), 256).alias("h")))
        size = -(-size // arity)
        tops = scratch.put(tops.unionByName(nodes.where("m = 1").select("g", "h", F.lit(len(levels)).alias("height"))))
    return levels, tops


def _descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, arity: int, scratch: _Scratch,
             carried: list[str], own: list[str]) -> DataFrame:
    """The leaves (``own`` columns) with the columns ``carried`` and ``path`` of their tops (g, height, path, ...),
    the path being lengthened by each level's step. A top joins in where its height is reached."""
    def waiting(height: int) -> DataFrame:
        return tops.where(F.col("height") == height).select("g", F.lit(0).cast("long").alias("i"), "path", *carried)

    found = None
    for k in range(len(levels) - 1, -1, -1):
        above = waiting(k + 1) if found is None else found.unionByName(waiting(k + 1))
        above = above.select("g", F.col("i").alias("up"), F.col("path").alias("rest"), *carried)
        joined = levels[k].withColumn("up", (F.col("i") / arity).cast("long")).join(above, ["g", "up"])
        path = F.concat(F.array("step"), "rest").alias("path")
        if k == 0:
            found = joined.select(*own, path, *carried)
        else:
            before, found = found, scratch.put(joined.select("g", "i", path, *carried))
            scratch.drop(levels[k])
            if before is not None:
                scratch.drop(before)
    lone = leaves.where("m = 1").join(tops.where("height = 0").select("g", "path", *carried), "g").select(*own, "path", *carried)
    return lone if found is None else found.unionByName(lone)


def prove(rows: DataFrame, arity: int = 2) -> DataFrame:
    """Proofs of ``rows`` (doc_id, g, leaf, tampered): (doc_id, leaf, tampered, path, subroot, root).

    ``path`` holds one ``STEP`` a level, from the leaf to the root.
    """
    if arity < 2:
        raise ValueError("a tree needs at least two slots")
    scratch = _Scratch()
    fixed = scratch.put(rows.select("doc_id", "g", F.col("leaf").alias("h"), "tampered"))
    leaves = scratch.put(numbered(fixed, "g", ["doc_id", "h"], scratch))
    levels, tops = _grow(leaves, arity, scratch)
    # the tree over the subroots: one group, ordered by the names of the groups
    below = tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "h", "height")
    subroots = scratch.put(numbered(below.withColumnRenamed("height", "low"), "g", ["name"], scratch))
    upper, top = _grow(subroots, arity, scratch)
    root = top.select("g", "height", F.array().cast(f"array<{STEP}>").alias("path"), F.col("h").alias("root"))
    reached = _descend(subroots, upper, root, arity, scratch, ["root"], ["name", "h", "low"])
    starts = scratch.put(reached.select(F.col("name").alias("g"), F.col("low").alias("height"), "path",
                                        F.col("h").alias("subroot"), "root"))
    out = _descend(leaves, levels, starts, arity, scratch, ["subroot", "root"], ["doc_id", "h", "tampered"])
    return out.withColumnRenamed("h", "leaf")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the steps of its proof give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def proof_text(path: Column) -> Column:
    """All siblings of a proof, level by level from left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, arity: int = 2, tampered: dict[str, Column] | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, leaf, subroot, root, path (the proof), folded_root and verified.

    The trees are those of ``docs`` as given; ``tampered`` (column name to value) changes the rows that are checked against them.
    """
    changed = {"doc_id": "doc_id", **{c: c for c in FIELDS}, **(tampered or {})}
    second = leaf_of([changed[c] if isinstance(changed[c], Column) else F.col(c) for c in FIELDS])
    group = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    rows = docs.select("doc_id", group.alias("g"), leaf_of([F.col(c) for c in FIELDS]).alias("leaf"), second.alias("tampered"))
    proven = prove(rows, arity)
    folded = fold(F.col("tampered"), F.col("path"))
    return (proven.select("doc_id", "leaf", "subroot", "root", "path", folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Proofs of all documents; of those whose id's crc32 is a multiple of 7, one with a character more is checked."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_MOD == 0
    more = F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    out = manifest(docs, tampered={"n_chars": more})
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
                      "folded_root", "verified")


#: Trees and folds by recursion; crc32 is computed bit by bit from the digits of the id.
OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [1, 2, 3, 4, 5, 6, 7, 8]),
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc FROM documents),
e AS (SELECT *, sha256(concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'),
      coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
    sha256(concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'),
      coalesce(strlen(CAST(n_chars + hit AS VARCHAR)) || ':' || (n_chars + hit), '-'), coalesce(strlen(text) || ':' || text, '-'))) AS checked
  FROM (SELECT *, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS hit FROM d)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS m FROM e),
low(lang, l, i, m, h) AS (SELECT lang, 0, i, m, leaf FROM leaves UNION ALL
  SELECT lang, l + 1, i // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE m > 1 GROUP BY lang, l + 1, i // 2, (m + 1) // 2),
subs AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS m FROM low WHERE m = 1),
high(l, i, m, h) AS (SELECT 0, i, m, h FROM subs UNION ALL
  SELECT l + 1, i // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE m > 1 GROUP BY l + 1, i // 2, (m + 1) // 2),
inner_walk(r, l, lang, i, m, acc, proof) AS (SELECT r, 0, lang, i, m, checked, '' FROM leaves UNION ALL
  SELECT w.r, w.l + 1, w.lang, w.i // 2, (w.m + 1) // 2,
    sha256(CASE WHEN w.i % 2 = 0 THEN w.acc || coalesce(n.h, '') ELSE n.h || w.acc END), w.proof || coalesce(n.h, '')
  FROM inner_walk w LEFT JOIN low n ON n.l = w.l AND n.lang IS NOT DISTINCT FROM w.lang AND n.i = xor(w.i, 1) WHERE w.m > 1),
walk(r, l, i, m, acc, proof) AS (SELECT w.r, 0, s.i, s.m, w.acc, w.proof
    FROM inner_walk w JOIN subs s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.m = 1 UNION ALL
  SELECT w.r, w.l + 1, w.i // 2, (w.m + 1) // 2,
    sha256(CASE WHEN w.i % 2 = 0 THEN w.acc || coalesce(n.h, '') ELSE n.h || w.acc END), w.proof || coalesce(n.h, '')
  FROM walk w LEFT JOIN high n ON n.l = w.l AND n.i = xor(w.i, 1) WHERE w.m > 1)
SELECT leaves.doc_id, leaves.leaf, subs.h AS subroot, root.h AS root, sha256(walk.proof) AS proof_sha256, walk.acc AS folded_root,
  walk.acc = root.h AS verified
FROM walk JOIN leaves USING (r) JOIN subs ON subs.lang IS NOT DISTINCT FROM leaves.lang
CROSS JOIN (SELECT h FROM high WHERE m = 1) root WHERE walk.m = 1
"""
