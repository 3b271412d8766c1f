"""SimHash near-duplicates by the generalised pigeonhole principle.

Every document gets a 64-bit SimHash of its word shingles. Two fingerprints link when at most
``max_bits`` bits differ; documents connected by links form one component.

Search over the distinct fingerprints:

* **Grouping.** The 64 x 64 correlation of the bits is measured over all distinct fingerprints.
  Correlated bits are put into the same of ``parts`` groups, so that the groups are
  close to independent.
* **Allocation.** If thresholds ``t_i >= -1`` sum to ``max_bits - parts + 1``, two fingerprints within
  ``max_bits`` agree up to ``t_i`` bits in some group ``i``. For each fingerprint, dynamic programming
  over the groups chooses the thresholds of the smallest estimated number of candidates.
  The estimate is a histogram of hashed group values, of fixed size (``parts * 2**16`` counts).
* **Probe and verify.** An equi-join of index rows (one per group) with probe rows (the values within
  ``t_i`` bits), then ``bit_count(a xor b) <= max_bits``.
* **Crowded keys.** Where index rows times probe rows of a key exceed ``crowded``, its pairs aren't listed.
  Every fingerprint that meets such a key lists the 65 points within one bit of it.
  Two fingerprints within two bits always share such a point, and a point has 65 owners at most,
  so this links them exactly with work in proportion to the fingerprints.

Cases: NULL or word-less texts have fingerprint 0 and link like any other; repeated rows share a
fingerprint; NULL ids are ignored by ``component_id`` unless a component has no other; an empty table
gives an empty result; other columns of the input don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, positional, staged, table, text_key
from .components import components

SHINGLE = 3
MAX_BITS = 2
PARTS = 3
SEED = 42
CROWDED = 4096
_FOLD = 1 << 16


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]
    values = np.array(hashes, dtype=">u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 1 << 14):
        block = values[at:at + (1 << 14)].view(np.uint8)
        counts += np.unpackbits(block).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(id, text_hash, fp): ``fp`` is the fingerprint as a signed long."""
    source = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_hash"),
                         F.col(text_col).cast("binary").alias("body"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = [simhash(b, shingle) for b in batch.column(2).to_pylist()]
            fp = pa.array(np.array(fps, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp], ["id", "text_hash", "fp"])

    return arrow(source, run, f"id {id_type}, text_hash bigint, fp bigint")


def _bits(values: np.ndarray) -> np.ndarray:
    """(n, 64) of 0/1; column k is bit k (the lowest first)."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together (4,096 sums)."""

    def run(batches):
        total, pairs = 0, np.zeros((64, 64), dtype=np.int64)
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.float32)
            total += len(bits)
            pairs += (bits.T @ bits).astype(np.int64)
        flat = np.append(pairs.reshape(-1), total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size), pa.int32()), pa.array(flat, pa.int64())],
                                         ["cell", "n"])

    rows = arrow(distinct.select("fp"), run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    flat = np.zeros(64 * 64 + 1, dtype=np.int64)
    for row in rows.collect():                      # 4,097 rows, whatever the input
        flat[row.cell] = row.n
    return int(flat[-1]), flat[:-1].reshape(64, 64)


def group_bits(total: int, pairs: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal size, correlated bits together."""
    n = max(1, total)
    p = np.diag(pairs) / n
    spread = np.sqrt(np.clip(p * (1 - p), 1e-9, None))
    corr = np.abs((pairs / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for g in range(parts):
        size = (64 - sum(map(len, groups))) // (parts - g)
        order = sorted(left)
        group = [max(order, key=lambda b: (corr[b, order].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def _project(values: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """(n, parts) values of the groups."""
    bits = _bits(values).astype(np.uint64)
    return np.stack([(bits[:, g] << np.arange(len(g), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                     for g in groups], axis=1)


def _fold(value: np.ndarray) -> np.ndarray:
    v = value * np.uint64(0x9E3779B97F4A7C15)
    return (v >> np.uint64(48)).astype(np.int64)


def _masks(width: int, radius: int) -> np.ndarray:
    """All xor masks of at most ``radius`` of ``width`` bits, smaller ones first."""
    masks, last = [0], [0]
    for _ in range(radius):
        last = sorted({m | 1 << b for m in last for b in range(width) if not m >> b & 1})
        masks += last
    return np.array(masks, dtype=np.uint64)


def histogram(distinct: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """(parts, 2**16) counts of hashed group values over all fingerprints."""

    def run(batches):
        counts = np.zeros((len(groups), _FOLD), dtype=np.int64)
        for batch in batches:
            part = _project(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), groups)
            for i in range(len(groups)):
                counts[i] += np.bincount(_fold(part[:, i]), minlength=_FOLD)
        flat = counts.reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at], pa.int64())], ["cell", "n"])

    rows = arrow(distinct.select("fp"), run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(len(groups) * _FOLD, dtype=np.int64)
    for row in rows.toLocalIterator():              # at most parts * 65,536 rows, whatever the input
        out[row.cell] = row.n
    return out.reshape(len(groups), _FOLD)


def allocate(costs: list[np.ndarray]) -> np.ndarray:
    """Thresholds per row, by dynamic programming over the groups.

    ``costs[i][:, u]`` is the cost of threshold ``u - 1`` in group ``i``; the units ``u`` sum to the
    number of columns less one, that is ``max_bits + 1``.
    """
    rows, units = costs[0].shape[0], costs[0].shape[1] - 1
    best = np.full((rows, units + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for cost in costs:
        new = np.full((rows, units + 1), np.inf)
        pick = np.zeros((rows, units + 1), dtype=np.int8)
        for total in range(units + 1):
            for u in range(total + 1):
                value = best[:, total - u] + cost[:, u]
                better = value < new[:, total]
                new[better, total] = value[better]
                pick[better, total] = u
        best = new
        picks.append(pick)
    chosen = np.zeros((rows, len(costs)), dtype=np.int64)
    left = np.full(rows, units)
    for i in range(len(costs) - 1, -1, -1):
        chosen[:, i] = picks[i][np.arange(rows), left]
        left = left - chosen[:, i]
    return chosen - 1


def _keys(groups, counts, max_bits, probe: bool):
    """mapInArrow function: fingerprints to (key, fp) rows of the index or of the probes."""
    masks = [[_masks(len(g), r) for r in range(max_bits + 1)] for g in groups]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                fp = whole.column(0).slice(at, 2048).to_numpy(zero_copy_only=False)
                part = _project(fp.view(np.uint64), groups)
                keys, owners = [], []
                if probe:
                    costs = []
                    for i in range(len(groups)):
                        cost = np.zeros((len(fp), max_bits + 2))
                        for r in range(max_bits + 1):
                            near = counts.value[i][_fold(part[:, i, None] ^ masks[i][r][None, :])]
                            cost[:, r + 1] = near.sum(axis=1) + len(masks[i][r])
                        costs.append(cost)
                    chosen = allocate(costs)
                for i in range(len(groups)):
                    for r in range(max_bits + 1) if probe else (0,):
                        rows = np.flatnonzero(chosen[:, i] == r) if probe else np.arange(len(fp))
                        if not len(rows):
                            continue
                        ball = masks[i][r]
                        values = (part[rows, i][:, None] ^ ball[None, :]) | np.uint64(i << 60)
                        keys.append(values.reshape(-1))
                        owners.append(np.repeat(fp[rows], len(ball)))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64), pa.int64()),
                         pa.array(np.concatenate(owners), pa.int64())], ["key", "fp"])

    return run


def links(distinct: DataFrame, max_bits: int = MAX_BITS, parts: int = PARTS, crowded: int = CROWDED) -> DataFrame:
    """(a, b) pairs of fingerprints, ``a < b``, that connect all fingerprints within ``max_bits``.

    ``distinct`` has one row per fingerprint. Every pair within ``max_bits`` is given, or (crowded keys)
    joined by a path of given pairs, each within ``max_bits``.
    """
    if max_bits != 2 and crowded:
        raise ValueError("crowded keys are handled for two bits; pass crowded=0 for other distances")
    spark = distinct.sparkSession
    total, pairs = bit_counts(distinct)
    groups = group_bits(total, pairs, parts)
    counts = spark.sparkContext.broadcast(histogram(distinct, groups))
    fps = distinct.select("fp")
    index = staged(arrow(fps, _keys(groups, counts, max_bits, False), "key bigint, fp bigint"), "gph-index")
    probes = staged(arrow(fps, _keys(groups, counts, max_bits, True), "key bigint, fp bigint"), "gph-probe")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    met_index, met_probes = index, probes
    if crowded:
        hot = staged(index.groupBy("key").agg(F.count("*").alias("n"))
                     .join(probes.groupBy("key").agg(F.count("*").alias("m")), "key")
                     .where(F.col("n") * F.col("m") > crowded).select("key"), "gph-hot")
        met_index, met_probes = index.join(hot, "key", "left_anti"), probes.join(hot, "key", "left_anti")
    found = (met_probes.withColumnRenamed("fp", "a").join(met_index.withColumnRenamed("fp", "b"), "key")
             .where((F.col("a") != F.col("b")) & (distance <= max_bits))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    if crowded:
        dense = (index.join(hot, "key", "left_semi").select("fp")
                 .union(probes.join(hot, "key", "left_semi").select("fp")).distinct())
        masks = F.array(F.lit(0), *[F.expr(f"shiftleft(1L, {k})") for k in range(64)])
        points = (dense.select("fp", F.explode(masks).alias("mask"))
                  .select(F.col("fp").bitwiseXOR(F.col("mask")).alias("point"), "fp"))
        near = (points.groupBy("point").agg(F.collect_list("fp").alias("fps"))      # 65 at most: one per mask
                .where(F.size("fps") > 1))
        found = found.union(near.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
                            .where("a != b"))
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, parts: int = PARTS, crowded: int = CROWDED) -> DataFrame:
    """(id, text_hash, fp, component_id, keeper): a row per document.

    ``component_id`` is the smallest id reachable by links; ``keeper`` marks the rows of the one
    document (smallest id, then smallest text hash) that stands for the component.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("id"),
                                               F.min(F.struct("id", "text_hash")).alias("first"),
                                               F.min(F.when(F.col("id").isNotNull(), F.struct("id", "text_hash")))
                                               .alias("first_known")), "simhash-distinct")
    found = staged(links(distinct, max_bits, parts, crowded), "simhash-links")
    roots = components(found, "a", "b")
    member = (distinct.join(roots, distinct.fp == roots.node, "left")
              .select(distinct.fp, F.coalesce("root", distinct.fp).alias("root"), "id", "first", "first_known"))
    heads = member.groupBy("root").agg(F.min("id").alias("component_id"), F.min("first").alias("any_first"),
                                       F.min("first_known").alias("known_first"))
    classes = staged(member.select("fp", "root").join(heads, "root")
                     .select("fp", "component_id", F.coalesce("known_first", "any_first").alias("head")),
                     "simhash-classes")
    return (prints.join(classes, "fp")
            .select("id", "text_hash", "fp", "component_id",
                    (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("text_hash") == F.col("head.text_hash")))
                    .alias("keeper")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate component: all columns, repeated rows once."""
    plain, names = positional(docs)
    of, body = names[id_col], names[text_col]
    heads = (near_duplicates(plain, of, body, **options).where("keeper")
             .select(F.col("id").alias("head_id"), F.col("text_hash").alias("head_text")).distinct())
    keyed = plain.withColumn("text_hash", text_key(F.col(body)))
    kept = keyed.join(heads, F.col(of).eqNullSafe(F.col("head_id")) & (F.col("text_hash") == F.col("head_text")), "left_semi")
    return kept.dropDuplicates([of, "text_hash"]).select(*[F.col(a).alias(c) for c, a in names.items()])


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")
