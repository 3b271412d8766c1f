"""Substring dedup: repeated passages found by winnowed seeds that are extended both ways.

A passage repeats when a run of ``length`` words also starts somewhere else (in another document or the
same one). The steps:

1. **Seeds.** Winnowing picks the smallest hash of every ``length - gram + 1`` consecutive ``gram``-word
   hashes. Equal runs of ``length`` words hold the same seed at the same place. A partial aggregate over
   the seed hash finds those that occur once only; runs around them can't repeat.
2. **Extend.** Around each repeated seed, every run of ``length`` words that picked it is hashed
   (the seed extended to the left and to the right), and a second aggregate finds the runs that occur once.
3. **Maximal repeats.** What remains in a document are its repeated runs; overlapping ones merge to maximal spans.

Both aggregates keep the smallest and largest place of each hash and so return places of the runs that
occur once: no pairs of occurrences are listed, and a passage in a third of all rows is
combined before the shuffle. Documents with the same text are one place (their copies are repeats by themselves).
Runs and texts are told apart by 64-bit hashes.

Cases: NULL has no words; texts of fewer than ``length`` words are kept; repeated rows and exact copies remove
each other (of ``length`` words at least); an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, staged, table, text_key

LENGTH = 35
GRAM = 12

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` at least."""
    if len(_POWERS[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        for i, base in enumerate((_BASE, _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def _runs(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, from the prefix sums of the word hashes."""
    up, down = _powers(len(prefix))
    value = (prefix[k:] - prefix[:-k]) * down[:len(prefix) - k]
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    return value ^ value >> np.uint64(32)


class Seeds:
    """Word hashes, seeds and the seed picked by each run of ``length`` words of a text."""

    def __init__(self, words: list[bytes], length: int, gram: int):
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(w) for w in words], dtype=np.uint64)
        up, _ = _powers(len(words) + 1)
        self.length = length
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:len(words)], dtype=np.uint64)))
        grams = _runs(self.prefix, gram)
        width = length - gram + 1
        picked = np.empty(len(grams) - width + 1, dtype=np.int64)
        for at in range(0, len(picked), 1 << 14):
            view = np.lib.stride_tricks.sliding_window_view(grams[at:at + (1 << 14) + width - 1], width)
            picked[at:at + len(view)] = view.argmin(axis=1) + np.arange(at, at + len(view))
        self.picked = picked                                   # by the start of the run
        self.places = np.unique(picked)
        self.hashes = grams[self.places]

    def candidates(self, once) -> np.ndarray:
        """Starts of the runs whose seed isn't among the seed places that occur once."""
        if once is None or not len(once):
            return np.arange(len(self.picked))
        return np.flatnonzero(~np.isin(self.picked, once))

    def runs(self, starts: np.ndarray) -> np.ndarray:
        return _runs(self.prefix, self.length)[starts]


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal spans covered by runs of ``length`` at the sorted ``starts``."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > length)
    first = starts[np.concatenate(([0], cuts + 1))]
    last = starts[np.concatenate((cuts, [len(starts) - 1]))] + length
    return list(zip(first.tolist(), last.tolist()))


def _places(values, key, places, schema=("hash", "key", "place")):
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(values).view(np.int64), pa.int64()), pa.array(np.concatenate(key), pa.int64()),
         pa.array(np.concatenate(places).astype(np.int32), pa.int32())], list(schema))


def _once(rows: DataFrame) -> DataFrame:
    """(key, places): for each text the places whose hash occurs nowhere else."""
    lone = (rows.groupBy("hash").agg(F.min("key").alias("key"), F.max("key").alias("key2"),
                                     F.min("place").alias("place"), F.max("place").alias("place2"))
            .where("key = key2 AND place = place2"))
    return lone.groupBy("key").agg(F.collect_list("place").alias("places"))     # at most the length of one text


def _emit(rows_of, batches):
    """Collect (hash, key, place) arrays of texts into batches of about a quarter million rows."""
    held, size = ([], [], []), 0
    for batch in batches:
        for hashes, key, places in rows_of(batch):
            for column, part in zip(held, (hashes, np.full(len(hashes), key, np.int64), places)):
                column.append(part)
            size += len(hashes)
            if size >= 1 << 18:
                yield _places(*held)
                held, size = ([], [], []), 0
    if size:
        yield _places(*held)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
            gram: int = GRAM) -> DataFrame:
    """(id, n_words, n_removed, spans, kept): spans are maximal repeats (word ranges, end exclusive),
    ``kept`` the other words joined by one space."""
    source = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"),
                         F.col(text_col).cast("binary").alias("body"))
    id_type = source.schema["id"].dataType.simpleString()
    place = "hash bigint, key bigint, place int"

    def seeds_of(batch):
        for key, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = (body or b"").split()
            if len(words) >= length:
                seeds = Seeds(words, length, gram)
                yield seeds.hashes, key, seeds.places

    lone_seeds = _once(arrow(source, lambda batches: _emit(seeds_of, batches), place))
    copies = source.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    seeds = staged(copies.join(lone_seeds.withColumnRenamed("places", "once"), "key", "left"), "substring-seeds")

    def packed(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            body = [press.compress(b or b"") for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(body, pa.binary())],
                                             ["id", "key", "body"])

    # compressed texts: they are the bulk of what the two joins below move
    texts = arrow(source, packed, f"id {id_type}, key bigint, body binary")

    def runs_of(batch):
        unpress = zstandard.ZstdDecompressor()
        for key, body, once in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = unpress.decompress(body).split()
            if len(words) >= length:
                seeds = Seeds(words, length, gram)
                starts = seeds.candidates(once)
                if len(starts):
                    yield seeds.runs(starts), key, starts

    known = (texts.join(seeds, "key").where(F.col("id").eqNullSafe(F.col("first_id"))).select("key", "body", "once"))
    lone_runs = staged(_once(arrow(known, lambda batches: _emit(runs_of, batches), place)), "substring-runs")
    facts = seeds.select("key", "copies", "once").join(lone_runs.withColumnRenamed("places", "lone"), "key", "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batches):
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            counts, removed, spans, kept = [], [], [], []
            for body, copies, once, lone in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                words = unpress.decompress(body).split()
                found = []
                if len(words) >= length:
                    if copies > 1:
                        found = [(0, len(words))]
                    else:
                        starts = Seeds(words, length, gram).candidates(once)
                        if lone:
                            starts = starts[~np.isin(starts, lone)]
                        found = _spans(starts, length)
                rest, last = [], 0
                for a, b in found:
                    rest += words[last:a]
                    last = b
                rest += words[last:]
                counts.append(len(words))
                removed.append(len(words) - len(rest))
                spans.append([{"start": a, "end": b} for a, b in found])
                kept.append(b" ".join(rest))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span),
                 pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "spans", "kept"])

    return arrow(texts.join(facts, "key").select("id", "body", "copies", "once", "lone"), finish,
                 f"id {id_type}, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Removed words and a digest of the kept ones for every document."""
    return repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: All runs of 35 words, grouped as strings.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS k
    FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT k FROM runs GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(generate_series(i, i + 34)) AS p FROM runs SEMI JOIN twice USING (k))),
flat AS (SELECT r, p, w[p] AS x FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM flat ANTI JOIN gone USING (r, p) GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)
"""
