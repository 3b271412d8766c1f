"""Token ids in directly addressable codes (DACs).

An id is cut into chunks of ``CHUNK_BITS`` bits, the lowest first. Level 0 holds the first chunk of every id;
a bitmap per level tells which ids go on, and only those have a chunk in the next level. A rank
directory per bitmap (ones before each block of ``RANK_BLOCK`` bits) finds an id's place in the next level, so any
token is read from a few bytes without decoding its neighbours (:func:`token_at`).

A file image (one segment) holds whole documents, about ``SEGMENT_TOKENS`` tokens together::

    magic 'DAC1' | uint32 levels | uint64 ids | per level: uint64 chunks, chunk bytes, bitmap bytes, uint32 ranks

All numbers are little-endian. :func:`write` range-partitions the documents by id, encodes them
and writes segments in ascending id order: Parquet rows (part, seq, document ids, token counts, image) in a shared
folder, which any store that Spark writes to can hold. :func:`read_documents` decodes them again;
:func:`read_tokens` fetches single tokens by global position.

Cases: NULL is the empty text (the end id alone); rows of equal ids are in the order of their text hashes, and
equal rows are interchangeable; NULL ids come first; an empty table writes no segment; other columns don't matter.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_root
from .common import arrow, table, text_key

CHUNK_BITS = 8
RANK_BLOCK = 512
SEGMENT_TOKENS = 1 << 18
END_ID = 0
#: Pieces of text that a worker remembers, and the longest one in characters.
CACHE = 1_200_000
LONG = 200
#: Texts are encoded in groups of about this many characters.
GROUP = 1 << 21
#: Marks a piece that can't be encoded alone; no vocabulary has this id.
_NO_ID = 2**32 - 1
_UNSAFE = _NO_ID.to_bytes(4, "little")


# ---- file format ----------------------------------------------------------------------------------

def pack(ids: np.ndarray) -> bytes:
    """The file image of an array of unsigned 32-bit ids."""
    level, body, levels = ids.astype(np.uint32), [], 0
    while levels == 0 or len(level):
        more = level >> CHUNK_BITS != 0
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK), dtype=np.uint32) if len(more) else \
            np.zeros(0, np.uint32)
        ranks = np.concatenate(([0], np.cumsum(ones)[:-1])) if len(ones) else ones
        body += [struct.pack("<Q", len(level)), (level & (1 << CHUNK_BITS) - 1).astype(np.uint8).tobytes(),
                 bits.tobytes(), ranks.astype("<u4").tobytes()]
        level = level[more] >> CHUNK_BITS
        levels += 1
    return b"".join([b"DAC1", struct.pack("<IQ", levels, len(ids)), *body])


class Image:
    """A file image opened for reading: views of its levels, nothing is decoded."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a DAC image")
        levels, self.size = struct.unpack_from("<IQ", data, 4)
        at, self.levels = 16, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at + 8 + n)
            blocks = -(-n // RANK_BLOCK)
            ranks = np.frombuffer(data, "<u4", blocks, at + 8 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + len(bits) + 4 * blocks

    def token_at(self, i: int) -> int:
        """Id number ``i``, from one chunk, bit and rank a level."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for depth, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << CHUNK_BITS * depth
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                break
            block = i // RANK_BLOCK
            before = bits[block * (RANK_BLOCK // 8):byte]
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + (int(bits[byte]) & (1 << bit) - 1).bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All ids."""
        above = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            here = chunks.astype(np.uint32)
            if len(above):
                here[more] |= above << CHUNK_BITS
            above = here
        return above


# ---- encoding -------------------------------------------------------------------------------------

_LOADED: dict = {}


def load(path: str):
    """The tokenizers-library tokenizer of a file; a Python worker reads it once."""
    if path not in _LOADED:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        _LOADED[path] = tokenizer, {}
    return _LOADED[path]


def _by_space(tokenizer) -> bool:
    """Whether texts can be encoded piece by piece: byte-level split, no normalizer, no added prefix."""
    import json

    spec = json.loads(tokenizer.to_str())
    split = spec["pre_tokenizer"] or {}
    return (spec["normalizer"] is None and spec["post_processor"] is None and split.get("type") == "ByteLevel"
            and split.get("use_regex") and not split.get("add_prefix_space")
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"]
                        for t in spec["added_tokens"]))


class Encoder:
    """Encodes batches of texts with the tokenizers library, each different piece once.

    The byte-level split never joins a word with the white space after it. A text is cut before each
    U+0020 and each line feed, and the pieces (with that character) are encoded alone. Only runs of white
    space reach over a cut: a text with a piece that ends in white space is encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer, self.pieces = load(path)
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.cut = _by_space(self.tokenizer) and len(feed) == 1
        self.feed = feed[0] if feed else 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces) -> None:
        """Encode pieces and remember them; those that are safe alone go 64 to a text, between line feeds."""
        known, safe, rest = self.pieces, [], []
        for p in pieces:
            (safe if p and p[0] != "\n" and not p[-1].isspace() else rest).append(p)
        blocks = [safe[at:at + 64] for at in range(0, len(safe), 64)]
        texts = [" " + "\n ".join(block) for block in blocks]
        for block, e in zip(blocks, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            raw, start = ids.tobytes(), 0
            cuts = np.flatnonzero(ids == self.feed).tolist()
            if len(cuts) != len(block) - 1:
                rest += block
                continue
            for p, cut in zip(block, [*cuts, len(ids)]):
                known[p] = raw[4 * start:4 * cut]
                start = cut + 1
        known.update(zip(rest, self._encode([p if p[:1] == "\n" else " " + p for p in rest])))
        known.update((p, _UNSAFE) for p in rest if not p or p[-1].isspace())

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Arrays of unsigned 32-bit ids."""
        if not self.cut:
            return [np.frombuffer(b, "<u4") for b in self._encode(texts)]
        known = self.pieces
        split = [text.replace("\n", " \n").split(" ") for text in texts]
        firsts = [pieces[0] for pieces in split]
        for pieces in split:
            del pieces[0]                               # the first piece has no space before it
        seen = set().union(*split)
        new = seen - known.keys()
        if len(known) + len(new) > CACHE:
            known.clear()
            new = seen
        if new:
            self._learn(new)
        out, whole = [], []
        for i, (pieces, first) in enumerate(zip(split, self._encode(firsts))):
            ids = np.frombuffer(first + b"".join(map(known.__getitem__, pieces)), "<u4")
            if (pieces and firsts[i] and firsts[i][-1].isspace()) or (len(ids) and ids.max() == _NO_ID):
                whole.append(i)
            out.append(ids)
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]) if whole else ()):
            out[i] = np.frombuffer(ids, "<u4")
        for p in new:
            if len(p) > LONG:
                del known[p]
        return out


def _groups(body: pa.Array):
    """(first row, texts) of about ``GROUP`` characters each."""
    at, texts, size = 0, [], 0
    for i, text in enumerate(body.to_pylist()):
        if texts and size + len(text) > GROUP:
            yield at, texts
            at, texts, size = i, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield at, texts


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
          out: str | None = None, segment_tokens: int = SEGMENT_TOKENS) -> str:
    """Encode ``docs`` and write their segments in ascending id order; returns the folder."""
    spark = docs.sparkSession
    out = out or scratch_root(spark, "tokens")
    source = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_hash"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    id_type = source.schema["id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(parts, "id", "text_hash").sortWithinPartitions("id", "text_hash")

    def run(batches):
        encoder = Encoder(path)
        part, seq = TaskContext.get().partitionId(), 0
        owners, held, size = [], [], 0

        def segment():
            lens = pa.array([[len(x) for x in held]], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(owners)], pa.int32()), pa.array(owners, id_arrow)),
                 lens, pa.array([pack(np.concatenate(held))], pa.binary())],
                ["part", "seq", "ids", "lens", "image"])

        for batch in batches:
            id_arrow = batch.column(0).type
            ids = batch.column(0).to_pylist()
            body = batch.column(2)
            for at, texts in _groups(body):
                for owner, tokens in zip(ids[at:], encoder.batch(texts)):
                    if held and size + len(tokens) + 1 > segment_tokens:
                        yield segment()
                        seq += 1
                        owners, held, size = [], [], 0
                    owners.append(owner)
                    held.append(np.append(tokens, np.uint32(end_id)).astype(np.uint32))
                    size += len(tokens) + 1
        if held:
            yield segment()

    arrow(ordered, run, f"part int, seq bigint, ids array<{id_type}>, lens array<bigint>, image binary").write.mode(
        "overwrite").parquet(out)
    return out


def _segments(spark, folder: str) -> DataFrame:
    """Segments with the number of tokens before each one in the whole corpus."""
    rows = spark.read.parquet(folder)
    sizes = rows.select("part", "seq", F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    # one row a part: the table is as long as the number of partitions written
    parts = (sizes.groupBy("part").agg(F.sum("n").alias("total"))
             .select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(
                 Window.unboundedPreceding, -1)), F.lit(0)).alias("part_first")))
    places = (sizes.withColumn("local", F.coalesce(before, F.lit(0))).join(parts, "part")
              .select("part", "seq", (F.col("part_first") + F.col("local")).alias("first"), "n"))
    return rows.join(places, ["part", "seq"])


def read_documents(spark, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, last_id), decoded from the segments."""
    rows = spark.read.parquet(folder)
    id_type = rows.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part, seq = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                owners = batch.column(2).slice(k, 1).flatten()
                lens = batch.column(3).slice(k, 1).flatten().to_numpy(zero_copy_only=False)
                image = Image(batch.column(4)[k].as_py())
                raw = memoryview(image.ids().astype("<u4").tobytes())
                ends = np.cumsum(lens)
                crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for n, e in zip(lens.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(lens), pa.int32()), pa.array([seq] * len(lens), pa.int64()), owners,
                     pa.array(ends - lens, pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64()),
                     pa.array([image.token_at(int(e) - 1) for e in ends], pa.int64())],
                    ["part", "seq", "id", "local", "n_tokens", "ids_crc32", "last_id"])

    decoded = arrow(
        rows.select("part", "seq", "ids", "lens", "image"), run, f"part int, seq bigint, id {id_type}, local bigint, n_tokens bigint, ids_crc32 bigint, last_id bigint")
    places = _segments(spark, folder).select("part", "seq", "first")
    return decoded.join(places, ["part", "seq"]).select(
        "id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "last_id")


def read_tokens(spark, folder: str, positions: DataFrame, position_col: str = "position") -> DataFrame:
    """(position, token) for global token positions; positions past the end are left out."""
    places = _segments(spark, folder)
    wanted = positions.select(F.col(position_col).cast("long").alias("position"))
    width = SEGMENT_TOKENS
    cells = places.select("first", "n", "image", F.explode(F.sequence(
        F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("n") - 1) / width))).alias("cell"))
    met = (wanted.withColumn("cell", F.floor(F.col("position") / width)).join(cells, "cell")
           .where("position >= first AND position < first + n"))
    rows = met.groupBy("first", "cell").agg(F.first("image").alias("image"), F.collect_set("position").alias("at"))

    def run(batches):
        for batch in batches:
            for first, data, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                image = Image(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int64()), pa.array([image.token_at(p - first) for p in at], pa.int64())],
                    ["position", "token"])

    return arrow(rows.select("first", "image", "at"), run, "position bigint, token bigint")


def byte_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_output(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Write every document's tokens, read the files back, and digest what they hold."""
    folder = write(table(spark, sf_dir, "documents"), path or byte_tokenizer())
    return read_documents(spark, folder).withColumnRenamed("id", "doc_id")
