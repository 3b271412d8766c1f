"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton accepts every run of consecutive words of any item. Training words are streamed through
it; the state gives the length of the longest item run that ends at each word. A run of ``window``
words, or a whole shorter item, is an occurrence, and its words are hit.

The benchmark reaches the tasks in blocks of at most ``block_words`` words (about the size of one
automaton); a task holds one block's automaton per pass over a batch. Longer items are cut into
pieces that overlap by ``window - 1`` words, so no run is lost. The documents aren't shuffled.

Cases: NULL text has no words and no hits; NULL or empty items are ignored; an item id on several rows
counts once; NULL item ids hit, but aren't listed; repeated documents are treated alike; an empty
benchmark leaves every document clean; other columns are kept by :func:`remove` and ignored by :func:`scan`.
"""

from __future__ import annotations

import re
from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, table

WINDOW = 10
BLOCK_WORDS = 200_000
#: remove(): a document goes when more than this share of its words is hit; else its hit spans go.
MAX_COVERAGE = 0.5

#: Fixed by the contract: words are runs of ASCII letters and digits and of all non-ASCII characters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CLEAN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text."""
    return (text or b"").translate(_CLEAN).split()


Found = namedtuple("Found", "spans items longest")


class Automaton:
    """Generalised suffix automaton over word numbers of (item, words) pairs."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        coded = [(item, [self.number.setdefault(w, len(self.number)) for w in ws]) for item, ws in items if ws]
        for _, ws in coded:
            last = 0
            for c in ws:
                last = self._extend(last, c)
        self._mark(coded)
        self.least = min([window, *(len(ws) for _, ws in coded)])

    def _extend(self, last: int, c: int) -> int:
        step, length, link = self.step, self.length, self.link
        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._state({}, length[last] + 1, 0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, step: dict, length: int, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._state(dict(self.step[q]), self.length[p] + 1, self.link[q])
        while p != -1 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _mark(self, coded) -> None:
        """Items of each window (by the state that holds it) and of each whole short item."""
        n, window = len(self.step), self.window
        order = sorted(range(n), key=self.length.__getitem__)
        self.at_window = [-1] * n                  # the state on the link path that holds the last window words
        for s in order:
            if self.length[s] >= window:
                up = self.link[s]
                self.at_window[s] = self.at_window[up] if self.length[up] >= window else s
        self.items: dict[int, set[int]] = {}
        whole: dict[int, set[int]] = {}
        sizes: dict[int, int] = {}
        for item, ws in coded:
            s = 0
            for i, c in enumerate(ws):
                s = self.step[s][c]
                if i + 1 >= window:
                    self.items.setdefault(self.at_window[s], set()).add(item)
            if len(ws) < window:
                whole.setdefault(s, set()).add(item)
                sizes[s] = len(ws)
        self.whole = whole
        self.short: list[tuple] = [()] * n         # (size, state) of the short items that end here: one a size at most
        if whole:
            for s in order[1:]:
                up = self.short[self.link[s]]
                self.short[s] = (*up, (sizes[s], s)) if s in whole else up

    def runs(self, ws: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Word numbers and the stretches of known words long enough to hold an occurrence."""
        get = self.number.get
        ids = np.array([get(w, -1) for w in ws], dtype=np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        return ids, [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= self.least]

    def search(self, ws: list[bytes]) -> Found:
        """Hit spans (start, end), items with occurrences and the longest run matched."""
        ids, stretches = self.runs(ws)
        spans: list[list[int]] = []
        items: set[int] = set()
        longest = 0
        step, length, link, window = self.step, self.length, self.link, self.window

        def hit(start: int, end: int) -> None:
            while spans and spans[-1][0] >= start:
                spans.pop()
            if spans and start <= spans[-1][1]:
                spans[-1][1] = end
            else:
                spans.append([start, end])

        for a, b in stretches:
            s = size = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while c not in step[s] and s:
                    s = link[s]
                    size = length[s]
                if c in step[s]:
                    s = step[s][c]
                    size += 1
                longest = max(longest, size)
                if size >= window:
                    hit(i + 1 - window, i + 1)
                    items |= self.items[self.at_window[s]]
                for m, state in self.short[s]:
                    if m <= size:
                        hit(i + 1 - m, i + 1)
                        items |= self.whole[state]
        return Found([(x, y) for x, y in spans], items, longest)


def _blocks(bench: DataFrame, item_col: str, text_col: str, window: int, block_words: int):
    """Broadcast blocks of (item number, words) and the item ids by number, read in a stream."""
    sc = bench.sparkSession.sparkContext
    out, block, held = [], [], 0
    rows = bench.select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).where(
        F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        ws = words(bytes(text))
        for at in range(0, max(1, len(ws) - window + 1), block_words):
            piece = ws[at:at + block_words + window - 1]
            if not piece:
                continue
            if block and held + len(piece) > block_words:
                out.append(sc.broadcast(block))
                block, held = [], 0
            block.append((item, piece))
            held += len(piece)
    if block:
        out.append(sc.broadcast(block))
    return out


_LOADED: dict = {}


def _automaton(block, window: int):
    """The automaton of a broadcast block; a Python worker keeps the last one."""
    key = (block._jbroadcast.id() if getattr(block, "_jbroadcast", None) else id(block), window)
    if _LOADED.get("key") != key:
        names = sorted({item for item, _ in block.value if item is not None})
        number = {name: i for i, name in enumerate(names)}
        _LOADED.update(key=key, names=names, value=Automaton([(number.get(i, -1), ws) for i, ws in block.value], window),
                       block=block)
    return _LOADED["value"], _LOADED["names"]


def _merge(found: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(s for spans in found for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _search_all(texts: list, blocks, window: int):
    """Per text: words, spans, sorted item ids, longest run; blocks outermost, so one automaton is held."""
    split = [words(t) for t in texts]
    spans, items, longest = [[] for _ in texts], [set() for _ in texts], [0] * len(texts)
    for block in blocks:
        automaton, names = _automaton(block, window)
        for i, ws in enumerate(split):
            got = automaton.search(ws)
            if got.spans:
                spans[i].append(got.spans)
                items[i] |= {names[k] for k in got.items if k >= 0}
            longest[i] = max(longest[i], got.longest)
    return split, [s[0] if len(s) == 1 else _merge(s) for s in spans], [sorted(x) for x in items], longest


def scan(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, n_hit, items, spans, longest): ``spans`` are hit word ranges, end exclusive."""
    blocks = _blocks(bench, item_col, item_text_col, window, block_words)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))
    id_type = source.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            split, spans, items, longest = _search_all(batch.column(1).to_pylist(), blocks, window)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, split)), pa.int64()),
                 pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                 pa.array(items, pa.list_(pa.string())),
                 pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span),
                 pa.array(longest, pa.int64())],
                ["id", "n_words", "n_hit", "items", "spans", "longest"])

    return arrow(source, run, f"id {id_type}, n_words bigint, n_hit bigint, items array<string>, "
                                  "spans array<struct<start:bigint,end:bigint>>, longest bigint")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans`` and without what stands between words of one span."""
    if not spans:
        return text
    at = [(m.start(), m.end()) for m in WORD.finditer(text.lower())]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last:at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def remove(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE,
           block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without contaminated spans; documents hit over ``max_coverage`` of their words go.

    All columns are kept; clean documents are returned unchanged (byte for byte).
    """
    blocks = _blocks(bench, item_col, item_text_col, window, block_words)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            split, spans, _, _ = _search_all(texts, blocks, window)
            share = [sum(b - a for a, b in s) / len(ws) if ws else 0 for s, ws in zip(spans, split)]
            if any(spans):
                new = [t if not s else cut(t, s) for t, s in zip(texts, spans)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, pa.binary()).cast(pa.string()))
            keep = pa.array([x <= max_coverage for x in share], pa.bool_())
            yield batch.filter(keep)

    return arrow(docs, run, docs.schema)


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against the whole benchmark."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit",
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


#: Plain windows and joins instead of an automaton.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
    FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS k
    FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, sizes WHERE len(w) >= m)),
hits AS (SELECT dw.r, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.k = bw.k),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(named.s, '')) AS items_sha256,
    coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
