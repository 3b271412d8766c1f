"""Spelling variants: words of a vocabulary that differ by one edit, grouped around their most frequent forms.

Method: finite-state composition. The minimised acceptor of the vocabulary is composed with a transducer of exactly one inserted,
deleted or replaced code point and with the acceptor again; the pairs that the machine accepts are the near words.

* **Partitions by initial state.** Two words of one edit agree outside a window that holds the edit. A word of ``size`` code points is
  entered under what lies outside each half of it, and, as the longer partner of words shorter by one, likewise under that size.
  All words of one such key reach the same state of the machine before the window, so each key is a machine of its own, started in that
  state. A key of more than ``CROWD`` words has its window halved again, until it is small or its window is one code point wide (then
  it holds at most one word for each letter, or two). So no key, however many words share a beginning or an end, is met by one
  task whole, and no pair of words is lost: the windows of a word cover all its places.
* **One pair, once.** The edit's place is the length of the words' common beginning; a pair counts in the window that holds it.
* A key's acceptor is built from its sorted words by layers, from the last code point to the first, equal states being
  merged. The composed machine is walked with a stack, so very long words need no recursion.

What leaves a task is a row a word and key: the number of near words found there and the best of them.

Cases: a NULL or empty text has no words; a NULL id counts as '' in the hash; rows that repeat count each time; among near words of
equal count the smallest in code-point order is the form; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, staged, table

#: A run of letters (ASCII and U+00C0 to U+00FF).
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 97               # a run whose hash this divides loses a code point
MIN_LENGTH, MIN_COUNT = 5, 3
#: A form occurs at least so many times as often as its variant.
RATIO = 2
#: Words a key may hold before its window is halved.
CROWD = 4096


def runs(docs: DataFrame) -> DataFrame:
    """(word): each run of letters, lower-cased, some with a code point deleted by the rule of the contract."""
    run = F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0)))
    low = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run")).select(
        "id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return (runs(docs).where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= MIN_COUNT))


# ------------------------------------------------------------------ windows

KEY = ["size", "a", "b", "outside"]


def _piece(text: Column, start: Column | int, length: Column | int) -> Column:
    """``length`` code points from ``start`` (from 0)."""
    of = lambda v: v.cast("int") if isinstance(v, Column) else F.lit(v)
    return F.substring(text, of(start) + F.lit(1), of(length))


def _halves(rows: DataFrame) -> DataFrame:
    """Both halves of each row's window [a, b) over words of ``size`` (``longer``: 1 for words of one code point more).

    ``inside`` is the word's part in the window, ``outside`` the rest."""
    a, b, longer, inside, outside = (F.col(c) for c in ("a", "b", "longer", "inside", "outside"))
    middle = F.floor((a + b) / 2).cast("int")
    head, tail = _piece(outside, 0, a), _piece(outside, a, F.length(outside))
    keep = middle - a
    left = F.struct(a.alias("a"), middle.alias("b"), _piece(inside, 0, keep + longer).alias("inside"),
                    F.concat(head, _piece(inside, keep + longer, F.length(inside)), tail).alias("outside"))
    right = F.struct(middle.alias("a"), b.alias("b"), _piece(inside, keep, F.length(inside)).alias("inside"),
                     F.concat(head, _piece(inside, 0, keep), tail).alias("outside"))
    return rows.select("size", "longer", "n", F.explode(F.array(left, right)).alias("w")).select("size", "longer", "n", "w.*")


def windows(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(size, a, b, outside, longer, inside, n): every word under the keys of windows of at most ``crowd`` words."""
    whole = words.select(F.explode(F.array(
        F.struct(F.length("word").alias("size"), F.lit(0).alias("longer")),
        F.struct((F.length("word") - 1).alias("size"), F.lit(1).alias("longer")))).alias("r"), "word", "n")
    whole = whole.select("r.size", "r.longer", "n", F.lit(0).alias("a"), F.col("r.size").alias("b"),
                         F.col("word").alias("inside"), F.lit("").alias("outside")).where(F.col("size") >= MIN_LENGTH)
    now, settled = staged(_halves(whole), "spelling-windows"), []
    while True:
        crowded = staged(now.where("b - a > 1").groupBy(*KEY).agg(F.count("*").alias("c")).where(F.col("c") > crowd)
                         .select(*KEY), "spelling-crowded")
        if crowded.isEmpty():
            break
        settled.append(now.join(crowded, KEY, "left_anti"))
        now = staged(_halves(now.join(crowded, KEY, "left_semi")), "spelling-windows")
    for part in settled:
        now = now.unionByName(part)
    return now


# ------------------------------------------------------------------ acceptors

FINAL = 0


class Machine:
    """Minimised acceptors that share their states, and their composition with the one-edit transducer."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]      # of each state; FINAL has none
        self.words = [1]                            # words accepted from each state
        self._known: dict[tuple, int] = {}

    def _state(self, arcs: dict[str, int]) -> int:
        key = tuple(arcs.items())
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.words.append(sum(self.words[t] for t in arcs.values()))
        return state

    def accept(self, words: list[str]) -> int | None:
        """The initial state for sorted, distinct words of one length; None for no words."""
        if not words:
            return None
        common = [-1]                               # code points each word shares with the one before it
        for x, y in zip(words, words[1:]):
            n = 0
            while x[n] == y[n]:
                n += 1
            common.append(n)
        heads = [(k, FINAL) for k in range(len(words))]     # first word of each distinct beginning, state after it
        for place in range(len(words[0]) - 1, -1, -1):
            merged: list[tuple[int, dict]] = []
            for k, state in heads:
                if common[k] < place:
                    merged.append((k, {}))
                merged[-1][1][words[k][place]] = state
            heads = [(k, self._state(arcs)) for k, arcs in merged]
        return heads[0][1]

    def _both(self, p: int, q: int):
        """What is accepted from both states."""
        stack = [(p, q, "")]
        while stack:
            p, q, done = stack.pop()
            if p == FINAL and q == FINAL:
                yield done
            few, many = sorted((self.arcs[p], self.arcs[q]), key=len)
            for c, s in few.items():
                t = many.get(c)
                if t is not None:
                    stack.append((s, t, done + c))

    def compose(self, short: int | None, longer: int | None, at_end: bool):
        """Pairs that the machine accepts: two words of ``short`` that differ in one code point, or a word of ``short`` and one of
        ``longer`` with a code point more. ``at_end``: that code point may follow the whole shorter word."""
        if short is None:
            return
        arcs, stack = self.arcs, [(short, longer, "")]
        while stack:
            p, q, done = stack.pop()
            here, there = arcs[p], {} if q is None else arcs[q]
            letters = list(here.items())
            for k, (c, s) in enumerate(letters):
                for d, t in letters[k + 1:]:
                    for rest in self._both(s, t):
                        yield done + c + rest, done + d + rest
            for d, t in there.items():
                after = arcs[t]
                if p == FINAL and t == FINAL and at_end:
                    yield done, done + d
                for c, s in letters:
                    u = after.get(c)
                    if c != d and u is not None:
                        for rest in self._both(s, u):
                            yield done + c + rest, done + d + c + rest
            for c, s in letters:
                t = there.get(c)
                if t is not None or self.words[s] > 1:
                    stack.append((s, t, done + c))


def near_in_key(size: int, a: int, b: int, outside: str, short: dict[str, int], longer: dict[str, int]) -> dict[str, tuple]:
    """word -> (near words found, count of the best, the best) for one key; the dicts give the words' counts by their inner parts."""
    machine, found = Machine(), {}
    head, tail = outside[:a], outside[a:]

    def better(x: str, y: str, n: int) -> None:
        seen, most, best = found.get(x, (0, 0, ""))
        found[x] = (seen + 1, n, y) if (-n, y) < (-most, best) else (seen + 1, most, best)

    for x, y in machine.compose(machine.accept(sorted(short)), machine.accept(sorted(longer)), b == size):
        m, n = short[x], short[y] if len(x) == len(y) else longer[y]
        x, y = head + x + tail, head + y + tail
        better(x, y, n)
        better(y, x, m)
    return found


def _near(batches):
    """Rows come sorted by key; a key may cross batches."""
    key, parts = None, ({}, {})

    def done():
        if key is not None and len(parts[0]) + min(len(parts[1]), len(parts[0])) > 1:
            for word, (seen, most, best) in near_in_key(*key, *parts).items():
                rows.append((word, seen, most, best))

    def out():
        columns = list(zip(*rows)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "near_n", "near"])

    rows: list[tuple] = []
    for batch in batches:
        for size, a, b, outside, longer, inside, n in zip(*[c.to_pylist() for c in batch.columns]):
            if (size, a, b, outside) != key:
                done()
                key, parts = (size, a, b, outside), ({}, {})
            parts[longer][inside] = n
        yield out()
        rows = []
    done()
    yield out()


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, n_near, near, near_n): of each word (word, n) with near words their number, the most frequent one and its count."""
    keyed = windows(words, crowd).select(*KEY, "longer", "inside", "n")
    sorted_keys = keyed.repartition(*KEY).sortWithinPartitions(*KEY)
    found = arrow(sorted_keys, _near, "word string, n_near bigint, near_n bigint, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                     F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")).select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words (word, form) that have a form. Counts at least double along a chain, so pointer doubling ends
    after about as many rounds as the binary logarithm of a count's digits."""
    now = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        above = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        linked = staged(now.join(above, "root", "left"), "spelling-roots")
        if linked.where("next IS NOT NULL").isEmpty():
            return now
        now = linked.select("word", F.coalesce("next", "root").alias("root"))


def group_variants(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of a vocabulary (word, n)."""
    words = staged(words.select("word", "n"), "spelling-words")
    near = words.join(near_words(words, crowd), "word", "left")
    led = F.col("near_n") >= RATIO * F.col("n")
    formed = staged(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(led, F.col("near")).alias("form"),
                                F.when(led, F.col("near_n")).alias("form_n")), "spelling-forms")
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Every word of all documents that is long and frequent enough, with its form and root."""
    return group_variants(vocabulary(table(spark, sf_dir, "documents")))


#: Near words meet under what is left after one deletion; crc32 goes by bytes through a table made in the query.
OP13_SQL = r"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_prepend(i, [1, 2, 3, 4, 5, 6, 7, 8]),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
c AS (SELECT r.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
      string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda x: CASE WHEN ord(x) < 128
        THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(ord(x) - 64 AS BIGINT)] END))),
    lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) AS h FROM r, crc_table),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 97 = 0
      THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM c)
  GROUP BY 1 HAVING length(word) >= 5 AND sum(k) >= 3),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (SELECT x.word, y.word AS near FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT c.word, v.word FROM cut c JOIN v ON v.word = c.rest UNION SELECT v.word, c.word FROM cut c JOIN v ON v.word = c.rest),
best AS (SELECT p.word, count(*) AS n_near, min({'m': -b.n, 'near': p.near}) AS best FROM pairs p JOIN v b ON b.word = p.near GROUP BY 1),
f AS (SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN -best.best.m >= 2 * v.n THEN best.best.near END AS form,
  CASE WHEN -best.best.m >= 2 * v.n THEN CAST(-best.best.m AS BIGINT) END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
up(word, root) AS (SELECT word, word FROM f WHERE form IS NULL UNION ALL SELECT f.word, up.root FROM f JOIN up ON f.form = up.word)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word
"""
