"""Line dedup: exact set-similarity join of lines, later matches removed.

A line is the set of its words. It is removed if an earlier line (by document id, text hash and line number) has
a Jaccard similarity of ``THRESHOLD`` or more. Lines without words stay. Matches are judged on the input.

1. **Order.** Words are ordered by rarity: occurrences counted over all documents in a table of ``CELLS`` hash cells (a
   rare word seems as frequent as the words of its cell), then by hash. The join is exact under any one order; rare words
   first make it fast.
2. **Distinct sets.** Equal sets meet in one aggregate; the first line stands for the set, the others are removed.
   Sets are numbered in the order of their first lines.
3. **Prefix, length and positional filters.** Two sets of sizes ``n`` and ``m`` with ``n >= m`` match only if ``m >= t*n``, if
   they share a word among their first ``n - ceil(t*n) + 1`` (fewer for sets of like size), and if what is left around the
   shared word is long enough. Parities of ``CLASSES`` word classes bound the number of different words from below. That many
   say little of two long sets (at 112 words each, 24 may differ, and 32 do in a chance pair), so pairs of sets with more words
   than classes are held against the parities of as many classes as they have words, before their words are read again.
4. **Verify.** The words of the remaining lines are read again (a fixed-size bitmap leaves most lines out of that
   shuffle; it doesn't decide) and the Jaccard similarity is computed: first of each set's likeliest pair, then of all other
   pairs of the sets that it didn't settle. Pairs of too many words for the disk are verified in parts, one after the other.

Crowded prefix words (more than ``CROWDED`` sets): their sets are first compared with the ``LEADERS`` earliest
sets of the word. A set with a match is settled (one earlier match is enough); the others are compared with all earlier
sets. So a large group of near copies isn't expanded to pairs.

Everything is DataFrame expressions. Words are told apart by 63-bit hashes, sets by 64-bit hashes.

Cases: NULL text has no lines; a line of white space stays; rows with the same id and text are one document (each copy
gets the same lines removed); NULL ids come first; an empty table gives an empty result; other columns are kept by
:func:`remove_later_lines`.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import release
from .common import SPACE, positional, staged, staged_at, table, text_key, words_of

THRESHOLD = 0.8
CROWDED = 256
LEADERS = 8
#: The prefix words are compared in so many parts by their hash, one after the other: each part's shuffle is deleted before the next.
PASSES = 4
#: Cells of the frequency table.
CELLS = 1 << 18
#: Word classes whose parities are carried with every prefix word: the bits of a long.
CLASSES = 64
#: Longs of a set's own parities, at most.
LONGS = 256
#: Pairs verified at a time hold so many words, or the ``SHARE``-th part of the words of all sets, if those are more.
WORDS = 1 << 24
SHARE = 4
#: Words of the bitmap; 64 lines share a word.
_MAP_WORDS = 1 << 18


def rarity(docs: DataFrame, text_col: str) -> bytes:
    """Frequency level (0 is rarest, quarter powers of two) of each hash cell, counted over all words."""
    words = docs.select(F.explode_outer(words_of(F.col(text_col))).alias("w")).where("w IS NOT NULL")
    # staged, as the shuffle of a table that is iterated stays until the session ends
    counts, path = staged_at(words.groupBy(F.pmod(F.xxhash64("w"), F.lit(CELLS)).cast("int").alias("cell")).agg(
        F.count("*").alias("n")), "lines-cells")
    levels = bytearray(CELLS)
    for row in counts.toLocalIterator():                    # at most CELLS rows, whatever the input
        levels[row["cell"]] = min(127, int(4 * math.log2(row["n"])))
    release(path, docs.sparkSession)
    return bytes(levels)


def _tokens(line: Column, levels: bytes) -> Column:
    """Sorted set of word codes: 7 bits of frequency, then 56 bits of hash."""
    table = F.lit(levels)

    def code(h):
        level = F.ascii(F.substring(table, (F.pmod(h, F.lit(CELLS)) + 1).cast("int"), F.lit(1)).cast("string"))
        return F.shiftleft(level.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    hashes = F.transform(words_of(line), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_distinct(F.transform(hashes, code)))


def _parity(tokens: Column) -> Column:
    """``CLASSES`` parity bits of a set: two sets differ in at least as many words as their parities in bits."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(v, F.lit(CLASSES)).cast("int"))))


def _parities(tokens: Column, n: Column) -> Column:
    """Parity bits of a set in at least as many classes as it has words (up to ``LONGS`` longs). The longs are a power of two in
    number, so that those of a larger number, XORed, are those of a smaller one."""
    longs = F.least(F.pow(F.lit(2), F.ceil(F.log2(n / F.lit(CLASSES)))), F.lit(LONGS)).cast("int")
    split = F.transform(F.sequence(F.lit(0), longs - 1), lambda k: _parity(F.filter(
        tokens, lambda v: F.pmod(F.shiftright(v, 6), longs) == k)))
    return F.when(n <= CLASSES, F.array(_parity(tokens))).otherwise(split)


def _xor(longs: Column) -> Column:
    return F.aggregate(longs, F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v))


def _differ(a: Column, b: Column) -> Column:
    """In how many parities two sets differ, in the classes of the one that has fewer."""
    longs = F.least(F.size(a), F.size(b))

    def at(bits, k):
        return F.when(F.size(bits) == longs, bits[k]).otherwise(_xor(F.filter(bits, lambda v, i: F.pmod(i, longs) == k)))

    return F.aggregate(F.sequence(F.lit(0), longs - 1), F.lit(0),
                       lambda sum_, k: sum_ + F.bit_count(at(a, k).bitwiseXOR(at(b, k))))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # the key first, else every line would carry its whole text
    split = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"),
                        F.split(F.col(text_col), "\n").alias("lines"))
    # the outer form: the inner one would evaluate the split again in a filter of its own
    lines = split.select("id", "key", F.posexplode_outer("lines").alias("line_no", "line"))
    return lines.where(F.col("line").rlike(f"[^{SPACE}]"))


def _overlap(n: Column, m: Column, t: float) -> Column:
    """Least overlap of sets of sizes n and m at Jaccard t."""
    return F.ceil(F.lit(t / (1 + t)) * (n + m) - F.lit(1e-9))


def _prefix(n: Column, t: float) -> Column:
    return (n - F.ceil(F.lit(t) * n - F.lit(1e-9)) + 1).cast("int")


def _pairs(probe: DataFrame, index: DataFrame, t: float) -> DataFrame:
    """(x, y) rows, y earlier, that pass the length, positional and parity filters (a row for each shared word), the
    parities in which they differ, and the words of x."""
    x = probe.select("tok", F.col("no").alias("x"), F.col("n").alias("xn"), F.col("i").alias("xi"), F.col("bits").alias("xb"))
    y = index.select("tok", F.col("no").alias("y"), F.col("n").alias("yn"), F.col("i").alias("yi"), F.col("bits").alias("yb"))
    xn, yn, need = F.col("xn"), F.col("yn"), _overlap(F.col("xn"), F.col("yn"), t)
    # both sets have at most ``need`` words after their pair's prefixes
    in_prefix = (F.col("xi") <= xn - need) & (F.col("yi") <= yn - need)
    bound = F.least("xi", "yi") + F.least(xn - F.col("xi"), yn - F.col("yi"))
    differ = F.bit_count(F.col("xb").bitwiseXOR(F.col("yb")))
    return x.join(y, (x.tok == y.tok) & (F.col("y") < F.col("x")) & (F.least(xn, yn) >= F.lit(t) * F.greatest(xn, yn))
                  & in_prefix & (bound >= need) & (differ <= xn + yn - 2 * need)).select("x", "y", differ.alias("differ"), xn.alias("words"))


def _met(words: DataFrame, t: float, crowded: int, leaders: int) -> DataFrame:
    """The pairs of these prefix words' sets, and the rows of crowded words (they have a token, pairs don't)."""
    word = Window.partitionBy("tok")
    rows = (words.withColumn("met", F.count("*").over(word)).withColumn("rank", F.row_number().over(word.orderBy("no")))
            .where("met > 1"))
    is_crowded = F.col("met") > crowded
    held = [F.lit(None).cast(kind).alias(name) for name, kind in
            (("tok", "int"), ("i", "int"), ("bits", "long"), ("rank", "int"))]
    # a word's first set has no earlier one
    pairs = _pairs(rows.where("rank > 1"), rows.where(~is_crowded | (F.col("rank") <= leaders)), t).distinct()
    return staged(pairs.select("x", "y", "differ", "words", *held).union(rows.where(is_crowded).select(
        "no", F.lit(None), F.lit(None), "n", "tok", "i", "bits", "rank")), "lines-found")


def _likely(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """The pairs that all parities of their sets allow, and in how many those differ. Sets of few words have no others than
    :func:`_pairs` has seen."""
    def long_sets(no):
        return sets.where(F.col("n") > CLASSES).select(F.col("no").alias(no), F.col("n").alias(f"{no}n"),
                                                       F.col("parities").alias(f"{no}b"))

    both = pairs.join(long_sets("x"), "x", "left").join(long_sets("y"), "y", "left")
    xn, yn = F.col("xn"), F.col("yn")
    seen = both.withColumn("full", F.when(xn.isNotNull() & yn.isNotNull(), _differ(F.col("xb"), F.col("yb"))))
    return seen.where(F.col("full").isNull() | (F.col("full") <= xn + yn - 2 * _overlap(xn, yn, t))).select(
        "x", "y", F.coalesce("full", "differ").alias("differ"), "words")


def _verified(docs: DataFrame, id_col: str, text_col: str, sets: DataFrame, pairs: DataFrame, levels: bytes,
              t: float) -> DataFrame:
    """:func:`_verify` in parts of the pairs: the words that are read again and sent for one part follow the input, however many
    pairs there are."""
    words, all_words = pairs.agg(F.sum("words")).first()[0] or 0, sets.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-words // max(WORDS, all_words // SHARE)))
    part = F.pmod(F.xxhash64("x"), F.lit(parts))
    return reduce(DataFrame.union, [_verify(docs, id_col, text_col, sets, pairs.where(part == k) if parts > 1 else pairs,
                                            levels, t) for k in range(parts)])


def _verify(docs: DataFrame, id_col: str, text_col: str, sets: DataFrame, pairs: DataFrame, levels: bytes,
            t: float) -> DataFrame:
    """The numbers of the sets x that match an earlier set y."""
    spark = docs.sparkSession
    wanted, wanted_path = staged_at(pairs.select(F.col("x").alias("no")).union(pairs.select(F.col("y").alias("no"))).distinct()
                                    .join(sets, "no").select("no", "id", "key", "line_no"), "lines-wanted")
    place = F.xxhash64("key", "line_no")
    cell, bit = F.pmod(F.shiftright(place, 6), F.lit(_MAP_WORDS)), F.pmod(place, F.lit(64)).cast("int")
    bitmap, bitmap_path = staged_at(wanted.groupBy(cell.alias("cell")).agg(F.bit_or(F.expr(
        "shiftleft(1L, cast(pmod(xxhash64(key, line_no), 64) as int))")).alias("bits")), "lines-bitmap")
    near = (_lines(docs, id_col, text_col).withColumn("cell", cell).withColumn("bit", bit)
            .join(F.broadcast(bitmap), "cell")              # 2**18 rows at most
            .where(F.expr("getbit(bits, bit) = 1")).select("id", "key", "line_no", "line"))
    found = near.join(wanted, near.id.eqNullSafe(wanted.id) & (near.key == wanted.key)
                      & (near.line_no == wanted.line_no)).select("no", _tokens(F.col("line"), levels).alias("tokens"))
    tokens, tokens_path = staged_at(found, "lines-tokens")

    def matched(asked):
        both = (asked.join(tokens.select(F.col("no").alias("x"), F.col("tokens").alias("xt")), "x")
                .join(tokens.select(F.col("no").alias("y"), F.col("tokens").alias("yt")), "y"))
        shared = F.size(F.array_intersect("xt", "yt"))
        return staged(both.where(shared >= F.lit(t) * (F.size("xt") + F.size("yt") - shared) - F.lit(1e-9))
                      .select("x").distinct(), "lines-removed")

    # one match is enough: most sets have one in their likeliest pair, and the words of their other pairs aren't sent
    likeliest, likeliest_path = staged_at(pairs.groupBy("x").agg(
        F.min(F.struct("differ", "y")).getField("y").alias("y")), "lines-likeliest")
    removed = matched(likeliest)
    left, left_path = staged_at(pairs.select("x", "y").join(removed, "x", "left_anti").join(likeliest, ["x", "y"], "left_anti"),
                                "lines-left")
    if not left.isEmpty():
        removed = removed.union(matched(left))
    for path in (wanted_path, bitmap_path, tokens_path, likeliest_path, left_path):
        release(path, spark)
    return removed


def later_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                  crowded: int = CROWDED, leaders: int = LEADERS) -> DataFrame:
    """(id, key, removed): for documents that lose lines, the sorted numbers (from 0) of those lines."""
    t = threshold
    levels = rarity(docs, text_col)
    coded = (_lines(docs, id_col, text_col).withColumn("tokens", _tokens(F.col("line"), levels))
             .withColumn("n", F.size("tokens")))
    lines = staged(coded.select("id", "key", "line_no", F.xxhash64("tokens").alias("sig"), "n",
                                _parities(F.col("tokens"), F.col("n")).alias("parities"), F.transform(
        F.slice(F.col("tokens"), F.lit(1), _prefix(F.col("n"), t)), lambda v: F.hash(v)).alias("prefix")), "lines")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a set's first line, and what follows from the set itself
    firsts = lines.groupBy("sig").agg(F.min(F.struct("id", "key", "line_no", "n", "parities", "prefix")).alias("at"))
    firsts, firsts_path = staged_at(firsts.select("sig", "at.*"), "lines-firsts")
    ordered = firsts.repartitionByRange(parts, "id", "key", "line_no").sortWithinPartitions("id", "key", "line_no")
    # ascending over the range partitions: the order of first lines
    sets = staged(ordered.withColumn("no", F.monotonically_increasing_id()), "lines-sets")
    release(firsts_path, docs.sparkSession)
    words = sets.select("no", "n", _xor(F.col("parities")).alias("bits"), "prefix").select(
        "no", "n", "bits", F.posexplode("prefix").alias("i", "tok"))
    found = [_met(words.where(F.pmod("tok", F.lit(PASSES)) == k), t, crowded, leaders) for k in range(PASSES)]
    found = reduce(DataFrame.union, found)
    pairs = staged(_likely(found.where("tok IS NULL").select("x", "y", "differ", "words").distinct(), sets, t), "lines-pairs")
    removed = _verified(docs, id_col, text_col, sets, pairs, levels, t)
    crowd = found.where("tok IS NOT NULL").withColumnsRenamed({"x": "no", "words": "n"})
    unsettled = staged(crowd.where(F.col("rank") > leaders).join(removed.withColumnRenamed("x", "no"), "no", "left_anti"),
                       "lines-unsettled")
    if not unsettled.isEmpty():
        rest = _pairs(unsettled, crowd, t).distinct().join(pairs.select("x", "y"), ["x", "y"], "left_anti")
        rest = staged(_likely(rest, sets, t), "lines-rest")
        removed = removed.union(_verified(docs, id_col, text_col, sets, rest, levels, t)).distinct()
    f = sets.select("sig", F.col("id").alias("f_id"), F.col("key").alias("f_key"), F.col("line_no").alias("f_line"), "no")
    return _by_document(lines, f, removed)


def _by_document(lines: DataFrame, firsts: DataFrame, removed: DataFrame) -> DataFrame:
    marked = removed.select(F.col("x").alias("no"), F.lit(True).alias("matched"))
    state = firsts.join(marked, "no", "left").select("sig", "f_id", "f_key", "f_line", "matched")
    at_first = (F.col("id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key"))
                & (F.col("line_no") == F.col("f_line")))
    lost = lines.select("id", "key", "line_no", "sig").join(state, "sig").where(~at_first | F.col("matched").isNotNull())
    return lost.groupBy("id", "key").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def remove_later_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the lines that match earlier ones; all rows and columns are kept, whatever their names."""
    plain, names = positional(docs)
    of, body = names[id_col], names[text_col]
    lost = staged(later_matches(plain, of, body, threshold), "lines-lost").select(
        F.col("id").alias("lost_id"), F.col("key").alias("lost_key"), "removed")
    joined = plain.join(lost, F.col(of).eqNullSafe(F.col("lost_id")) & (text_key(F.col(body)) == F.col("lost_key")), "left")
    kept = F.array_join(F.filter(F.split(F.col(body), "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col(body)).otherwise(kept)
    return joined.select(*[(text if c == text_col else F.col(a)).alias(c) for c, a in names.items()])


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines and removed lines (numbers from 0, comma-joined) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lost = staged(later_matches(docs), "lines-lost")
    size = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.when(
        F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    joined = size.join(lost, size.doc_id.eqNullSafe(lost.id) & (size.text_key == lost.key), "left")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                         F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit(""))
                         .alias("removed_lines"))


#: Every pair of different sets that share a word, without filters on prefixes or positions.
OP6_SQL = r"""
WITH l AS (SELECT doc_id, row_number() OVER () AS r, string_split(text, chr(10)) AS a FROM documents),
e AS (SELECT doc_id, r, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS p FROM l),
s AS (SELECT doc_id, r, p, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS w FROM e),
k AS (SELECT doc_id, r, p, w, min((doc_id, p)) OVER (PARTITION BY w) AS f FROM s WHERE len(w) > 0),
u AS (SELECT w, f, len(w) AS n, row_number() OVER (ORDER BY f) AS no FROM (SELECT DISTINCT w, f FROM k)),
t AS (SELECT no, n, unnest(w) AS x FROM u),
df AS (SELECT x, count(*) AS c FROM t GROUP BY x),
-- a match shares at least one of the fifth (rounded up, and one) of its words that are rarest
o AS (SELECT no, n, x, row_number() OVER (PARTITION BY no ORDER BY c, x) AS i FROM t JOIN df USING (x)),
c AS (SELECT DISTINCT a.no AS x, b.no AS y FROM o a JOIN o b ON a.x = b.x AND b.no < a.no
    AND b.n >= 0.8 * a.n - 1e-9 AND a.n >= 0.8 * b.n - 1e-9
    WHERE a.i <= a.n - ceil(0.8 * a.n - 1e-9) + 1 AND b.i <= b.n - ceil(0.8 * b.n - 1e-9) + 1),
m AS (SELECT DISTINCT c.x AS no FROM c JOIN u a ON a.no = c.x JOIN u b ON b.no = c.y
    WHERE len(list_intersect(a.w, b.w)) >= 0.8 * (a.n + b.n - len(list_intersect(a.w, b.w))) - 1e-9),
g AS (SELECT k.r, k.p FROM k JOIN u ON k.w = u.w WHERE (k.doc_id, k.p) <> k.f OR u.no IN (SELECT no FROM m))
SELECT l.doc_id, CAST(coalesce(len(a), 0) AS BIGINT) AS n_lines, CAST(count(g.p) AS BIGINT) AS n_removed,
    coalesce(string_agg(g.p, ',' ORDER BY g.p), '') AS removed_lines
FROM l LEFT JOIN g USING (r) GROUP BY l.doc_id, l.r, coalesce(len(a), 0)
"""
