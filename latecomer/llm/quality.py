"""Quality rules: counts on words and lines, and divergence from language references.

References, by ``lang``: over the documents that pass the base rules, the shares of character classes (lower and upper
letters, digits, white space, sentence marks, symbols, the rest) and the shares of the ``TOP_WORDS`` commonest words and
of all others. A group of copies or near copies weighs as much as ``GROUP_SHARE`` of its language's documents at most, so
that no hot group becomes the reference. A document is compared to its language by the Jensen-Shannon distance (square root of the divergence in
bits). Short documents vary by chance, so a test counts from a minimum number of words only.

Everything is DataFrame expressions: one pass that turns every text into counts and its smallest window (stored beside the
text), counts of copies, one aggregate over all words, and joins with tables of one row a language.

Cases: NULL text has no words and fails the base rules (fewer than 50 words); NULL ``lang`` is a language of its own;
white-space texts have no words; equal rows get equal verdicts; ties among common words go by the word; an
empty table gives an empty result; other columns are kept by :func:`keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, positional, staged, table, words_of

TOP_WORDS = 30
#: Base rules (contract).
MIN_WORDS = 50
MAX_REPEATED = 0.5
#: Largest distances of characters and of common words, and the words from which each holds.
CHAR_DISTANCE, CHAR_MIN_WORDS = 0.30, 50
WORD_DISTANCE = ((100, 0.36), (200, 0.30))
#: Largest share of a language's documents that one group of copies weighs in its references (one document at least).
GROUP_SHARE = 0.001
#: Weights are whole numbers of this unit, so that no order of rows changes a reference (a long holds 10^14 characters
#: of a language).
UNIT = 1 << 16
#: Fixed by the contract.
SYMBOLS = "#*$%&|<>"
#: Sentence marks of the character classes.
MARKS = ".,;:?'\"()-!"
WHITE = " \t\n\x0b\f\r"
#: Up to this many different repeated windows are looked up by search, more by sorting; the result is the same.
_FEW = 32


def _length_without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def _windows(words: Column, n: Column) -> Column:
    """Hashes of the 3-word windows, from hashes of the words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    size = F.greatest(n - 2, F.lit(0))
    zipped = F.zip_with(F.slice(hashes, F.lit(1), size), F.slice(hashes, F.lit(2), size), lambda a, b: F.xxhash64(a, b))
    return F.zip_with(zipped, F.slice(hashes, F.lit(3), size), lambda ab, c: F.xxhash64(ab, c))


def crowded_groups(counts: DataFrame) -> DataFrame:
    """(lang, group, weight) of the groups of copies that would weigh more than a ``GROUP_SHARE`` of their language.

    A group is the documents of one smallest 3-word window: exact copies share it, near copies nearly always. There are
    at most 1 / ``GROUP_SHARE`` such groups a language, few enough to hand to every task.
    """
    group = F.when(F.col("n_words") >= MIN_WORDS, F.col("__group"))
    groups = (counts.groupBy(F.col("__of").alias("lang"), group.alias("group")).agg(F.count("*").alias("n"))
              .where("group IS NOT NULL"))
    totals = groups.groupBy("lang").agg(F.greatest(F.sum("n") * GROUP_SHARE, F.lit(1.0)).alias("most")).select(
        F.col("lang").alias("__total"), "most")
    return (groups.join(F.broadcast(totals), groups["lang"].eqNullSafe(totals["__total"])).where("n > most")
            .select(F.col("lang").alias("__crowd"), F.col("group").alias("__crowd_group"),
                    (F.col("most") / F.col("n")).alias("__weight")))


def _weighted(frame: DataFrame, crowded: DataFrame, lang: str, group: str) -> DataFrame:
    """``frame`` with the weight of every document in ``UNIT``s; the rows of ``crowded`` are few."""
    return (frame.join(F.broadcast(crowded), frame[lang].eqNullSafe(crowded["__crowd"])
                       & (frame[group] == crowded["__crowd_group"]), "left")
            .withColumn("__units", F.round(F.coalesce("__weight", F.lit(1.0)) * UNIT).cast("long"))
            .drop("__crowd", "__crowd_group", "__weight"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat_words > MAX_REPEATED * n_words)


def word_references(good: DataFrame, top: int = TOP_WORDS) -> DataFrame:
    """(lang, common, shares): the commonest words of each language and their shares, then the share of the rest."""
    # the outer form: the inner one would evaluate the split again in a filter of its own
    words = good.select(F.col("__of").alias("lang"), F.col("__units").alias("units"),
                        F.explode_outer(words_of(F.col("__text"))).alias("word")).where("word IS NOT NULL")
    counts = words.groupBy("lang", "word").agg(F.sum("units").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= top)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rows = (ranked.join(totals, ranked.lang.eqNullSafe(totals.lang)).groupBy(ranked.lang, "total")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "word", "n"))).alias("best")))     # ``top`` at most
    return rows.select("lang", F.col("best.word").alias("common"), F.concat(
        F.transform("best", lambda b: b.n / F.col("total")),
        F.array((F.col("total") - F.aggregate("best.n", F.lit(0).cast("long"), lambda a, n: a + n)) / F.col("total")),
    ).alias("shares"))


def repeated_words(words: Column, n: Column, frame: DataFrame, out: str, group: str) -> DataFrame:
    """``frame`` with the number of words in 3-word windows found twice or more in the text, and the smallest window."""
    frame = frame.withColumn("__windows", _windows(words, n))
    frame = frame.withColumn("__sorted", F.sort_array("__windows"))
    less = F.greatest(F.size("__sorted") - 1, F.lit(0))
    # the next one where it is equal, NULL elsewhere
    equal = F.zip_with(F.slice("__sorted", F.lit(1), less), F.slice("__sorted", F.lit(2), less),
                       lambda x, y: F.when(x == y, x))
    frame = frame.withColumn("__twice", F.array_distinct(F.array_compact(equal)))
    by_search = F.filter(F.transform("__windows", lambda h, i: F.when(F.array_contains("__twice", h), i).otherwise(-1)),
                         lambda i: i >= 0)
    pairs = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    by_sort = F.flatten(F.transform(F.filter(
        F.arrays_zip(F.slice(pairs, F.lit(1), less).alias("x"), F.slice(pairs, F.lit(2), less).alias("y")),
        lambda z: z["x"]["h"] == z["y"]["h"]), lambda z: F.array(z["x"]["i"], z["y"]["i"])))
    starts = F.when(F.size("__twice") <= _FEW, by_search).otherwise(by_sort)
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))
    return (frame.withColumn(out, F.when(F.size("__twice") == 0, 0).otherwise(covered).cast("long"))
            .withColumn(group, F.array_min("__windows")).drop("__windows", "__sorted", "__twice"))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    def half(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: (half(a, b) + half(b, a)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)
    return F.transform(counts, lambda n: F.when(total > 0, n / total).otherwise(F.lit(0.0)))


def _counted(docs: DataFrame, lang_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """Counts of every document, next to its text and the columns ``carry``: the one pass that makes windows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    frame = docs.select(*[F.col(c) for c in carry], F.col(lang_col).alias("__of"), text.alias("__text"),
                        words_of(F.col(text_col)).alias("__words"))
    body, ws = F.col("__text"), F.col("__words")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    frame = frame.withColumns({
        "n_words": F.size(ws).cast("long"), "__lines": lines,
        "__nonletters": F.regexp_replace(body, r"\p{L}+", ""),
        "__upper": F.length(F.regexp_replace(body, r"[^\p{Lu}]+", ""))})
    other = F.col("__nonletters")
    letters = F.length(body) - F.length(other)
    digits = F.length(other) - F.length(F.regexp_replace(other, r"\p{Nd}", ""))
    white, marks, symbols = (F.length(other) - _length_without(other, x) for x in (WHITE, MARKS, SYMBOLS))
    rest = F.length(other) - digits - white - marks - symbols
    frame = frame.withColumns({
        "word_chars": (F.length(body) - white).cast("long"), "n_symbols": symbols.cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__classes": F.array(*[x.cast("long") for x in (
            letters - F.col("__upper"), F.col("__upper"), digits, white, marks, symbols, rest)])})
    frame = repeated_words(ws, F.col("n_words").cast("int"), frame, "n_repeat_words", "__group")
    return frame.select(*carry, "__of", "__text", "__group", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "__classes")


def _word_distance(counts: DataFrame, words: DataFrame) -> DataFrame:
    """``counts`` with the distance of each document's common words to its language's."""
    words = words.select(F.col("lang").alias("__lang"), F.col("common").alias("__common"),
                         F.col("shares").alias("__word_shares"))
    frame = counts.join(F.broadcast(words), counts["__of"].eqNullSafe(words["__lang"]), "left").drop("__lang")
    met = F.filter(words_of(F.col("__text")), lambda w: F.array_contains("__common", w))
    frame = frame.withColumn("__met", met)
    common = F.transform("__common", lambda c: F.size("__met") - F.size(F.array_remove("__met", c)))
    frame = frame.withColumn("__counts", F.concat(common, F.array(F.col("n_words") - F.size("__met")))
                             .cast("array<bigint>"))
    return frame.withColumn("word_distance", F.when(F.col("n_words") > 0, _distance(
        _shares(F.col("__counts")), F.col("__word_shares")))).drop("__common", "__word_shares", "__met", "__counts")


def measure(docs: DataFrame, carry: list[str], lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``carry`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance,
    base_failed and kept for every document."""
    counts = staged(_counted(docs, lang_col, text_col, carry), "quality-counts", "zstd")
    crowded = staged(crowded_groups(counts), "quality-groups")
    size = 7
    n = F.col("n_words")
    failed = base_failed(n, F.col("n_repeat_words"))
    good = _weighted(counts.where(~failed), crowded, "__of", "__group")
    words = staged(word_references(good), "quality-words")
    sums = good.groupBy("__of").agg(*[F.sum(F.col("__classes")[i] * F.col("__units")).alias(f"s{i}")
                                      for i in range(size)])
    refs = sums.select(F.col("__of").alias("__ref"),
                       _shares(F.array(*[F.col(f"s{i}") for i in range(size)])).alias("__class_shares"))
    joined = _word_distance(counts, words).join(staged(refs, "quality-chars"),
                                                F.col("__of").eqNullSafe(F.col("__ref")), "left")
    odd = (n >= CHAR_MIN_WORDS) & (F.col("char_distance") > CHAR_DISTANCE)
    for least, most in WORD_DISTANCE:
        odd = odd | ((n >= least) & (F.col("word_distance") > most))
    return (joined.withColumn("char_distance", F.when(n > 0, _distance(_shares(F.col("__classes")),
                                                                       F.col("__class_shares"))))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~failed & ~F.coalesce(odd, F.lit(False)))
            .select(*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance",
                    "word_distance", "base_failed", "kept"))


def keep(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the rules reject; all columns are kept."""
    plain, names = positional(docs)
    found = measure(plain, list(names.values()), names[lang_col], names[text_col])
    return found.where("kept").select(*[F.col(a).alias(c) for c, a in names.items()])


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return measure(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Windows as strings, histograms by joins.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, lang, row_number() OVER () AS r, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flat AS (SELECT r, lang, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
cnt AS (SELECT lang, x, count(*) AS n FROM flat GROUP BY lang, x),
tot AS (SELECT lang, sum(n) AS total FROM cnt GROUP BY lang),
top AS (SELECT lang, x, n FROM cnt QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) <= 30),
shares AS (SELECT top.lang, x, n / total AS q FROM top JOIN tot ON top.lang IS NOT DISTINCT FROM tot.lang
    UNION ALL SELECT top.lang, NULL, (total - sum(n)) / total FROM top JOIN tot
    ON top.lang IS NOT DISTINCT FROM tot.lang GROUP BY top.lang, total),
met AS (SELECT flat.r, flat.x, count(*) AS n FROM flat JOIN top ON flat.lang IS NOT DISTINCT FROM top.lang AND flat.x = top.x
    GROUP BY flat.r, flat.x),
rest AS (SELECT d.r, len(d.w) - coalesce(sum(met.n), 0) AS n FROM d LEFT JOIN met USING (r) GROUP BY d.r, len(d.w)),
bins AS (SELECT d.r, len(d.w) AS size, s.q, coalesce(CASE WHEN s.x IS NULL THEN rest.n ELSE met.n END, 0) / len(d.w) AS p
    FROM d JOIN shares s ON d.lang IS NOT DISTINCT FROM s.lang JOIN rest ON rest.r = d.r
    LEFT JOIN met ON met.r = d.r AND met.x = s.x WHERE len(d.w) > 0),
wd AS (SELECT r, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS word_distance FROM bins GROUP BY r),
c0 AS (SELECT r, lang, t, regexp_replace(t, '\p{L}+', '', 'g') AS o, len(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS up FROM d),
c1 AS (SELECT r, lang, len(t) - len(o) - up AS k0, up AS k1, len(o) - len(regexp_replace(o, '\p{Nd}', '', 'g')) AS k2,
    len(o) - len(regexp_replace(o, '[\x20\x09-\x0D]', '', 'g')) AS k3,
    len(o) - len(regexp_replace(o, '[.,;:?''"()!-]', '', 'g')) AS k4,
    len(o) - len(regexp_replace(o, '[#*$%&|<>]', '', 'g')) AS k5, len(o) AS k FROM c0),
cl AS (SELECT r, lang, unnest([k0, k1, k2, k3, k4, k5, k - k2 - k3 - k4 - k5]) AS n, unnest([0, 1, 2, 3, 4, 5, 6]) AS c FROM c1),
cr AS (SELECT lang, c, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cl GROUP BY lang, c),
cp AS (SELECT cl.r, cl.n / sum(cl.n) OVER (PARTITION BY cl.r) AS p, cr.q FROM cl
    JOIN cr ON cl.lang IS NOT DISTINCT FROM cr.lang AND cl.c = cr.c),
cd AS (SELECT r, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS char_distance FROM cp GROUP BY r),
win AS (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS m FROM (SELECT r, p, x || ' ' || lead(x) OVER w || ' '
    || lead(x, 2) OVER w AS k FROM flat WINDOW w AS (PARTITION BY r ORDER BY p)) WHERE k IS NOT NULL),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS p FROM win WHERE m > 1) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(t) - c1.k3 AS BIGINT) AS word_chars,
    CAST(c1.k5 AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, word_distance, char_distance
    FROM d JOIN c1 USING (r) LEFT JOIN lines USING (r) LEFT JOIN rep USING (r) LEFT JOIN wd USING (r) LEFT JOIN cd USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (coalesce(n_words >= 50 AND char_distance > 0.30, false)
    OR coalesce(n_words >= 100 AND word_distance > 0.36, false)
    OR coalesce(n_words >= 200 AND word_distance > 0.30, false)) AS kept FROM v
"""
