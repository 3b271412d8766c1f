"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from latecomer.llm import spelling


def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    k = 0
    while k < len(x) and x[k] == y[k]:
        k += 1
    return x[k + 1:] == y[k + 1:] if len(x) == len(y) else x[k:] == y[k + 1:]


def brute_groups(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def brute_words(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def grouped(df, crowd=spelling.CROWD):
    return sorted(tuple(r) for r in spelling.group_variants(df, crowd).collect())


def random_words(draw, n, letters, lengths):
    words = {}
    while len(words) < n:
        words["".join(draw.choice(letters) for _ in range(draw.choice(lengths)))] = draw.choice((3, 4, 6, 7, 30, 61, 200))
    return words


@pytest.mark.parametrize("crowd", [4096, 3])
def test_dense_words_against_all_pairs(spark, crowd):
    """Words over two letters have many near words and many places for one insertion; a small ``crowd`` halves windows often."""
    words = random_words(random.Random(crowd), 150, "aé", (5, 6, 7, 8, 9))
    assert grouped(spark.createDataFrame(sorted(words.items()), "word string, n bigint"), crowd) == brute_groups(words)


def test_hot_beginning_and_long_words(spark):
    """A third of all words share their first half; very long words need no recursion."""
    draw = random.Random(5)
    words = random_words(draw, 120, "abcdefgh", (5, 6, 7))
    words |= {"prefix" + w: 3 + k % 9 for k, w in enumerate(random_words(draw, 100, "abc", (5, 6)))}
    long = "lang" * 3000
    words |= {long: 50, long[:6000] + long[6001:]: 9, long + "x": 4, "x" + long: 4, long[:-1] + "é": 3, long[:11000] + "!": 3}
    words.pop(long[:11000] + "!")
    assert grouped(spark.createDataFrame(sorted(words.items()), "word string, n bigint"), 16) == brute_groups(words)


def test_no_key_stays_crowded(spark):
    words = {"same" + a + b + "tail": 3 for a in "abcdefghij" for b in "abcdefghij"}
    keyed = spelling.windows(spark.createDataFrame(sorted(words.items()), "word string, n bigint"), 10)
    assert keyed.groupBy(*spelling.KEY).count().where("count > 10 AND b - a > 1").isEmpty()


def test_words_of_texts(spark, frame):
    draw = random.Random(2)
    pool = [*"Über straße Strasse naïve NAÏVE naive coöp house houses hause tree3tree mäuse".split(), "×÷×÷×", "É" * 6, "hoúse"]
    rows = [(draw.choice([None, 0, -5, *range(60)]), " ".join(draw.choices(pool, k=40))) for _ in range(60)]
    rows += [(3, None), (4, ""), (None, None), (5, " 12 "), rows[0], rows[0]]
    found = {r.word: r.n for r in spelling.vocabulary(frame(rows)).collect()}
    want = brute_words(rows)
    assert found == want
    got = sorted(tuple(r) for r in spelling.group_variants(spelling.vocabulary(frame(rows))).collect())
    assert got == brute_groups(want) and len(got) > 10


def test_empty_tables(spark, frame):
    assert spelling.group_variants(spelling.vocabulary(frame([]))).collect() == []
    assert spelling.group_variants(spelling.vocabulary(frame([(1, None), (2, "a b c")]))).collect() == []
