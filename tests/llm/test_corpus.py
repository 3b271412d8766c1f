"""Operators that compare documents: quality rules, substring dedup, tool calls."""

import hashlib
import json
import math
import random
import re
from collections import Counter

import pytest

from latecomer.llm import chat, quality, substring

WORD = re.compile("[^\x20\x09-\x0d]+")


# ---- quality ----

def brute_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    at = {p for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(at))


def test_counts_and_verdicts(spark, frame, folder):
    rng = random.Random(1)
    vocab = "the of and to a in it is".split() + [f"{a}{b}" for a in ("spring", "rain", "house") for b in "abcdefghijklmnopqrst"]
    prose = [(i, " ".join(rng.choices(vocab, weights=[6] * 8 + [2] * 60, k=rng.randint(220, 400))) + ".", "en")
             for i in range(40)]
    odd = [(50, None, "en"), (51, "", None), (52, " \t\n \r", "en"), (53, "a b c a b c a b", "en"),
           (54, "same same same " * 40, "en"), (55, "x#1 | y$2 | <z> & " * 40, "en"),
           (56, "\n".join(["one line here", "one line here", "", " ", "other"] * 3), "en"),
           (57, "The " + " ".join(f"long{i}" for i in range(5000)) + " long1 long2 long3", "en"),
           (58, " ".join(f"A{i} b c" for i in range(200)), None), (0, prose[0][1], "en"), (59, "é ü\x0bñ\x0cx", "fr")]
    rows = prose + odd
    df = frame(rows, "doc_id bigint, text string, lang string")
    got = quality.op8_quality_rules(spark, folder(documents=df)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
        by[r.doc_id] = r.kept
    assert not by[55] and not by[54]
    plain = quality.measure(frame(prose + odd[5:6], "doc_id bigint, text string, lang string"), ["doc_id"]).collect()
    assert {r.doc_id for r in plain if r.kept} == set(range(40))
    kept = quality.keep(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _, _ in rows if by[i])
    assert quality.measure(df.limit(0), ["doc_id"]).count() == 0 and quality.keep(df.limit(0)).count() == 0


def test_divergence_of_small_histograms(spark):
    row = spark.range(1).select(
        quality._distance(quality._shares(quality.F.array(*[quality.F.lit(x).cast("long") for x in (3, 1, 0)])),
                          quality._shares(quality.F.array(*[quality.F.lit(x).cast("long") for x in (1, 1, 2)]))).alias("d"),
        quality._distance(quality._shares(quality.F.array(quality.F.lit(2).cast("long"))),
                          quality._shares(quality.F.array(quality.F.lit(7).cast("long")))).alias("same")).first()
    p, q = (0.75, 0.25, 0), (0.25, 0.25, 0.5)
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
    assert abs(row.d - math.sqrt((half(p, q) + half(q, p)) / 2)) < 1e-12 and row.same == 0


# ---- substring ----

def brute_kept(rows, length):
    split = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[i:i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for (doc, _), w in zip(rows, split):
        gone = {p for i in range(len(w) - length + 1) if count[tuple(w[i:i + length])] > 1 for p in range(i, i + length)}
        out.append((doc, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("length,gram", [(6, 2), (6, 6), (5, 3)])
def test_repeats_match_brute_force(spark, frame, length, gram):
    rng = random.Random(length * gram)
    pool = [[rng.choice("abcd") + str(rng.randint(0, 9)) for _ in range(rng.randint(3, 30))] for _ in range(12)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(pool) if rng.random() < 0.6 else [f"own{i}x{rng.randint(0, 99)}" for _ in range(9)]
        rows.append((i, " ".join(words)))
    rows += [(200, "z z z z z z z z z z"), (201, rows[3][1]), (202, None), (203, "\n \t"), (None, rows[5][1]), (3, rows[3][1])]
    got = substring.repeats(frame(rows), length=length, gram=gram).collect()
    assert sorted((r.id or -1, r.n_words, r.n_removed, r.kept) for r in got) == sorted(
        (d or -1, n, k, t) for d, n, k, t in brute_kept(rows, length))
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_substring_query_with_long_texts(spark, frame, folder):
    rng = random.Random(9)
    long = [f"w{rng.randint(0, 10**6)}" for _ in range(30_000)]
    rows = [(1, " ".join(long)), (2, "start " + " ".join(long[100:150]) + " end"), (3, " ".join(long[200:234])),
            (4, " ".join(long)), (5, "nothing repeats here")]
    df = frame(rows)
    got = substring.op9_substring_dedup(spark, folder(documents=df)).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == {
        (d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_kept(rows, 35)}
    assert substring.repeats(df.limit(0)).count() == 0


# ---- tool calls ----

SCHEMA = ("conv_id string, turn int, kind string, call_id string, parent_id string, name string, arguments string, "
          "content string")


def test_links_order_errors_and_json(spark):
    rows = [("a", 0, "call", "x", None, "reply", '{"turn":1, "prompt":"h\\u00e9 \\"q\\""}', None),
            ("a", 1, "result", "x", None, None, None, "R"), ("a", 2, "result", "x", None, None, None, "R2"),
            ("a", 3, "call", "y", "x", "reply", '{"prompt":5}', None), ("a", 4, "call", "z", "q", "foo", "{}", None),
            ("a", 5, "call", "c1", "c2", "reply", "[1]", None), ("a", 6, "call", "c2", "c1", "reply", "bad", None),
            ("a", 7, "result", "nope", None, None, None, "o"), ("a", 9, "call", None, None, "reply", None, None),
            (None, 0, "call", "x", None, "reply", '{"prompt":"p","turn":2,"z":1}', None),
            ("b", 0, "text", None, None, "system", None, "hello"), ("b", 0, "text", None, None, "system", None, "hello"),
            ("b", 1, "other", "k", None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'s' AS status", "'h' AS head")
    got = {(r.conv_id, r.turn): r for r in chat.link(df, chat.TOOLS).collect()}
    state = {k: (r.status, r.depth, tuple(r.errors)) for k, r in got.items()}
    assert state == {
        ("a", 0): ("linked", 0, ()), ("a", 1): ("linked", 0, ()), ("a", 2): ("duplicate", 0, ()),
        ("a", 3): ("pending", 1, ("prompt: not string", "turn: missing")),
        ("a", 4): ("pending", 0, ("unknown tool", "parent: missing")),
        ("a", 5): ("pending", None, ("arguments: not a JSON object", "parent: cycle")),
        ("a", 6): ("pending", None, ("arguments: not a JSON object", "parent: cycle")),
        ("a", 7): ("orphan", None, ()), ("a", 9): ("no id", None, ("arguments: not a JSON object",)),
        (None, 0): ("pending", 0, ("unknown argument",)), ("b", 0): ("text", None, ()), ("b", 1): ("unknown kind", None, ())}
    whole = json.loads(got[("a", 0)].json)
    assert whole == {"arguments": {"prompt": 'hé "q"', "turn": 1}, "id": "x", "name": "reply", "result": "R", "type": "call"}
    assert got[("a", 0)].json == json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert chat.link(df, chat.TOOLS).count() == len(rows) and chat.link(df.limit(0), chat.TOOLS).count() == 0


def test_depth_of_long_chains(spark):
    rows = [("c", i, "call", f"k{i}", f"k{i - 1}" if i else None, "reply", "{}", None) for i in range(70)]
    got = {r.turn: r.depth for r in chat.link(spark.createDataFrame(rows, SCHEMA), chat.TOOLS).collect()}
    assert got == {i: i for i in range(70)}
