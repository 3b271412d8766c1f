"""Line dedup against all-pairs brute force."""

import random

import pytest

from latecomer.llm import lines as L


def brute_removed(docs, t=0.8):
    """{(id, line number)} of lines that match an earlier line; docs in order."""
    seen, gone = [], set()
    for i, text in docs:
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            words = set(line.encode().split())
            if not words:
                continue
            if any(len(words & w) >= t * len(words | w) - 1e-9 for w in seen):
                gone.add((i, k))
            seen.append(words)
    return gone


def _random_docs(seed, n):
    rng = random.Random(seed)
    vocab = [f"{'abcdefgh'[i % 8] * (1 + i % 7)}{i}" for i in range(80)]
    pool = [" ".join(rng.choices(vocab, k=rng.randint(1, 25))) for _ in range(25)]
    docs = []
    for i in range(n):
        out = []
        for _ in range(rng.randint(0, 8)):
            words = rng.choice(pool).split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append(" ".join(words) if rng.random() < 0.9 else " ")
        docs.append((i, "\n".join(out)))
    return docs


@pytest.mark.parametrize("crowded,leaders", [(64, 8), (2, 1), (0, 0)])
def test_matches_brute_force(spark, frame, crowded, leaders):
    docs = _random_docs(crowded + 1, 60)
    got = {(r.id, k) for r in L.later_matches(frame(docs), crowded=crowded, leaders=leaders).collect() for k in r.removed}
    want = brute_removed(docs)
    assert got == want and len(want) > 30


def test_texts_without_later_matches(spark, frame):
    docs = _random_docs(11, 40)
    df = frame([(i, t) for i, t in docs])
    out = L.remove_later_lines(df)
    assert out.columns == df.columns
    gone = brute_removed(docs)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}
    assert {r.doc_id: r.text for r in out.collect()} == want


def test_edge_cases(spark, frame, folder):
    long = "\n".join(f"line number {i} of many {i * 7}" for i in range(5000))
    rows = [(3, None), (1, ""), (2, "\n \n"), (5, "a b c d e"), (4, "e d c b a a"), (6, long), (7, long), (7, long),
            (None, "a b c d e\nfresh words here"), (8, "a b c d e f"), (9, "fresh words here\nfresh words here")]
    df = frame(rows)
    got = {(r.id, tuple(r.removed)) for r in L.later_matches(df).collect()}
    # the NULL id comes first; 5 of 6 words make 0.83
    assert {g for g in got if g[0] not in (6, 7)} == {(4, (0,)), (5, (0,)), (8, (0,)), (9, (0, 1))}
    assert next(g[1] for g in got if g[0] == 7) == tuple(range(5000))
    assert L.remove_later_lines(df).count() == len(rows)
    empty = df.limit(0)
    assert L.later_matches(empty).count() == 0 and L.remove_later_lines(empty).count() == 0
    query = L.op6_line_dedup(spark, folder(documents=df)).collect()
    assert len(query) == len(rows) and {r.n_lines for r in query if r.doc_id == 3} == {0}


def test_group_of_near_copies_isnt_expanded(spark, frame):
    """Many near copies of one line: all but the first few are settled by the leaders."""
    rng = random.Random(5)
    base = [f"rare{i}" for i in range(60)]
    docs = []
    for i in range(300):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(60)] = f"own{i}x{rng.randint(0, 9)}"
        docs.append((i, " ".join(words)))
    got = {(r.id, k) for r in L.later_matches(frame(docs)).collect() for k in r.removed}
    assert got == brute_removed(docs) == {(i, 0) for i in range(1, 300)}


def test_words_of_a_prefix_are_compared_in_parts(spark, frame, monkeypatch):
    """Each part holds words of its own, so only a part of the shuffle lies on disk at a time; together they are all words."""
    parts, pairs = [], L._pairs

    def spy(probe, index, t):
        parts.append({r.tok for r in probe.select("tok").distinct().collect()})
        return pairs(probe, index, t)

    monkeypatch.setattr(L, "_pairs", spy)
    docs = _random_docs(3, 60)
    got = {(r.id, k) for r in L.later_matches(frame(docs)).collect() for k in r.removed}
    assert len(parts) == L.PASSES and all(parts) and sum(map(len, parts)) == len(set().union(*parts))
    assert got == brute_removed(docs)


def test_other_pairs_of_a_set_whose_likeliest_fails(spark, frame, monkeypatch):
    """A pair that differs in fewest parities needn't match; the set's other pairs are then compared."""
    pairs = L._pairs

    def worst_first(probe, index, t):
        return pairs(probe, index, t).withColumn("differ", -L.F.col("differ"))

    monkeypatch.setattr(L, "_pairs", worst_first)
    docs = _random_docs(29, 80)
    got = {(r.id, k) for r in L.later_matches(frame(docs)).collect() for k in r.removed}
    assert got == brute_removed(docs)


def _long_docs(rng, sizes):
    """Lines of so many words of 1,200, each of which is in many lines; a third are near copies."""
    vocab, docs = [f"w{i}" for i in range(1200)], []
    for i, n in enumerate(sizes):
        words = rng.sample(vocab, n)
        if i % 3 == 2:
            words = docs[rng.randrange(i)][1].split()
            for k in range(rng.choice([1, 9, 10, 11, 12, 13, 14]) * len(words) // 100):
                words[k] = f"own{i}x{k}"
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
    return docs


def test_long_lines_that_only_share_words_arent_read_again(spark, frame, monkeypatch):
    """64 parities say little of two lines of 200 words; such chance pairs, whose number grows with the square of the input,
    are left out before the words of their lines are read and sent."""
    asked, verify = [], L._verify

    def spy(docs, id_col, text_col, sets, pairs, levels, t):
        asked.append(pairs.count())
        return verify(docs, id_col, text_col, sets, pairs, levels, t)

    monkeypatch.setattr(L, "_verify", spy)
    docs = _long_docs(random.Random(2), [200] * 90)
    want = brute_removed(docs)
    got = {(r.id, k) for r in L.later_matches(frame(docs)).collect() for k in r.removed}
    assert got == want and len(want) > 10
    assert sum(asked) < 150                                 # 18 here; 1,681 with 64 parities


def test_lines_of_many_sizes_keep_their_matches(spark, frame, monkeypatch):
    """Sets around the sizes at which the number of parities doubles, and beyond the most."""
    monkeypatch.setattr(L, "LONGS", 4)
    rng = random.Random(8)
    docs = _long_docs(rng, [rng.choice([60, 64, 70, 120, 128, 140, 250, 260, 300, 500, 530]) for _ in range(150)])
    got = {(r.id, k) for r in L.later_matches(frame(docs)).collect() for k in r.removed}
    assert got == brute_removed(docs) and len(got) > 20


@pytest.mark.parametrize("longs", [1, 2, 256])
def test_parities_differ_in_no_more_than_the_words_do(spark, monkeypatch, longs):
    monkeypatch.setattr(L, "LONGS", longs)
    rng = random.Random(longs)
    sets = [sorted(rng.sample(range(10_000_000), rng.choice([1, 60, 64, 65, 128, 129, 500, 700]))) for _ in range(20)]
    sets += [sorted(rng.sample(s, len(s) - len(s) // 10)) for s in sets]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, tokens array<bigint>")
    df = df.select("i", L._parities(L.F.col("tokens"), L.F.size("tokens")).alias("b")).localCheckpoint()
    both = df.crossJoin(df.toDF("j", "c")).select("i", "j", L._differ(L.F.col("b"), L.F.col("c")).alias("d")).collect()
    assert all(r.d <= len(set(sets[r.i]) ^ set(sets[r.j])) for r in both)
    assert len(both) == 1600 and max(r.d for r in both) > 25 and {r.d for r in both if r.i == r.j} == {0}


def test_pairs_of_too_many_words_are_verified_in_parts(spark, frame, monkeypatch):
    """Each part's words are read and sent alone; together the parts are all pairs, each set's in one part."""
    parts, verify = [], L._verify

    def spy(docs, id_col, text_col, sets, pairs, levels, t):
        parts.append({r.x for r in pairs.select("x").distinct().collect()})
        return verify(docs, id_col, text_col, sets, pairs, levels, t)

    monkeypatch.setattr(L, "_verify", spy)
    monkeypatch.setattr(L, "WORDS", 1)
    monkeypatch.setattr(L, "SHARE", 4)
    docs = _random_docs(3, 60)
    got = {(r.id, k) for r in L.later_matches(frame(docs)).collect() for k in r.removed}
    assert len(parts) > 2 and sum(map(len, parts)) == len(set().union(*parts))
    assert got == brute_removed(docs)


def test_the_pipelines_stage_reads_few_long_lines_again(spark, frame, monkeypatch):
    """Of long lines that only share words, no pair reaches the step that reads and sends their words."""
    import corpus_pipeline

    asked, verify = [], L._verify

    def spy(docs, id_col, text_col, sets, pairs, levels, t):
        asked.append(pairs.count())
        return verify(docs, id_col, text_col, sets, pairs, levels, t)

    monkeypatch.setattr(L, "_verify", spy)
    docs = _long_docs(random.Random(4), [180] * 80)
    gone = brute_removed(docs)
    out = corpus_pipeline.line_dedup(spark, frame(docs), None).collect()
    assert {r.doc_id: r.text for r in out} == {i: "" if (i, 0) in gone else text for i, text in docs}
    assert gone and sum(asked) < 130
