"""Columns whose names are used inside the operators, and op5 on long conversations against its SQL."""

import random

import duckdb
import pytest

from latecomer.llm import chat, lines, quality, simhash

from .test_lines import brute_removed

CLASHING = ("__id", "__key", "__text_key", "__removed", "removed", "lost_id", "text_hash", "head_id", "key", "id", "no",
            "__of", "__group", "__text", "__units", "n_words", "lang")


@pytest.fixture()
def clashing(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        return df.selectExpr("*", *[f"concat('{c}', coalesce(doc_id, 0)) AS `{c}`" for c in CLASHING], "1 AS `a.b`")
    return make


def _columns_kept(rows):
    return all(r[c] == f"{c}{r.doc_id or 0}" for r in rows for c in CLASHING)


def test_line_dedup_keeps_clashing_columns(clashing):
    docs = [(1, "a b c d e\nother words here"), (2, "new line of text\na b c d e"), (3, None), (4, "")]
    df = clashing(docs)
    out = lines.remove_later_lines(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert brute_removed(docs) == {(2, 1)}
    assert {r.doc_id: r.text for r in rows} == dict(docs) | {2: "new line of text"} and _columns_kept(rows)


def test_simhash_keeps_clashing_columns(clashing):
    text = " ".join(f"word{i}" for i in range(80))
    df = clashing([(1, text), (2, text), (3, "quite another text with other words"), (3, "quite another text with other words")])
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == [1, 3] and _columns_kept(rows)


def test_quality_keeps_clashing_columns(clashing):
    rng = random.Random(3)
    df = clashing([(i, " ".join(rng.choices([f"w{k}" for k in range(300)], k=60))) for i in range(6)] + [(9, "short")])
    out = quality.keep(df, lang_col="__of")
    assert out.columns == df.columns
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(6)) and _columns_kept(rows)


def test_long_conversations_match_the_sql(spark, folder):
    rng = random.Random(5)
    rows = []
    for c in range(12):
        for t in range(120 if c < 2 else rng.randrange(1, 30)):
            role = "system" if t == 5 and c == 0 else ("user", "assistant")[t % 2]
            if rng.random() > 0.04:
                rows.append((c, t, role, None if rng.random() < 0.05 else f"text {rng.randrange(10**6)}"))
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    got = chat.op5_chat_tool_calls(spark, folder(conversations=df)).toPandas()
    con = duckdb.connect()
    con.register("conversations", df.toPandas().assign(text=lambda p: p["text"].where(p["text"].notna(), None)))
    want = con.execute(chat.OP5_SQL).df()

    def plain(p):
        return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in p[sorted(p.columns)].itertuples(index=False))

    assert plain(got) == plain(want)
    # whole chains, cycles, repeated identifiers and each kind of error are among them
    assert got["depth"].max() > 10 and (got["depth"] == -1).any()
    assert {"duplicate", "linked", "orphan", "pending", "text"} <= set(got["status"])
    found = ",".join(got["errors"])
    for error in ("unknown tool", "unknown argument", "not integer", "not a JSON object", ": missing", "parent: missing", "parent: cycle"):
        assert error in found
