"""Merkle manifest against a plain hash tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from latecomer.llm import merkle

from ..conftest import SF_SMALL

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    def one(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*[one(v) for v in (doc_id, source, lang, n_chars, text)])


def grow(nodes, arity):
    """(root, for each leaf its [(before, after)] from the bottom up)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // arity * arity
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + arity])))
        at = [i // arity for i in at]
        nodes = [H(*nodes[r:r + arity]) for r in range(0, len(nodes), arity)]
    return nodes[0], paths


def brute(rows, arity=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = grow([x[2] for x in groups[g]], arity)
    root, over = grow([trees[g][0] for g in names], arity) if names else (None, [])
    out = []
    for g, up in zip(names, over):
        for (_, _, h, r), path in zip(groups[g], trees[g][1]):
            path = path + up
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            acc = leaf(*r[:4], r[4] + 1) if hit else h
            for before, after in path:
                acc = H(before, acc, after)
            out.append((r[0], h, trees[g][0], root, H(*[x for s in path for x in s]), acc, acc == root))
    return sorted(out, key=str)


def digest(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("path")), 256), "folded_root", "verified").collect()),
        key=str)


def more():
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return {"n_chars": F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))}


def test_query_matches_plain_tree(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet")
            .select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = sorted((tuple(r) for r in merkle.op11_merkle_manifest(spark, SF_SMALL).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)
    want = brute(rows)
    assert got == want
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("arity", [2, 3])
def test_odd_rows(spark, frame, arity):
    """NULLs in any column, '' beside NULL, repeated rows, one id with several texts, lone groups, other columns."""
    draw = random.Random(arity)
    rows = [(draw.choice([None, *range(40)]), draw.choice([None, "", "é\n", "x" * 3000, "a"]),
             draw.choice([None, "", "en", "en", "en", "de", "É", "Z"]), draw.choice([None, "", "s"]),
             draw.choice([None, -1, 0, 9223372036854775807])) for _ in range(90)] + [(5, "t", "lone", "s", 1)]
    docs = frame(rows, COLUMNS).withColumns({c: F.lit("x") for c in ("g", "i", "h", "m", "leaf", "path", "tampered")})
    assert digest(merkle.manifest(docs, arity, more())) == brute(rows, arity)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, frame, n):
    rows = [(7 * k, "t", None if k == 1 else "en", "s", 1) for k in range(n)]
    assert digest(merkle.manifest(frame(rows, COLUMNS), 2, more())) == brute(rows)


def test_one_group_of_equal_rows(spark, frame):
    rows = [(1, "same", "en", "s", 4)] * 70 + [(2, "other", "en", "s", 5)]
    assert digest(merkle.manifest(frame(rows, COLUMNS), 2, more())) == brute(rows)


def test_any_change_is_seen(spark, frame):
    rows = [(k, f"text {k}", "en", "s", 6) for k in range(33)]
    out = merkle.manifest(frame(rows, COLUMNS), 2, {"text": F.when(F.col("doc_id") == 20, "text 2O").otherwise(F.col("text"))})
    assert [r.doc_id for r in out.where("NOT verified").collect()] == [20]
