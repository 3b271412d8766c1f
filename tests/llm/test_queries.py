"""Queries of the subpackage: DuckDB twins on the given tables, and the whole pipeline against plain Python."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
import corpus_pipeline
from latecomer.llm import registry

from ..conftest import SF_SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _text(v):
    """A NULL is one value, and a long one text, whatever pandas makes of a column that holds NULLs."""
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return "NULL"
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def _rows(pdf):
    return sorted(tuple(map(_text, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


def test_all_are_registered():
    names = E.queries()
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 1 + len(registry.QUERIES))}
    assert set(registry.QUERIES) | {"pipeline"} <= set(names)
    assert set(registry.ORACLE) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_duckdb(spark, duck, name):
    got = registry.QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck.execute(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_stage_names_and_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe_tokens"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SF_SMALL).schema.names == docs.schema.names


def test_pipeline_matches_plain_python(spark):
    """Each stage redone without Spark (quality verdicts come from their own SQL-checked operator)."""
    from tokenizers import Tokenizer

    from latecomer.llm import bpe, decontaminate, quality, simhash
    from .test_lines import brute_removed
    from .test_simhash import brute_components

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = {r.doc_id for r in quality.measure(docs, ["doc_id"]).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    gone = brute_removed(sorted(texts.items()))
    texts = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts.items()}
    component = brute_components([(i, simhash.simhash(t.encode())) for i, t in texts.items()])
    texts = {i: t for i, t in texts.items() if component[i] == i}
    items = [(r.item_id, decontaminate.words(r.text.encode())) for r in
             spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    automaton = decontaminate.Automaton(items)
    clean = {}
    for i, t in texts.items():
        ws = decontaminate.words(t.encode())
        spans = automaton.search(ws).spans
        if sum(b - a for a, b in spans) <= decontaminate.MAX_COVERAGE * len(ws):
            clean[i] = decontaminate.cut(t.encode(), spans).decode()
    tokenizer = Tokenizer.from_file(bpe.word_tokenizer())
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in clean.items()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert set(got) == set(want) and len(want) < docs.count()
    for i, ids in want.items():
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == tokenizer.decode(ids, skip_special_tokens=False)
