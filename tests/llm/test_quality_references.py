"""References of op8 when one group of copies holds a third of all rows."""

import random

import pytest

from latecomer.llm import quality


def _clean(rng, n):
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    return [(i, "en", " ".join(rng.choices(vocabulary, weights=[1 / (r + 1) for r in range(400)], k=220)))
            for i in range(n)]


@pytest.mark.parametrize("kind", ["short copies", "copies", "near copies"])
def test_a_third_of_odd_copies_rejects_no_clean_document(spark, kind):
    rng = random.Random(8)
    clean = _clean(rng, 120)
    odd = [f"ZZ{i}#{i * 7919}" for i in range(20 if kind == "short copies" else 220)]
    rows = list(clean)
    for i in range(60):
        words = list(odd)
        if kind == "near copies":
            words[rng.randrange(220)] = f"edit{i}"
        # short copies fail the base rules, repeated to the words of a clean document
        rows.append((1000 + i, "en", " ".join(words * (11 if kind == "short copies" else 1))))
    def kept(rows):
        df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
        return {r.doc_id for r in quality.measure(df, ["doc_id"]).where("kept").collect()}

    alone = kept(clean)
    assert len(alone) == len(clean)
    assert {i for i in kept(rows) if i < 1000} == alone
