"""Licenses with a block of words put in or left out, as far as 80 % of the template and of the span allow."""

import random

import numpy as np
import pytest

from latecomer.llm import licenses
from latecomer.llm.decontaminate import words
from latecomer.llm.license_templates import MIT, TEMPLATES


def unbanded(template, text):
    """Most words in order, by the plain table."""
    row = [0] * (len(text) + 1)
    for word in template:
        new = [0]
        for j, other in enumerate(text):
            new.append(max(row[j + 1], new[j], row[j] + (word == other)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edit", [*range(5, 41, 5), 13, -5, -10, -13, -20, -30, -32])
def test_block_edits_are_found(edit):
    index, whole = licenses.Index(TEMPLATES), [w.decode() for w in words(MIT.encode())]
    size = len(whole)
    for part in range(1, 10):
        at = len(whole) * part // 10
        if edit < 0 and at - edit > len(whole):
            continue
        text = whole[:at] + [f"new{i}" for i in range(edit)] + whole[at + max(0, -edit):]
        padded = " ".join(["lorem ipsum"] * 30 + text + ["dolor sit"] * 30)
        inner = words(" ".join(text).encode())
        want = unbanded(words(MIT.encode()), inner)
        got = [m for m in index.matches(padded.encode()) if TEMPLATES[m[0]][0] == "MIT"]
        assert want >= licenses.MIN_COVERAGE * max(size, len(inner))
        assert [(n, a, b) for _, n, a, b in got] == [(want, 60, 60 + len(inner))]


def test_window_alignment_matches_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        template, text = rng.choices(range(4), k=rng.randint(1, 9)), rng.choices(range(5), k=rng.randint(1, 12))
        n, a, b = licenses.align_window(np.array(template), np.array(text), 0.5)
        if n:
            assert n <= unbanded(template, text[a:b]) and n >= 0.5 * max(len(template), b - a)
        else:
            assert unbanded(template, text) < 0.5 * max(len(template), len(text))
