"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates and documents are sequences of lower-cased words. Winnowing keeps, of every ``WINDOW`` neighbouring ``GRAM``-word
grams, the one with the smallest hash; two texts that share ``GRAM + WINDOW - 1`` words in a row share a fingerprint.
An inverted index maps fingerprints to (template, position). Hits of a template on nearby diagonals (document
position less template position) are one candidate, which is aligned in a band around its diagonal: the most
template words matched in order. Blocks of inserted or left-out words move the diagonal out of the band; so the hits
within all diagonals that one match can have (:func:`reach`) are candidates too, aligned without a band in the window
that holds every such match, unless its words can't cover the template in any order. A match covers ``MIN_COVERAGE`` of the template and of its own span at least.

The templates are a parameter of at most ``MAX_TEMPLATE_WORDS`` words; the documents aren't shuffled. Only grams of
template words can be fingerprints of the index, so other grams aren't hashed.

Cases: NULL and empty texts have no match; a template is reported for each place where it matches; where candidates of a
template overlap, the best one stays (the shortest, then the first on ties); repeated rows are equal; an empty table gives an
empty result; other columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, table
from .decontaminate import words
from .license_templates import TEMPLATES

GRAM = 3
WINDOW = 2
BAND = 12
MIN_COVERAGE = 0.8
MAX_TEMPLATE_WORDS = 200_000


def align(template: list[int], text: list[int], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Most template words matched in order within the band: (matched, first word, end word) in ``text``."""
    width = 2 * band + 1
    none = (0, 0, 0)
    above: list[tuple[int, int, int]] = [none] * (width + 1)
    for i, word in enumerate(template):
        row: list[tuple[int, int, int]] = []
        left = none
        base = i + diagonal - band
        for k in range(width):
            best = max(above[k + 1], left, key=_better)          # skip a template word, skip a text word
            j = base + k
            if 0 <= j < len(text) and text[j] == word:
                n, a, _ = above[k]
                best = max(best, (n + 1, a if n else j, j + 1), key=_better)
            elif above[k][0] > best[0]:
                best = above[k]
            row.append(best)
            left = best
        row.append(none)
        above = row
    return max(above, key=_better)


def _better(cell: tuple[int, int, int]):
    return cell[0], cell[1] - cell[2]                              # most words, then the shortest span


def reach(words: int, min_coverage: float = MIN_COVERAGE) -> int:
    """How far the diagonals within one match can lie apart: text words inserted or template words left out at most."""
    return max(math.ceil(words * (1 / min_coverage - 1)), math.ceil(words * (1 - min_coverage)))


def align_window(template: np.ndarray, text: np.ndarray, min_coverage: float) -> tuple[int, int, int]:
    """Most template words matched in order anywhere in ``text``, cut to the longest part that covers enough.

    (matched, first word, end word), or zeros where no part covers ``min_coverage`` of the template and of its span.
    """
    size, least = len(text), min_coverage * len(template)
    table = np.zeros((len(template) + 1, size + 1), np.int32)
    for i, word in enumerate(template):
        np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + (text == word)), out=table[i + 1, 1:])
    if table[-1, -1] < least:
        return 0, 0, 0
    i, j = len(template), int(np.searchsorted(table[-1], table[-1, -1]))
    at = []
    while table[i, j]:
        if text[j - 1] == template[i - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            at.append(j)
        elif table[i - 1, j] == table[i, j]:
            i -= 1
        else:
            j -= 1
    place = np.array(at[::-1])
    for n in range(len(place), max(1, math.ceil(least)) - 1, -1):
        span = place[n - 1:] - place[:len(place) - n + 1] + 1
        k = int(span.argmin())
        if n >= least and n >= min_coverage * span[k]:
            return n, int(place[k]), int(place[k + n - 1]) + 1
    return 0, 0, 0


class Index:
    """Inverted index of the templates' winnowed fingerprints."""

    def __init__(self, templates, gram: int = GRAM, window: int = WINDOW):
        self.gram, self.window = gram, window
        self.number: dict[bytes, int] = {}
        self.names, self.coded = [], []
        for name, text in templates:
            self.names.append(name)
            self.coded.append([self.number.setdefault(w, len(self.number) + 1) for w in words(text.encode())])
        if sum(map(len, self.coded)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
        # of every word (0: unknown) in each template
        self.counts = [np.bincount(ids, minlength=len(self.number) + 1) for ids in self.coded]
        self.places: dict[int, list[tuple[int, int]]] = {}
        for t, ids in enumerate(self.coded):
            for at, value in self.fingerprints(np.array(ids, dtype=np.uint64)):
                self.places.setdefault(value, []).append((t, at))

    def fingerprints(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(position, hash) of the winnowed grams; grams with an unknown word (0) are never picked."""
        n = len(ids) - self.gram + 1
        if n <= 0:
            return []
        value, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(self.gram):
            value = (value ^ ids[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
            known &= ids[k:k + n] > 0
        if not known.any():
            return []
        value[~known] = np.iinfo(np.uint64).max
        width = min(self.window, n)
        view = np.lib.stride_tricks.sliding_window_view(value, width)
        picked = np.unique(view.argmin(axis=1) + np.arange(len(view)))
        picked = picked[known[picked]]
        return list(zip(picked.tolist(), value[picked].tolist()))

    def matches(self, text: bytes | None, min_coverage: float = MIN_COVERAGE, band: int = BAND):
        """(template number, matched words, first word, end word) of a text, in text order."""
        get = self.number.get
        ids = [get(w, 0) for w in words(text)]
        hits: dict[int, list[tuple[int, int]]] = {}
        for at, value in self.fingerprints(np.array(ids, dtype=np.uint64)):
            for t, place in self.places.get(value, ()):
                hits.setdefault(t, []).append((at - place, at))
        found, whole = [], np.array(ids, dtype=np.int64)
        for t, at in hits.items():
            template = self.coded[t]
            diagonals = sorted({d for d, _ in at})
            best = []
            for group in _groups(diagonals, band):
                n, a, b = align(template, ids, group[len(group) // 2], band)
                if n >= min_coverage * max(len(template), b - a):
                    best.append((n, a, b))
            far = reach(len(template), min_coverage)
            for group in _groups(diagonals, far) if far else ():
                # every match with a seed of the group lies in this window
                start, end = max(0, group[0] - far), min(len(ids), group[-1] + len(template) + far)
                window = whole[start:end]
                if np.minimum(self.counts[t], np.bincount(window, minlength=len(self.number) + 1)).sum() \
                        < min_coverage * len(template):
                    continue
                if any(n == len(template) and start <= a and b <= end for n, a, b in best) and len(group) == 1:
                    continue                                       # nothing can match more
                n, a, b = align_window(np.array(template), window, min_coverage)
                if n:
                    best.append((n, start + a, start + b))
            taken: list[tuple[int, int]] = []
            for n, a, b in sorted(best, key=lambda x: (-x[0], x[2] - x[1], x[1])):
                if all(b <= c or a >= d for c, d in taken):
                    taken.append((a, b))
                    found.append((t, n, a, b))
        return sorted(found, key=lambda x: (x[2], x[3], x[0]))


def _groups(diagonals: list[int], spread: int):
    """Sorted diagonals in groups of at most ``spread`` between the first and the last."""
    group = [diagonals[0]]
    for d in diagonals[1:]:
        if d - group[0] > spread:
            yield group
            group = []
        group.append(d)
    yield group


def scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text",
         min_coverage: float = MIN_COVERAGE, band: int = BAND) -> DataFrame:
    """(id, matches): ``matches`` is a list of (license, matched, words, first, end), ``end`` exclusive."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))
    id_type = source.schema["id"].dataType.simpleString()
    held = list(templates)
    Index(held)                                                    # refuses oversized templates here
    match = pa.list_(pa.struct([("license", pa.string()), ("matched", pa.int32()), ("words", pa.int32()),
                                ("first", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        index = Index(held)
        for batch in batches:
            out = [[{"license": index.names[t], "matched": n, "words": len(index.coded[t]), "first": a, "end": b}
                    for t, n, a, b in index.matches(body, min_coverage, band)] for body in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, match)], ["id", "matches"])

    return arrow(source, run, f"id {id_type}, matches array<struct<license:string,matched:int,words:int,"
                                  "first:bigint,end:bigint>>")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licenses of every document, with coverage and spans."""
    found = scan(table(spark, sf_dir, "documents"))
    spans = F.transform("matches", lambda m: F.format_string(
        "%s:%d/%d@%d-%d", m.license, m.matched, m.words, m.first, m.end))
    return found.select(F.col("id").alias("doc_id"), F.size("matches").cast("long").alias("n_matches"),
                        F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",").alias("licenses"),
                        F.array_join(spans, ";").alias("spans"))
