"""Operators that treat texts one by one: decontamination, tokens, BPE, HTML, licenses."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from latecomer.llm import bpe, decontaminate, html_text, licenses, tokens
from latecomer.llm.license_templates import TEMPLATES

LONG = " ".join(f"word{i}" for i in range(20_000))


# ---- benchmark decontamination ----

def brute_hits(ws, items, window):
    hit, named = set(), set()
    for item, x in items:
        m = min(window, len(x))
        keys = {tuple(x[i:i + m]) for i in range(len(x) - m + 1)} if m else set()
        for i in range(len(ws) - m + 1 if m else 0):
            if tuple(ws[i:i + m]) in keys:
                hit |= set(range(i, i + m))
                named.add(item)
    return hit, named


def test_automaton_matches_brute_force():
    rng = random.Random(5)
    for _ in range(800):
        window, letters = rng.choice([2, 3, 5]), [b"a", b"b", b"c"][:rng.choice([2, 3])]
        items = [(i, rng.choices(letters, k=rng.randint(0, 9))) for i in range(rng.randint(1, 5))]
        ws = rng.choices([*letters, b"x"], k=rng.randint(0, 30))
        found = decontaminate.Automaton(items, window).search(ws)
        hit, named = brute_hits(ws, items, window)
        assert {p for a, b in found.spans for p in range(a, b)} == hit and found.items == named


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 15])
def test_decontamination_edge_cases(spark, frame, block_words):
    ten = " ".join(f"q{i}" for i in range(14))
    docs = [(1, None), (2, ""), (3, f"start {ten.upper()}, end"), (4, "Short item! and Short-Item"), (5, "clean text"),
            (5, "clean text"), (None, LONG + " " + ten), (6, " ".join(f"q{i}" for i in range(9)))]
    items = [(10, ten), (11, "short item"), (11, "short item"), (12, None), (13, ""), (None, "clean")]
    df, bench = frame(docs), frame(items, "item_id bigint, text string")
    got = {(r.id, r.n_words): r for r in decontaminate.scan(df, bench, block_words=block_words).collect()}
    assert got[(3, 16)].n_hit == 14 and got[(3, 16)]["items"] == ["10"] and got[(3, 16)].longest == 14
    assert [(s.start, s.end) for s in got[(3, 16)].spans] == [(1, 15)]
    assert got[(4, 5)].n_hit == 4 and got[(4, 5)]["items"] == ["11"]
    assert got[(5, 2)].n_hit == 1 and got[(5, 2)]["items"] == []
    assert got[(None, 20_014)].n_hit == 14 and got[(6, 9)].n_hit == got[(1, 0)].n_hit == 0
    out = decontaminate.remove(df, bench, max_coverage=0.5, block_words=block_words)
    assert out.dtypes == df.dtypes
    texts = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    # 3 and 4 are hit in over half of their words, 5 in just half
    assert texts == sorted([(0, LONG + " "), (1, ""), (2, ""), (5, " text"), (5, " text"), (6, docs[-1][1])])
    assert decontaminate.scan(df.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate.scan(df, bench.limit(0)).collect()} == {0}


def test_cut_keeps_the_rest_byte_for_byte():
    text = "Ünder THE Old, old\tTree (it Stood) — so. END".encode()
    ws = decontaminate.words(text)
    assert [w.decode() for w in ws] == ["Ünder", "the", "old", "old", "tree", "it", "stood", "—", "so", "end"]
    assert decontaminate.cut(text, [(1, 4), (6, 7)]).decode() == "Ünder \tTree (it ) — so. END"
    assert decontaminate.cut(text, [(0, len(ws))]) == b"" and decontaminate.cut(text, []) == text


# ---- token files ----

def test_images_give_any_token():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 511, 512, 513, 3000):
        for top in (2, 300, 70_000, 2**32 - 1):
            ids = rng.integers(0, top, n).astype(np.uint32)
            image = tokens.Image(tokens.pack(ids))
            assert (image.ids() == ids).all()
            assert all(image.token_at(i) == ids[i] for i in range(0, n, max(1, n // 40)))
    with pytest.raises(IndexError):
        tokens.Image(tokens.pack(np.zeros(3, np.uint32))).token_at(3)


def test_encoder_equals_the_library():
    reference = Tokenizer.from_file(tokens.byte_tokenizer())
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\xa0", "\x85", "\x1c", "　", "a", "b'", "'s", "1", "é", "!",
            "<|endoftext|>", "'ll", "<|", "x" * 300]
    texts = ["", *("".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(4000))]
    encoder = tokens.Encoder(tokens.byte_tokenizer())
    for _ in range(2):                                     # the second time from memory
        assert [x.tolist() for x in encoder.batch(texts)] == [
            e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_token_files_round_trip(spark, frame, folder):
    rows = [(5, "five"), (1, None), (3, LONG), (2, ""), (4, "é ñ 日本"), (4, "é ñ 日本"), (4, "another"), (None, "null id")]
    df = frame(rows)
    out = tokens.write(df, tokens.byte_tokenizer(), segment_tokens=64)
    reference = Tokenizer.from_file(tokens.byte_tokenizer())
    ids = {t: [*reference.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows}
    got = sorted(tokens.read_documents(spark, out).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == [None, 1, 2, 3, 4, 4, 4, 5]
    start, whole = 0, []
    for r in got:
        own = next(ids[t] for i, t in rows if i == r.id and len(ids[t]) == r.n_tokens
                   and zlib.crc32(np.array(ids[t], "<u4").tobytes()) == r.ids_crc32)
        assert r.start == start and r.last_id == 0
        start += r.n_tokens
        whole += own
    at = [0, 1, len(whole) - 1, len(whole), 12_345, 30]
    wanted = spark.createDataFrame([(p,) for p in at], "position bigint")
    found = {r.position: r.token for r in tokens.read_tokens(spark, out, wanted).collect()}
    assert found == {p: whole[p] for p in at if p < len(whole)}
    query = tokens.op2_token_output(spark, folder(documents=df)).collect()
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in query} == {
        (r.id, r.start, r.n_tokens, r.ids_crc32) for r in got}
    assert tokens.read_documents(spark, tokens.write(df.limit(0), tokens.byte_tokenizer())).count() == 0


# ---- BPE ----

ODD = ["", "  ", "a\tb\nc", "Don't STOP'S 123 ½ x²", "ΟΔΟΣ ΣΑΣ", "é ́x", "İstanbul", "<|endoftext|>hi <|ENDOFTEXT|>",
       "日本語テキスト", "😀👍🏽 ok", "a\x1cb\x85c\xa0d e", "naïve—“quotes”…", "ß ẞ ﬁ Ǆ", "\x00\x01", "a" * 5000,
       "th" * 6000 + "e", "it's we'll I'm you've", "가 ñ"]


def test_streaming_gives_the_merges_of_the_whole():
    merges = bpe.load(bpe.word_tokenizer()).merges
    rng = random.Random(1)
    for n in range(40):
        word = "".join(rng.choices("aeinrst" if n % 2 else "abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 3000)))
        stream, out = bpe.WordEncoder(merges, block=8), []
        for i in range(0, len(word), 7):
            out += stream.feed(word[i:i + 7])
            assert len(stream.held) <= 8 + merges.lookahead + 8
        parts = list(word)
        parts[-1] += "</w>"
        assert out + stream.close() == merges.merge(parts)


def test_lookahead_of_a_small_merge_list():
    merges = bpe.Merges({}, [("a", "b"), ("c", "a"), ("x", "c")])
    # b after the a decides on ab, which decides on ca, which decides on xc
    assert merges.merge(list("xcab")) == ["xc", "ab"] and merges.merge(list("xcaa")) == ["x", "ca", "a"]
    assert merges.lookahead >= 3


def test_encode_and_decode_equal_the_library(spark, frame, folder):
    reference = Tokenizer.from_file(bpe.word_tokenizer())
    rows = [*enumerate(ODD), (3, ODD[3]), (None, LONG), (99, None)]
    df = frame(rows)
    got = bpe.encode_decode(df, bpe.word_tokenizer())
    assert got.columns == [*df.columns, "ids", "decoded"]
    want = {}
    for r in got.collect():
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        decoded = reference.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.decoded == decoded
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(decoded.encode()).hexdigest())
    query = bpe.op7_bpe_encode_decode(spark, folder(documents=df)).collect()
    assert len(query) == len(rows)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id] for r in query)
    assert bpe.encode_decode(df.limit(0), bpe.word_tokenizer()).count() == 0


def test_incremental_byte_decoder():
    reference = Tokenizer.from_file(tokens.byte_tokenizer())
    tokenizer = bpe.Tokenizer.__new__(bpe.Tokenizer)
    tokenizer.tokens = {i: t for t, i in reference.get_vocab().items()}
    tokenizer.byte_level = True
    ids = reference.encode("née 日本語 😀 ퟿", add_special_tokens=False).ids + [200, 97]
    decoder = bpe.Decoder(tokenizer)
    parts = [decoder.feed([i]) for i in ids]
    assert "".join(parts) + decoder.close() == reference.decode(ids, skip_special_tokens=False)
    assert "" in parts                                     # bytes of an unfinished character are held back


# ---- HTML ----

@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p>a", "a"), ("plain &amp; simple", "plain & simple"), ("<nav>x</nav>", ""),
    ("<body><div>Hello <b>big</b>\n world &lt;x&gt;</div><div class='sidebar'>S</div><footer>f</footer>",
     "Hello big world <x>"),
    ("<main><article><header><h1>T</h1></header><p>long text here</p><aside>no</aside><section class='comments'>"
     "<p>c</p></section><form>f<input></form></article></main><div class=ad>z</div>", "T long text here"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
    ("<p>x</i></span>y<script>var a='<p>no'</script>z</p>", "xyz"),
    ("<article><p>one<br>two</article><div role=alert>n</div><div id=cookie-notice>n</div>", "one two"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep")])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_smoothing_and_regions():
    lines = [("menu", 4, 0, True), ("x" * 200, 2, 0, False), ("y", 2, 0, False), ("z" * 150, 2, 0, False),
             ("a", 6, 0, False), ("b", 6, 0, False), ("c", 6, 0, False), ("d", 6, 0, False), ("e", 6, 0, False),
             ("f", 6, 0, False), ("g", 6, 0, False)]
    chosen = html_text.regions(lines)
    assert list(chosen[:4]) == [False, True, True, True] and not chosen[7:].any()


def test_pages_query(spark, frame, folder):
    rows = [(1, "u", "<article><p>Hi <b>there</b></article>"), (2, None, None), (2, None, None), (3, "v", "")]
    df = frame(rows, "page_id bigint, url string, html string")
    got = html_text.op4_html_extraction(spark, folder(pages=df)).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, "Hi there", 8), (2, "", 0), (2, "", 0), (3, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


# ---- licenses ----

def brute_align(template, text, diagonal, band):
    """Most template words in order with every pair within the band, by recursion over all pairs."""
    best = [[0] * (len(text) + 1) for _ in range(len(template) + 1)]
    for i in range(len(template)):
        for j in range(len(text)):
            near = abs(j - i - diagonal) <= band
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (near and template[i] == text[j]))
    return best[-1][-1]


def test_banded_alignment_matches_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        template, text = rng.choices(range(4), k=rng.randint(1, 9)), rng.choices(range(4), k=rng.randint(1, 12))
        n, a, b = licenses.align(template, text, 0, 12)
        assert n == brute_align(template, text, 0, 12) and (n == 0 or (text[a] in template and b - a >= n))


def test_edited_templates_are_found(spark, frame, folder):
    rng = random.Random(2)
    rows, want = [], []
    for k, (name, text) in enumerate(TEMPLATES):
        words = text.split()
        for _ in range(len(words) // 20):
            words[rng.randrange(len(words))] = "edited"
        rows.append((k, " ".join(["lorem ipsum"] * 40 + words + ["dolor sit amet"] * 30)))
        want.append((k, name))
    rows += [(100, None), (101, ""), (102, LONG), (103, "under the terms of the license"), (103, "License"),
             (None, "Released under the\nMIT license!!")]
    df = frame(rows)
    got = licenses.scan(df).collect()
    assert len(got) == len(rows)
    found = {(r.id, m.license): m for r in got for m in r.matches}
    assert set(want) <= set(found) and not {k for k, _ in found if k and k >= 100}
    for k, name in want:
        assert found[(k, name)]["first"] >= 80 and found[(k, name)].matched >= 0.8 * found[(k, name)].words
    assert found[(None, "MIT (statement)")].matched == 5
    query = {r.doc_id: r for r in licenses.op3_license_scan(spark, folder(documents=df)).collect()}
    assert query[None].spans == "MIT (statement):5/5@0-5" and query[102].n_matches == 0
    assert licenses.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(df, [("big", "w " * (licenses.MAX_TEMPLATE_WORDS + 1))])
