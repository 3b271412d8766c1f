"""BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

**Lookahead.** A boundary between characters vanishes in one event only: the merge ``(u, v)`` whose
``u`` ends and whose ``v`` starts there. If two texts agree up to some place, a difference can travel
left of a boundary only by a merge that straddles it, of later rank than the merge that brought the
difference, and whose ``v`` starts with the ``u`` of that merge. The longest such chain of merges (the sum of
the lengths of their ``u``), plus one token, is a sufficient lookahead; :meth:`Merges.lookahead`
computes it in one pass over the merge list. A boundary further than this from the end of what has been
read is stable, so the tokens before it are emitted and forgotten: memory doesn't grow with the text.

**Texts.** The words of a text (the tokenizer's own split) can't merge with each other, so each word is
a stream of its own. Words recur, so a worker keeps the output of up to ``CACHE`` pieces of text
(what stands between U+0020 or line feeds); pieces longer than ``LONG`` characters aren't kept.

**Decoding.** :class:`Decoder` takes ids one by one. For byte-level decoders it maps
token characters to bytes and bytes to text with an incremental UTF-8 state machine (U+FFFD for what is not
UTF-8); a tokenizer file without a decoder joins the tokens by one space, as its library does.

Cases: NULL is the empty text (no tokens, empty decoded text); very long words are streamed in blocks; repeated
rows give equal results; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, table

CACHE = 600_000
LONG = 200
BLOCK = 4096


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


_LETTERS = byte_letters()


class Merges:
    """Vocabulary and ranked merges of a BPE model, with its sufficient lookahead."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {}
        for i, pair in enumerate(merges):
            self.rank.setdefault(tuple(pair), i)
        self.lookahead = self._lookahead(merges)

    def _size(self, token: str) -> int:
        return len(token.removesuffix(self.suffix)) if self.suffix else len(token)

    def _lookahead(self, merges) -> int:
        """Longest chain of merges by rank in which each ``v`` starts with the ``u`` before, plus a token."""
        chain: dict[str, int] = {}
        longest = token = 1
        for u, v in merges:
            best = max((chain.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
            here = best + self._size(u)
            chain[u] = max(chain.get(u, 0), here)
            longest = max(longest, here)
            token = max(token, self._size(u) + self._size(v))
        return longest + token

    def merge(self, parts: list[str]) -> list[str]:
        """All merges of ``parts``, the lowest rank first, leftmost on ties."""
        if len(parts) > 24:
            return self._merge_long(parts)
        get, inf = self.rank.get, len(self.rank)
        ranks = [get(p, inf) for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == inf:
                break
            at = ranks.index(least)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), inf)
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), inf)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        rank, n = self.rank, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1)
                if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, u, v = heapq.heappop(heap)
            j = after[i]
            if parts[i] != u or j >= n or parts[j] != v:
                continue
            parts[i], parts[j] = u + v, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p]


class WordEncoder:
    """Streaming transducer for one word: ``feed`` characters, take the tokens that are stable."""

    def __init__(self, merges: Merges, block: int = BLOCK):
        self.merges, self.block, self.held = merges, block, ""

    def feed(self, letters: str) -> list[str]:
        out = []
        self.held += letters
        while len(self.held) > self.block + self.merges.lookahead + 1:
            # one character is kept back: the last one of the word carries the suffix
            stable = len(self.held) - 1 - self.merges.lookahead
            done = 0
            for token in self.merges.merge(list(self.held[:-1])):
                if done + len(token) > stable:
                    break
                out.append(token)
                done += len(token)
            self.held = self.held[done:]
        return out

    def close(self) -> list[str]:
        letters, self.held = list(self.held), ""
        if letters:
            letters[-1] += self.merges.suffix
        return self.merges.merge(letters)


class Tokenizer:
    """The parts of a tokenizers-library BPE file that this encoder supports."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("unk_token"):
            raise ValueError("unsupported BPE model")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) \
            if self.special else None
        self._starts = {t[0] for t in self.special}
        steps = spec["normalizer"]["normalizers"] if (spec["normalizer"] or {}).get("type") == "Sequence" else \
            [spec["normalizer"]] if spec["normalizer"] else []
        self.steps = [s["type"] for s in steps]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if self.steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"]:
            raise ValueError("unsupported normalizer or split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self._seen: dict[str, list[int]] = {}

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the split; a bounded number of short words is remembered."""
        ids = self._seen.get(word)
        if ids is None:
            ids = self._transduce(word)
            if len(word) <= LONG:
                if len(self._seen) >= CACHE // 2:
                    self._seen.clear()
                self._seen[word] = ids
        return ids

    def _transduce(self, word: str) -> list[int]:
        letters = "".join([_LETTERS[b] for b in word.encode("utf-8", "surrogatepass")])
        if len(letters) <= BLOCK:
            parts = list(letters)
            parts[-1] += self.merges.suffix
            tokens = self.merges.merge(parts)
        else:
            stream, tokens = WordEncoder(self.merges), []
            for at in range(0, len(letters), BLOCK):
                tokens += stream.feed(letters[at:at + BLOCK])
            tokens += stream.close()
        vocab = self.merges.vocab
        return [vocab[t] for t in tokens if t in vocab]

    def encode(self, text: str) -> list[int]:
        """Ids of a text; texts may be cut at white space and the ids joined."""
        out, at = [], 0
        for m in self._special.finditer(text) if any(c in text for c in self._starts) else ():
            out += self._plain(text[at:m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        if not text:
            return []
        text = unicodedata.normalize("NFC", text)
        # letter by letter: str.lower() alone would make a final sigma of a sigma
        text = text.lower() if "Σ" not in text else "".join([c.lower() for c in text])
        out = []
        for word in self.words.findall(text):
            out += self.encode_word(word)
        return out


class Decoder:
    """Incremental decoder: ``feed`` ids, get the text that is settled; ``close`` gives the rest."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokens, self.byte_level = tokenizer.tokens, tokenizer.byte_level
        self.state = codecs.getincrementaldecoder("utf-8")("replace") if self.byte_level else None
        self.first = True

    _BYTE = {c: b for b, c in enumerate(_LETTERS)}

    def feed(self, ids) -> str:
        tokens = [self.tokens[i] for i in ids if i in self.tokens]
        if not tokens:
            return ""
        if self.byte_level:
            return self.state.decode(b"".join(
                bytes(map(self._BYTE.__getitem__, t)) if all(c in self._BYTE for c in t) else t.encode() for t in tokens))
        text = ("" if self.first else " ") + " ".join(tokens)
        self.first = False
        return text

    def close(self) -> str:
        return self.state.decode(b"", True) if self.byte_level else ""


_LOADED: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    """The tokenizer of a file; a Python worker reads it once."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


class _Pieces(dict):
    """Bounded memory of pieces: piece -> (token count, ids in decimal, decoded text), all as bytes."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, piece: str):
        ids = self.tokenizer.encode(piece)
        decoder = Decoder(self.tokenizer)
        text = decoder.feed(ids) + decoder.close()
        value = (len(ids), b"%s" % " ".join(map(str, ids)).encode(), text.encode())
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = value
        return value


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for tokenizers that split at white space and join by spaces.

    Text runs through the transducer piece by piece; ids and decoded text go straight into the digests.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches):
        tokenizer = load(path)
        if tokenizer.byte_level:
            raise ValueError("digests() is for tokenizers without a byte-level decoder")
        pieces = _Pieces(tokenizer)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                n, ids, out = 0, hashlib.sha256(), hashlib.sha256()
                words = text.replace("\n", " ").split(" ")
                for at in range(0, len(words), 1 << 16):
                    got = [g for g in map(pieces.__getitem__, words[at:at + (1 << 16)]) if g[0]]
                    if got:
                        gap = b" " if n else b""
                        n += sum([g[0] for g in got])
                        ids.update(gap + b" ".join([g[1] for g in got]))
                        out.update(gap + b" ".join([g[2] for g in got]))
                counts.append(n)
                ids_sha.append(ids.hexdigest())
                text_sha.append(out.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow(source, run, f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids",
                  decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with the ids and the decoded text of ``text_col`` as two more columns."""
    columns = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    source = docs.select(*[F.col(f"`{c}`") for c in columns])
    at = columns.index(text_col)

    def run(batches):
        tokenizer = load(path)
        pieces = _Pieces(tokenizer)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, out = [], []
                for text in part.column(at).to_pylist():
                    if tokenizer.byte_level:              # decoded text depends on what stands around a piece
                        found = tokenizer.encode(text or "")
                        decoder = Decoder(tokenizer)
                        ids.append(np.array(found, np.int32))
                        out.append(decoder.feed(found) + decoder.close())
                    else:
                        got = [g for g in map(pieces.__getitem__, (text or "").replace("\n", " ").split(" ")) if g[0]]
                        ids.append(np.array(b" ".join([g[1] for g in got]).split(), np.int32))
                        out.append(b" ".join([g[2] for g in got]).decode())
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(out, pa.string())],
                                                 [*columns, ids_col, decoded_col])

    fields = T.StructType([*source.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())),
                           T.StructField(decoded_col, T.StringType())])
    return arrow(source, run, fields)


def word_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe_encode_decode(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    found = digests(table(spark, sf_dir, "documents"), path or word_tokenizer())
    return found.withColumnRenamed("id", "doc_id")
