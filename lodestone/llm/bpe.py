"""BPE encoding and decoding (operator 10): speculate, verify, and merge only what fails.

The words of a batch are taken once each. Greedy longest match proposes their tokens. A row of tokens is what BPE gives
if and only if merging the characters of each two neighbours gives these two tokens again; whether it does is kept for
each pair of ids, and the pairs of all words are tested by one look-up in sorted arrays. Words with a failing pair are
merged exactly, by the library's merging of one word. Decoding gathers the tokens' bytes by array arithmetic.

Null texts are empty: no ids, and an empty decoded text. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import in_arrow
from ._text import slices
from ._tokens import TextCodec

#: Verdicts on pairs and words that a worker keeps.
KEPT = 2_000_000
ENCODED = "doc_id long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class SpeculativeBPE(TextCodec):
    """BPE of a vocabulary whose words end in a suffix; the library merges only the words whose proposal fails."""

    def __init__(self, path: str):
        import json

        super().__init__(path)
        made = json.loads(self.tokenizer.to_str())
        model = made["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        v = self.vocab
        self.merges = {(v[a], v[b]): (k, v[a + b]) for k, (a, b) in enumerate(merges)}
        special = {x["id"]: x["content"] for x in made["added_tokens"]}
        n = max([*v.values(), *special]) + 1
        self.token = [""] * n
        for t, i in v.items():
            self.token[i] = t
        for i, t in special.items():
            self.token[i] = t
        specials = set(special.values())
        self.longest = max(len(t.removesuffix(self.end)) for t in v if t not in specials)
        self.pair_key, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        data = [t.encode() + b" " for t in self.token]
        self.size = np.array([len(x) for x in data], np.int64)
        self.bytes = np.frombuffer(b"".join(data), np.uint8)
        self.place = np.cumsum(self.size) - self.size
        self.words: dict[str, list[int]] = {}
        self.failed = self.tried = 0
        self.chunks.encode = self._chunks

    def symbols(self, token: str) -> list[int]:
        body = token.removesuffix(self.end) if self.end and token.endswith(self.end) and len(token) > len(self.end) else token
        out = [self.vocab[c] for c in body[:-1]]
        return [*out, self.vocab[body[-1] + token[len(body) :]]]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact: always the pair of least rank, the leftmost first."""
        if len(ids) > 40:
            return self._merge_long(ids)
        get = self.merges.get
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                m = get((ids[i], ids[i + 1]))
                if m and (best is None or m[0] < best[0]):
                    best, at = m, i
            if best is None:
                break
            ids = [*ids[:at], best[1], *ids[at + 2 :]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, ids = len(ids), list(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (m := self.merges.get((ids[i], ids[after[i]]))):
                heapq.heappush(heap, (m[0], i, ids[i], ids[after[i]], m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def propose(self, word: str) -> list[int]:
        get, end, out, i, n = self.vocab.get, self.end, [], 0, len(word)
        while i < n:
            if n - i <= self.longest and (t := get(word[i:] + end)) is not None:
                out.append(t)
                break
            for j in range(min(n - 1, i + self.longest), i, -1):
                if (t := get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                raise KeyError(word[i])
        return out

    def pairs_hold(self, keys: np.ndarray) -> np.ndarray:
        """For sorted distinct keys a * 2**32 + b: whether b may follow a."""
        if len(self.pair_key) > KEPT:
            self.pair_key, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        at = np.searchsorted(self.pair_key, keys)
        known = at < len(self.pair_key)
        known[known] = self.pair_key[at[known]] == keys[known]
        out = np.zeros(len(keys), bool)
        out[known] = self.pair_ok[at[known]]
        if len(new := np.flatnonzero(~known)):
            t = self.token
            for k in new.tolist():
                a, b = divmod(int(keys[k]), 1 << 32)
                out[k] = self.merge(self.symbols(t[a]) + self.symbols(t[b])) == [a, b]
            put = np.searchsorted(self.pair_key, keys[new])
            self.pair_key, self.pair_ok = np.insert(self.pair_key, put, keys[new]), np.insert(self.pair_ok, put, out[new])
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        rows = [self.propose(w) for w in words]
        n = np.array([len(r) for r in rows])
        flat = np.fromiter((x for r in rows for x in r), np.int64, int(n.sum()))
        word = np.repeat(np.arange(len(rows)), n)
        inner = np.flatnonzero(word[:-1] == word[1:])
        keys, inverse = np.unique((flat[inner] << 32) | flat[inner + 1], return_inverse=True)
        bad = np.unique(word[inner[~self.pairs_hold(keys)[inverse]]]) if len(inner) else []
        for k in bad:
            rows[k] = [t.id for t in self.tokenizer.model.tokenize(words[k])]
        self.tried, self.failed = self.tried + len(words), self.failed + len(bad)
        return rows

    def _chunks(self, chunks: list[bytes]) -> list[list[int]]:
        """Chunks of letters a-z are words already; others go through the file's normaliser and pre-tokeniser."""
        split = []
        normal, pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        for raw in chunks:
            text = raw.decode("utf-8", "replace")
            if raw.isalpha() and raw.isascii() and raw.islower():
                split.append((text,))
            else:
                split.append(tuple(x[0] for x in pre.pre_tokenize_str(normal.normalize_str(text) if normal else text)))
        if len(self.words) > KEPT // 4:
            self.words.clear()
        new = list({w for ws in split for w in ws} - self.words.keys())
        self.words.update(zip(new, self.encode_words(new), strict=True))
        get = self.words
        return [[i for w in ws for i in get[w]] for ws in split]

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids' tokens, a space after each."""
        from ._text import ragged

        return self.bytes[ragged(self.place[ids], self.size[ids])]


_own: dict[str, SpeculativeBPE] = {}


def _codec(path: str) -> SpeculativeBPE:
    if path not in _own:
        _own[path] = SpeculativeBPE(path)
    return _own[path]


def forget(codecs: bool) -> None:
    """Drop what was encoded; without ``codecs``, the codecs too."""
    for c in _own.values():
        c.chunks.clear()
        c.words.clear()
    if not codecs:
        _own.clear()


def _each(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, memoryview, np.ndarray]]:
    codec = _codec(tokenizer)
    for b in batches:
        for part in slices(b.column("text")):
            ids, n = codec(part)
            ends = np.concatenate(([0], np.cumsum(n)))
            sizes = np.concatenate(([0], np.cumsum(codec.size[ids])))[ends]
            yield b.column("doc_id").slice(part.lo, part.n), ids.astype("<u4"), ends, memoryview(codec.decoded(ids)), sizes


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The ids of each text and what they decode to, tokens of special ids included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, ends, text, at in _each(batches, tokenizer):
            out = [str(text[a : max(a, z - 1)], "utf-8") for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(in_arrow, run, ENCODED, True)


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """As ``encode_decode``, with digests in place of ids and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, ends, text, at in _each(batches, tokenizer):
            raw = memoryview(ids.tobytes())
            a = [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            d = [hashlib.sha256(text[x : max(x, y - 1)]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(ends), pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(in_arrow, run, DIGESTS, True)
