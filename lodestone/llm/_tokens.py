"""Token ids of whole Arrow batches: each batch is cut into chunks at places where no token can cross, equal
chunks are encoded once, and the ids are gathered by array arithmetic. A worker keeps what it has encoded, up to a bound.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np

from ._text import U64, WHITE, Slice, ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
#: First bytes of characters that may be white space outside ASCII.
_MAYBE_WHITE = np.zeros(256, bool)
_MAYBE_WHITE[[0xC2, 0xE1, 0xE2, 0xE3]] = True

#: Entries that a task keeps, some 20 MB, and bytes of the longest chunk it keeps.
KEPT, KEPT_BYTES = 400_000, 48


class ChunkCodec:
    """Encodes chunks of bytes once. ``encode`` gets distinct chunks and gives a list of ids for each."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def __call__(self, part: Slice, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one chunk after another, and the number of each chunk's ids."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        h = part.hashes(starts, ends)
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > KEPT:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        at, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at[known], size[known] = self.at[place[known]], self.size[place[known]]
        ids = self.ids
        if len(new := np.flatnonzero(~known)):
            s, e = starts[first[new]], ends[first[new]]
            data = part.data.tobytes()
            got = self.encode([data[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)])
            n = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum()))
            size[new], at[new] = n, len(ids) + np.cumsum(n) - n
            ids = np.concatenate((ids, flat))
            keep = (e - s) <= KEPT_BYTES
            if keep.all():
                self.ids = ids
            else:  # long chunks are rare: rebuild the kept ids without them
                kept = ragged((np.cumsum(n) - n)[keep], n[keep])
                self.ids = np.concatenate((self.ids, flat[kept]))
            k = new[keep]
            base = len(self.ids) - int(n[keep].sum())
            put = np.searchsorted(self.keys, keys[k])
            self.at = np.insert(self.at, put, base + np.cumsum(n[keep]) - n[keep])
            self.size = np.insert(self.size, put, n[keep])
            self.keys = np.insert(self.keys, put, keys[k])
        n = size[inverse]
        return ids[ragged(at[inverse], n)], n


def byte_chunks(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Chunks for byte-level BPE: a new one begins at each space before a character that isn't white space, which
    is where its pattern begins a new word too."""
    d = part.data
    if not len(d):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    following = np.concatenate((d[1:], [np.uint8(32)]))
    cut = (d == 32) & ~WHITE[following] & ~_MAYBE_WHITE[following] & (following != 0x85) & ~((following >= 28) & (following <= 31))
    cut |= part.starts_here()[:-1]
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(d))


def word_chunks(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Chunks for BPE with word ends: words between ASCII white space, cut again where a letter a-z meets punctuation."""
    d = part.data
    if not len(d):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~WHITE[d]
    before = np.concatenate(([np.uint8(32)], d[:-1]))
    cut = inside & (WHITE[before] | part.starts_here()[:-1] | (_LETTER[before] & _PUNCT[d]))
    starts = np.flatnonzero(cut)
    _, word_ends = part.words()
    nxt = np.append(starts[1:], len(d))
    ends = np.minimum(nxt, word_ends[np.searchsorted(word_ends, starts, "right")])
    return starts, ends


def holds_special(part: Slice, specials: list[bytes]) -> list[int]:
    """Texts that hold the string of a special token; those are encoded whole."""
    data, found = part.data.tobytes(), set()
    for s in specials:
        i = data.find(s)
        while i >= 0:
            t = int(part.owner(np.array([i]))[0])
            if i + len(s) <= part.offsets[t + 1]:
                found.add(t)
            i = data.find(s, i + 1)
    return sorted(found)


#: How the public vocabulary of words with word ends normalises and cuts texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Words of the letters a-z and of those of Latin-1: composed already, lower-cased one by one, and never cut.
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


def plain_words(tokenizer, made: dict) -> Callable[[bytes], list[int] | None] | None:
    """The ids of a word of plain letters from the vocabulary's merges alone, None for other chunks; None where the settings differ."""
    if made.get("normalizer") != NORMALIZER or made.get("pre_tokenizer") != PRE_TOKENIZER or made["model"].get("type") != "BPE":
        return None
    if made["model"].get("dropout") or any(not x["content"].isascii() or x["content"].isalnum() for x in made["added_tokens"]):
        return None
    from ._bytelevel import byte_of_char

    chars, merge = {b: c for c, b in byte_of_char().items()}, tokenizer.model.tokenize

    def ids(chunk: bytes) -> list[int] | None:
        if chunk.isalpha():  # a-z alone
            word = chunk.lower().decode()
        elif _LATIN(chunk):
            word = chunk.decode().lower().encode().decode("latin-1").translate(chars)
        else:
            return None
        return [t.id for t in merge(word)]

    return ids


class TextCodec:
    """Ids of each text of a slice, equal to what the ``tokenizers`` library gives for the whole text."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        made = json.loads(self.tokenizer.to_str())
        self.specials = [x["content"].encode() for x in made["added_tokens"]]
        self.by_words = bool(made["model"].get("end_of_word_suffix"))
        self.vocabulary = max(made["model"]["vocab"].values()) + 1
        self.plain = plain_words(self.tokenizer, made) if self.by_words else None
        self.chunks = ChunkCodec(self._words if self.by_words else self._byte_level(made))

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, chunks: list[bytes]) -> list[list[int]]:
        """Plain words go to the vocabulary's merges at once, other chunks through the whole tokenizer."""
        if self.plain is None:
            return self._together(chunks)
        out = [self.plain(x) for x in chunks]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._together([chunks[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _together(self, chunks: list[bytes], together: int = 256) -> list[list[int]]:
        """Chunks stand in one text, with a special token between them, whose id then tells them apart."""
        texts = [x.decode("utf-8", "replace") for x in chunks]
        if not self.specials:
            return self._whole(texts)
        mark = self.specials[-1].decode()
        mark_id = self.tokenizer.token_to_id(mark)
        clash = [i for i, x in enumerate(texts) if "<" in x and any(s.decode() in x for s in self.specials)]
        own = dict(zip(clash, self._whole([texts[i] for i in clash]), strict=True))
        for i in clash:
            texts[i] = ""
        out: list[list[int]] = []
        for ids in self._whole([mark.join(texts[i : i + together]) for i in range(0, len(texts), together)]):
            lo = 0
            for hi in [*np.flatnonzero(np.array(ids, np.uint32) == mark_id).tolist(), len(ids)]:
                out.append(ids[lo:hi])
                lo = hi + 1
        for i, ids in own.items():
            out[i] = ids
        return out

    def _byte_level(self, made: dict) -> Callable[[list[bytes]], list]:
        """The same vocabulary, pattern and merges in a faster library where it applies, else the library itself."""
        from ._bytelevel import same_encoding

        fast = same_encoding(made)
        return self._words if fast is None else lambda chunks: [fast(x.decode("utf-8", "replace")) for x in chunks]

    def __call__(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of each text's ids."""
        part = self.prepare(part)
        starts, ends = (word_chunks if self.by_words else byte_chunks)(part)
        ids, n = self.chunks(part, starts, ends)
        owner = part.owner(starts)
        count = np.bincount(owner, weights=n, minlength=part.n).astype(np.int64)
        for t in holds_special(part, self.specials):
            at = int(count[:t].sum())
            own = np.array(self._whole([part.text(t).decode("utf-8", "replace")])[0], np.uint32)
            ids = np.concatenate((ids[:at], own, ids[at + count[t] :]))
            count[t] = len(own)
        return ids, count

    def prepare(self, part: Slice) -> Slice:
        """Lower-casing before chunks are compared makes fewer of them; special strings are lower case already."""
        return part.lower() if self.by_words else part


_codecs: dict[str, TextCodec] = {}


def codec(path: str) -> TextCodec:
    """The worker's codec of a file; it outlives the task, what it has encoded doesn't."""
    if path not in _codecs:
        _codecs[path] = TextCodec(path)
    return _codecs[path]


def forget(codecs: bool) -> None:
    """Drop what was encoded; without ``codecs``, the codecs too."""
    for c in _codecs.values():
        c.chunks.clear()
    if not codecs:
        _codecs.clear()
