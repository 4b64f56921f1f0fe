"""Byte-level BPE through tiktoken, for vocabularies whose ids are in merge order, as its ranks must be."""

from __future__ import annotations

from collections.abc import Callable

#: The published pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_char() -> dict[str, int]:
    """Printable Latin-1 bytes stand for themselves; the others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def same_encoding(made: dict) -> Callable[[str], list[int]] | None:
    """An encoder equal to the tokenizer ``made``, or None where its settings don't allow one."""
    pre, model = made.get("pre_tokenizer") or {}, made["model"]
    if made.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges"):
        return None
    merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    vocab, special = model["vocab"], {x["content"] for x in made["added_tokens"]}
    made_ids = [vocab[a + b] for a, b in merges]
    if made_ids != sorted(set(made_ids)) or len(vocab) - len(special & vocab.keys()) != 256 + len(merges):
        return None
    try:
        import tiktoken
    except ImportError:
        return None
    to_byte = byte_of_char()
    ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
