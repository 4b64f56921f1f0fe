"""Packed runs of keys against what went into them."""

from __future__ import annotations

from collections import Counter

import numpy as np

from lodestone.llm._runs import from_gaps, gaps, pack, part_of, spans, unpack
from lodestone.llm.suffix_tree import Grams, pair_keys


def test_runs_give_back_their_columns():
    rng = np.random.default_rng(3)
    key = rng.integers(-(2**63), 2**63 - 1, 5000)
    key = key[np.argsort(key.view(np.uint64))]
    worth = np.where(rng.random(5000) < 0.5, np.nan, rng.normal(size=5000))
    got = unpack(pack(gaps(key), worth, np.arange(3, dtype="<u2")), "<u8", "<f8", "<u2")
    assert (from_gaps(got[0]) == key).all() and np.array_equal(got[1], worth, equal_nan=True) and got[2].tolist() == [0, 1, 2]
    assert [len(x) for x in unpack(pack(gaps(key[:0]), worth[:0]), "<u8", "<f8")] == [0, 0]
    for n in (1, 7, 70_000):
        part = part_of(key, n)
        assert (np.diff(part) >= 0).all() and 0 <= part.min() <= part.max() < n
        assert [k for k, at in spans(part) for _ in range(at.start, at.stop)] == part.tolist()


def test_counts_are_sent_as_a_row_for_each_range():
    """Half a million n-grams of two tasks: seven rows each, nine bytes an n-gram where its two hashes alone take 16, and the same counts."""
    rng = np.random.default_rng(5)
    names = rng.integers(-(2**63), 2**63 - 1, 20_000)
    want, rows, size = Counter(), [], 0
    for _ in range(2):
        ctx, suf = names[rng.integers(0, len(names), (2, 250_000))]
        found = Grams()
        found.add(pair_keys(ctx, suf), ctx, suf, np.full(len(ctx), 3))
        out = found.out(7)
        assert len(out) == 7 and sorted(out.column("part").to_pylist()) == list(range(7))
        rows += zip(out.column("part").to_pylist(), out.column("data").to_pylist(), strict=True)
        for g in zip(ctx.tolist(), suf.tolist(), strict=True):
            want[g] += 3
    got = {}
    for part in range(7):
        found = Grams()
        for k, data in rows:
            if k == part:
                size += len(data)
                found.add_run(data)
        found.add_up()
        _, ctx, suf, n = found.parts[0]
        new = dict(zip(zip(ctx.tolist(), suf.tolist(), strict=True), n.tolist(), strict=True))
        assert not new.keys() & got.keys()
        got |= new
    assert got == want and size < 9 * 500_000
