from __future__ import annotations

import re
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import kernels as K

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATTERNS = {"blank": (K.BLANK, re.compile(r"[^\x20\x09-\x0D]+")), "alnum": (K.ALNUM, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))}
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBé1 \n\t.-漢", max_size=40)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.sampled_from(sorted(PATTERNS)))
def test_words_are_the_patterns(texts, kind):
    table, pattern = PATTERNS[kind]
    want = [pattern.findall((t or "").translate(LOW)) for t in texts]
    hashes, first = K.hashed(pa.array(texts, pa.string()), table)
    assert np.diff(first).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    seen: dict[int, str] = {}
    back: dict[str, int] = {}
    for h, w in zip(hashes.tolist(), flat, strict=True):
        assert seen.setdefault(h, w) == w and back.setdefault(w, h) == h


def test_slices_and_long_words():
    whole = pa.array(["x y", "a" * 700_000 + " b", "y x"])
    part = whole.slice(1, 2)
    h, first = K.hashed(part, K.BLANK)
    assert np.diff(first).tolist() == [2, 2]
    full, _ = K.hashed(whole, K.BLANK)
    assert h.tolist() == full[2:].tolist() and full[0] == full[5] and full[1] == full[4]


def test_hash_does_not_depend_on_place():
    texts = [f"{'z ' * i}word" for i in range(0, 3000, 7)]
    h, first = K.hashed(pa.array(texts), K.BLANK)
    assert len(set(h[first[1:] - 1].tolist())) == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=7), max_size=6), st.integers(1, 5))
def test_shingles(texts, k):
    words = np.array([w for t in texts for w in t], np.uint64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    values, begin = K.shingles(K.mix(words + np.uint64(1)), first, k)
    names: dict[int, tuple] = {}
    for i, t in enumerate(texts):
        want = [tuple(t[j : j + k]) for j in range(len(t) - k + 1)] if len(t) >= k else [tuple(t)] if t else []
        got = values[begin[i] : begin[i + 1]].tolist()
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert names.setdefault(g, w) == w


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=40), st.lists(st.integers(0, 20), max_size=40))
def test_prober(keys, asked):
    keys = K.mix(np.array(sorted(set(keys)), np.uint64))
    keys.sort()
    asked = K.mix(np.array(asked, np.uint64))
    at = K.Prober(keys).find(asked)
    assert [(int(keys[a]) if a >= 0 else None) for a in at] == [(int(x) if x in set(keys.tolist()) else None) for x in asked.tolist()]


def test_tally():
    k, c = K.tally(np.array([3, 1, 3], np.uint64))
    assert (k.tolist(), c.tolist()) == ([1, 3], [1, 2])
    k, c = K.tally(np.array([3, 1, 3], np.uint64), np.array([5, 1, 2]))
    assert (k.tolist(), c.tolist()) == ([1, 3], [1, 7])


def test_a_prober_is_built_in_little_memory():
    """Each task that scores texts builds one over millions of keys."""
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 3_000_000, dtype=np.uint64))
    tracemalloc.start()
    try:
        prober = K.Prober(keys)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 << 20
    assert (prober.find(keys[::7]) == np.arange(0, len(keys), 7)).all() and (prober.find(keys[::7] + K.U64(1)) == K.lookup(keys, keys[::7] + K.U64(1))).all()
