"""Suffix arrays by Lyndon groups, and repeated windows, against plain sorting."""

import random

import numpy as np

from graphloom.llm import substrings
from graphloom.llm.suffixes import suffix_arrays


def _plain(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_arrays_of_many_texts():
    rng = random.Random(5)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 12)):
            body = [rng.randint(1, rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(0, 60))]
            texts.append(body + [0])
        letters = np.array([x for t in texts for x in t], np.uint16)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = suffix_arrays(letters, bounds)
        for b, t in enumerate(texts):
            assert (got[bounds[b] : bounds[b + 1]] - bounds[b]).tolist() == _plain(t)


def test_suffix_arrays_of_powers_and_of_nothing():
    for t in ([1] * 50 + [0], [1, 2] * 30 + [0], [2, 1] * 30 + [0], [0], [3, 2, 1, 0], [1, 2, 3, 0]):
        assert suffix_arrays(np.array(t, np.uint16), np.array([0, len(t)])).tolist() == _plain(t)
    assert suffix_arrays(np.zeros(0, np.uint16), np.array([0])).tolist() == []


def test_contexts_cover_every_window_once():
    rng = np.random.default_rng(1)
    sizes = [0, 99, 100, 101, 500, 5000]
    raw = rng.integers(97, 100, sum(sizes)).astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    text, low, more, at, anchor, _ = substrings.contexts(raw, offsets)
    for i, n in enumerate(sizes):
        mine = text == i
        starts = [s for a, m in zip(low[mine], more[mine]) for s in range(a, a + m + 1)]
        assert starts == list(range(max(0, n - 99)))
        assert (more[mine] < 256).all() and (at[mine] >= more[mine]).all() and (at[mine] <= 68).all()
    strings = {}
    for i, a, k, h in zip(text, low, at, anchor):  # one anchor, one string
        begin = offsets[i] + a + k
        assert strings.setdefault(int(h), bytes(raw[begin : begin + 32])) == bytes(raw[begin : begin + 32])


def test_repeated_windows():
    rng = random.Random(3)
    base = bytes(rng.choice(b"abc") for _ in range(300))
    pieces = [base[10:160], base[30:190], base[10:160], base[200:300]]
    group = np.array([1, 1, 1, 2])
    owner, window = substrings.repeated_windows(group, np.array([5, 3, 9, 1]), np.array([10, 30, 10, 0]), pieces)
    got = {(int(o), int(w)) for o, w in zip(owner, window)}
    expected = {(0, w) for w in range(51) if 30 <= 10 + w <= 90} | {(2, w) for w in range(51)}
    assert got == expected
