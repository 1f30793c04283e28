"""Ratios of all pairs at once are those of each pair."""

import random

import numpy as np
import pytest

from weftline.functions import unicode as U
from weftline.operators import ratios


@pytest.mark.parametrize("small", [False, True])
def test_ratios_are_those_of_each_pair(monkeypatch, small):
    """Over one and several words of 64 places, windows, repeated and shared words, nothing."""
    monkeypatch.setattr(ratios, "FEW", 0)
    if small:
        for limit, value in (("CELLS", 16), ("COLUMNS", 5), ("TABLE", 1), ("SLICE", 7)):
            monkeypatch.setattr(ratios, limit, value)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé\U0001f600") for _ in range(rng.randrange(1, 7)))
    words = [word() for _ in range(12)]
    text = lambda n: " ".join(rng.choice(words) if rng.random() < 0.6 else word() for _ in range(n))
    texts = ["", "a", "b", "a a", "ab" * 32, "ab" * 33, "ba" * 70, "a b " * 40 + "c"] + [text(rng.choice([1, 2, 3, 5, 9, 14, 18, 30])) for _ in range(40)]
    half = len(texts) // 2
    rng.shuffle(texts)
    every = ratios.Texts(texts)
    one, two = every.take(np.arange(half + 3)), every.take(np.arange(half - 3, len(texts)))
    for kernel, plain in ((ratios.fuzzy, U.FUZZY), (ratios.fuzzy_address, U.FUZZY_ADDRESS)):
        for got, (name, f) in zip(kernel(one, two), plain.items(), strict=True):
            assert got.tolist() == [[f(a, b) for b in two.texts] for a in one.texts], name
