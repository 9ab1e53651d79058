"""The last round of the n-gram join with every column of three rows hot and dealt to a grid."""

import random

import pytest
from test_llm import brute_components, frame

from fieldmark.llm import ngram_join


def near_copies(seed, groups, size):
    """Groups of texts about the threshold, so that many of a column's rows lie in different components."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(30)}" for _ in range(40)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(1, 5)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(1000)}"
            out.append(" ".join(text))
    rng.shuffle(out)
    return [(k, t, "en", "a") for k, t in enumerate(out)]


@pytest.mark.parametrize("split", [1, 40, 1 << 22])
def test_grid_meets_every_pair(spark, monkeypatch, split):
    monkeypatch.setattr(ngram_join, "_HOT", 2)
    monkeypatch.setattr(ngram_join, "_SPLIT", split)
    # no round before the last one links anything, so that all links come from it
    monkeypatch.setattr(ngram_join, "_LIKELY", 2.0)
    rows = near_copies(split, 4, 18)
    got = sorted((tuple(r) for r in ngram_join.similar_components(frame(spark, rows)).collect()), key=repr)
    assert got == brute_components([r[:2] for r in rows])
