"""Merge training with foresight: the same list as by counting anew for each merge."""

import random
import re

import pytest

from lodestore.operators import compress


def plain_train(texts, merges, min_count=2):
    """All pairs counted anew for each merge."""
    runs = []
    for text in texts:
        toks, gaps, at = [], [], 0
        for m in re.finditer(compress.TOKEN, text or "", re.ASCII):
            gaps.append(text[at : m.start()])
            toks.append(m[0])
            at = m.end()
        runs.append((toks, gaps))
    out = []
    while len(out) < merges:
        counts = {}
        for toks, gaps in runs:
            for i in range(1, len(toks)):
                if gaps[i] == " ":
                    counts[toks[i - 1], toks[i]] = counts.get((toks[i - 1], toks[i]), 0) + 1
        best = min(counts, key=lambda p: (-counts[p], p), default=None)
        if best is None or counts[best] < min_count:
            return out
        out.append(best)
        runs = [compress._apply(t, g, [best]) for t, g in runs]
    return out


@pytest.mark.parametrize(("seed", "merges", "ahead", "words"), [(1, 60, 8, 6), (2, 500, 48, 12), (3, 25, 1, 4), (4, 200, 16, 60)])
def test_merges_equal_a_plain_recount(spark, seed, merges, ahead, words):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)] + ["don't", "3.5", "é", "x"]
    texts = [rng.choice(["", " "]).join("") + "".join(rng.choice(vocab) + rng.choice([" "] * 9 + ["\n", "  ", ", "]) for _ in range(rng.randrange(50))) for _ in range(40)]
    texts += texts[:5] + ["x x x x x x x", "x x x", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    assert compress.train(df, merges=merges, ahead=ahead) == plain_train(texts, merges)


def test_nothing_to_merge(spark):
    assert compress.train(spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")) == []
    assert compress.train(spark.createDataFrame([], "id long, text string")) == []


def test_hash_collisions_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(compress, "SLOTS", 4)
    texts = ["a b c d a b c e a b", "c d a b x y", "q r s t"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert compress.train(df, merges=30) == plain_train(texts, 30)
