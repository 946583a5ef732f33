"""The document score against all label sequences, and its memory on texts of very many lines."""

import itertools
import math
import tracemalloc

import numpy as np
import pytest

from lodestore.llm import crf


@pytest.fixture
def model():
    rng = np.random.default_rng(3)
    return crf.Model(rng.normal(size=crf.FEATURES), rng.normal(size=(2, 2)), 2.0, -0.5)


@pytest.mark.parametrize("text", [None, "", "\n", "one line", "a b c d e\n\nThe end.\nThe end.\n!!!", "x\nyy\nzzz z\n1 2 3 4 5 | 6", "é ü\nÀ\n\n\n"])
def test_document_score_is_the_length_weighted_share_over_all_sequences(model, text):
    lines = (text or "").split("\n")
    x, _ = crf.line_features(text)
    weight = {}
    for labels in itertools.product((0, 1), repeat=len(lines)):
        s = sum(float(x[i] @ model.unary) * y for i, y in enumerate(labels)) + sum(model.trans[a, b] for a, b in zip(labels, labels[1:], strict=False))
        weight[labels] = math.exp(s)
    total = sum(weight.values())
    good = [sum(w for y, w in weight.items() if y[i]) / total for i in range(len(lines))]
    size = [len(v.encode()) + 1 for v in lines]
    share = sum(g * n for g, n in zip(good, size, strict=True)) / sum(size)
    assert model.score(text) == pytest.approx(1 / (1 + math.exp(-(2.0 * share - 0.5))), abs=1e-9)


def test_slices_change_nothing(model, monkeypatch):
    text = "\n".join(" ".join(f"w{(i * j) % 7}" for j in range(i % 9)) for i in range(300))
    whole, share = crf.line_features(text)[0], model.good_share(text)
    for lines, size in ((1, 1), (7, 1 << 20), (300, 40)):
        monkeypatch.setattr(crf, "SLICE_LINES", lines)
        monkeypatch.setattr(crf, "SLICE_BYTES", size)
        assert np.array_equal(crf.line_features(text)[0], whole)
        assert model.good_share(text) == pytest.approx(share, abs=1e-12)


def test_lines_need_a_hundred_bytes_each(model):
    text = "\n".join(map(str, range(400_000)))
    tracemalloc.start()
    score = model.score(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < score < 1 and peak < 400_000 * 100  # 300 MB for 3 million lines
