"""The snapshot against dropping one by one, correlation and similar pairs against all pairs."""

import random

import numpy as np
import pytest

from lodestore.operators import maintain, quantize, snapshot


def dropped(rows, budget):
    """The largest cluster, the first of equals, loses its oldest until the rest fits."""
    clusters = {}
    for i, c, epoch, line in rows:
        clusters.setdefault(c, []).append((-epoch, i, line))
    for v in clusters.values():
        v.sort()
    while sum(len(x[2]) + 1 for v in clusters.values() for x in v) > budget:
        name = min((c for c in clusters if clusters[c]), key=lambda c: (-len(clusters[c]), c))
        clusters[name].pop()
    return sorted((c, x[1]) for c, v in clusters.items() for x in v)


@pytest.mark.parametrize("budget", [0, 4, 60, 700, 3000, 9000])
def test_snapshot_equals_dropping_one_by_one(spark, budget):
    rng = random.Random(budget)
    f = [(i, f"t{rng.randrange(99)}", "x" * rng.randrange(300), rng.randrange(50), rng.choice("aaabbcd")) for i in range(120)]
    df = spark.createDataFrame(f, "id long, topic string, finding string, epoch long, cluster string")
    got = snapshot.snapshot(df.select("id", "topic", "finding", "epoch"), df.select("id", "cluster"), budget).collect()
    lines = [(i, c, e, f"- {t}: {x if len(x) <= 100 else x[:100] + '...'}") for i, t, x, e, c in f]
    assert sorted((r.cluster, r.id) for r in got) == dropped(lines, budget)


def test_correlation_of_all_pairs(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>").repartition(3)
    approx = {r.id: r.vec for r in quantize.dequantize_vectors(quantize.quantize_vectors(df, 3), 3).collect()}
    a = np.array([approx[i] for i in range(60)])
    i, j = np.triu_indices(60, 1)
    want = np.corrcoef((v @ v.T)[i, j], (a @ a.T)[i, j])[0, 1]
    got = quantize.similarity_correlation(df).first()
    assert got.pairs == 1770 and got.pearson == pytest.approx(want, abs=1e-4)
    assert quantize.similarity_correlation(df.limit(1)).first().pearson is None


def test_similar_pairs_of_all(spark):
    rng = np.random.default_rng(2)
    v = [x.tolist() for x in rng.normal(size=(80, 4))] + [[0.0] * 4, [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0]]
    df = spark.createDataFrame([*enumerate(v), (None, v[0]), (99, None)], "id long, vec array<double>")
    x = np.array(v)
    cos = (x @ x.T) / np.maximum(np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)), 1e-300)
    want = {(i, j) for i in range(83) for j in range(i + 1, 83) if round(cos[i, j], 4) > 0.9}
    for blocks in (1, 3, None):
        got = [(r.id1, r.id2) for r in maintain.similar_pairs(df, 0.9, blocks).collect()]
        assert len(got) == len(set(got)) and set(got) == want and (81, 82) in want
