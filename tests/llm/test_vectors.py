import math
import random
from fractions import Fraction

import numpy as np
import pytest

from lodestore.llm import mtree, vectors
from tests import oracle


def planted(n=300, dims=64, seed=2):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dims))
    x[50:120] = x[0] + 0.18 * r.standard_normal((70, dims))  # a group around the threshold
    x[120:160] = x[1]
    x[160:200] = x[2] * r.uniform(0.1, 9, (40, 1))
    x[200:240] = x[3] + 0.05 * r.standard_normal((40, dims))
    return x.astype(np.float32)


def brute(x, min_cos=0.95):
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    g = y @ y.T >= min_cos
    np.fill_diagonal(g, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(g, comp[None, :], len(x)).min(1))
        if (new == comp).all():
            return g.sum(1), comp
        comp = new


def test_links_and_components_match_brute_force(spark):
    x = planted()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    links, comp = brute(x)
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    assert links.max() > 30 and 0 < links[50] < 200
    assert got == {i: (int(links[i]), int(comp[i]), comp[i] == i) for i in range(len(x))}


@pytest.mark.parametrize("width", [8, 16])
def test_many_small_tiles_give_the_same(spark, monkeypatch, width):
    monkeypatch.setattr(vectors, "block_dims", lambda n: width)
    monkeypatch.setattr(vectors, "LEAF_ROWS", 8)
    x = planted()[:240]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    links, comp = brute(x)
    assert {r.id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, tile_rows=16).collect()} == {i: (int(links[i]), int(comp[i])) for i in range(240)}


def test_splits_place_all_within_reach():
    r = np.random.default_rng(3)
    x = r.integers(-100, 100, (400, 4))
    tree = vectors.Splits(x[:100], 12)
    row, leaf, home = tree.place(x, 900.0)
    at = {}
    for i, j, h in zip(row.tolist(), leaf.tolist(), home.tolist(), strict=True):
        at.setdefault(i, {})[j] = h
    own = {i: [j for j, h in v.items() if h] for i, v in at.items()}
    assert all(len(v) == 1 for v in own.values()) and len(own) == 400 and len({v[0] for v in own.values()}) > 8
    for i in range(400):
        assert max(at[i]) == own[i][0]  # visits go to lower leaves only
        for j in range(400):
            if ((x[i] - x[j]) ** 2).sum() <= 900 and own[j][0] < own[i][0]:
                assert own[j][0] in at[i]


def test_sizes_of_any_order(spark):
    big = [[3e200, 4e200], [3e-200, 4.00001e-200], [5e-324, 0.0], [-4e200, 3e200], [1e308, 1e-308]]
    df = spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (0, 3), 4: (1, 2)}


ODD = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 0.0]), (9, [2.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1.0]), (12, [-1.0, 0.0])]


def test_odd_vectors(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS cid", "'x' AS x", "3 AS n", "4 AS h")
    got = sorted((r.id is None, r.id or 0, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    linked = [(False, i, 3, 1, i == 1) for i in (1, 2, 2, 9)]
    alone = [(False, i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 10, 11, 12)]
    assert got == sorted([*linked, *alone]) + [(True, 0, 0, None, True)]
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_pigeonhole_radii():
    block, sure, beyond = vectors.radii(64, 0.95, 16)
    assert len(block) == 4 and sure < 0.1 * vectors.UNIT**2 < beyond
    q = vectors.rotation(64)
    assert np.allclose(q @ q.T, np.eye(64), atol=1e-12)


def test_m_tree_finds_what_a_scan_finds():
    r = np.random.default_rng(4)
    base = r.integers(-300, 300, (40, 16))
    x = np.vstack([base[r.integers(0, 40, 3000)] + r.integers(-6, 7, (3000, 16)), np.repeat(base[:1], 300, 0)])
    ids = r.permutation(len(x))
    tree = mtree.MTree(x, ids, page=64)
    done = 0
    for i in range(25):
        q = x[i * 7]
        scores = (x * q).sum(1)
        want = sorted(zip((-scores).tolist(), ids.tolist(), strict=True))[:10]
        before = tree.computed
        assert tree.search(q, 10) == [(-s, j) for s, j in want]
        done += tree.computed - before
    assert done < 25 * len(x) * 0.8  # the stored distances save computations
    own = int(ids[0])
    assert own not in [j for _, j in tree.search(x[0], 10, without=own)]


def test_top_products_of_odd_rows(spark):
    rows = [*ODD, (100, [1.0, 0.5]), (100, [1.0, 0.5]), (200, [1.0, 0.0, 0.0]), (300, None), (0, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in mtree.top_products(df).orderBy("query_id", "rank").collect()]
    one = 1024 * 1024
    two = [(9, 2 * one), (100, one + one // 4), (1, one), (2, one), (2, one), (4, 0), (12, -one)]
    # of queries that repeat an id each has its ranks, and the other for a candidate
    assert got == sorted([(100, i + 1, v, s) for i, (v, s) in enumerate(two)] * 2 + [(200, 1, 10, one)])
    assert mtree.top_products(df.limit(0)).count() == 0


def brute_products(rows, k=10, every=100):
    """By Python's integers, of any size."""
    whole = [(i, [math.floor(Fraction(y) * 1024) for y in x]) for i, x in rows]
    out = []
    for n, (i, q) in enumerate(whole):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for m, (j, x) in enumerate(whole) if m != n and len(x) == len(q))
            out += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(1e5,), (4e6,), (2.0**31, 1.0), (3e9,), (1e18, 1e3), (1e305, 1e-300, 1.0)])
def test_scores_of_any_size_are_exact(spark, monkeypatch, sizes):
    monkeypatch.setattr(mtree, "TREE_ROWS", 20)
    r = random.Random(len(sizes))
    rows = [(i % 380, [r.uniform(-1, 1) * r.choice(sizes) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(30)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in mtree.top_products(df).collect()) == brute_products(rows)


def test_order_text_orders_what_long_cannot_tell_apart():
    scores = sorted([0, 2**63 - 1, 2**63, -(2**63), -(2**63) - 1, 10**30, 10**29, -(10**30), -(10**29), 3 * 10**29, -3 * 10**29])
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert sorted(scores, key=lambda s: (clamp(s), mtree.order_text(s))) == scores


def test_queries_match_their_sql(spark, sf):
    con = oracle.connect(sf)
    assert oracle.spark_rows(vectors.op1(spark, sf)) == oracle.sql_rows(con, vectors.OP1_SQL)
    assert oracle.spark_rows(mtree.op8(spark, sf)) == oracle.sql_rows(con, mtree.OP8_SQL)
