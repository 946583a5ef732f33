import random

import corpus_pipeline
import numpy as np

from lodestore.llm import shingles
from tests.llm.test_simhash import brute_fingerprint


def grams(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_representatives(rows):
    """Ids that stay when pairs within four bits or of Jaccard 0.8 and more are linked."""
    ids = sorted(rows)
    sets, fps, part = {i: grams(rows[i]) for i in ids}, {i: brute_fingerprint(rows[i]) for i in ids}, {i: i for i in ids}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and ((fps[i] ^ fps[j]).bit_count() <= 4 or 5 * len(sets[i] & sets[j]) >= 4 * max(1, len(sets[i] | sets[j]))):
                a, b = find(i), find(j)
                part[max(a, b)] = min(a, b)
    return {find(i) for i in ids}


def test_shingle_sets():
    for text in (None, "", " \n", "a", "a B c d", "a b c d e", "one two three four five six seven", "x " * 50):
        assert len(shingles.shingle_set(text)) == len(grams(text))
    assert shingles.shingle_set("A  b c d e f").tolist() == shingles.shingle_set("a b c\nd e f").tolist()


def test_min_hash_shares_follow_the_similarity():
    r = np.random.default_rng(2)
    for j in (0.5, 0.8, 0.9):
        a = r.integers(0, 1 << 63, 1000).astype(np.uint64)
        n = round(1000 * 2 * j / (1 + j))
        b = np.concatenate((a[:n], r.integers(0, 1 << 63, 1000 - n).astype(np.uint64)))
        assert abs((shingles.min_hashes(a) == shingles.min_hashes(b)).mean() - shingles.jaccard(a, b)) < 0.13


def test_stage_drops_ordinary_near_copies(spark, sf):
    r = random.Random(7)
    rows, base = {}, [[f"w{r.randrange(400)}" for _ in range(250)] for _ in range(12)]
    for i in range(150):
        words = list(base[i % 12])
        for _ in range(r.randrange(0, 9)):
            words[r.randrange(250)] = f"new{r.randrange(10**6)}"
        rows[i] = " ".join(words)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id for x in corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()} == brute_representatives(rows)


def test_groups_around_the_threshold_in_small_parts(spark, sf, monkeypatch):
    """A large group whose pairs lie on both sides of 0.8, cut into many parts."""
    monkeypatch.setattr(shingles, "PART_BYTES", 12_000)
    monkeypatch.setattr(shingles, "NEXT", 1)
    r = random.Random(11)
    base, rows = [f"w{r.randrange(4000)}" for _ in range(150)], {}
    for i in range(120):
        words = list(base)
        for _ in range(r.randrange(2, 7)):
            words[r.randrange(150)] = f"new{r.randrange(10**6)}"
        rows[i] = " ".join(words)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_representatives(rows)
    assert 1 < len(want) < 120
    assert {x.doc_id for x in corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()} == want


def test_stage_matches_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_representatives({x.doc_id: x.text for x in docs.collect()})
    assert {x.doc_id for x in corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()} == want
