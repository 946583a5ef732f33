import random

import numpy as np
import pytest
import xxhash

from lodestore.llm import golay, simhash
from lodestore.llm.components import connected_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, distance=4):
    part = list(range(len(fps)))

    def find(x):
        while part[x] != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                part[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_match_brute_force():
    r = random.Random(3)
    words = ["The", "ünder", "a", "Zebra", "x1", "fox", "dog."]
    for n in (0, 1, 2, 3, 4, 5, 9, 200):
        text = "".join(r.choice(words) + r.choice([" ", "  ", "\n", "\t\x0b"]) for _ in range(n))
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == 0
    assert simhash.fingerprint("one two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_spark_hash_is_the_same_function(spark):
    assert spark.sql("SELECT xxhash64('one two')").first()[0] & (2**64 - 1) == simhash.fingerprint("one two")


def test_golay_keys_meet_within_two_errors():
    r = np.random.default_rng(1)
    for bits in (21, 22, 23):
        w = r.integers(0, 1 << bits, 400).astype(np.uint32)
        for errors in (0, 1, 2):
            v = w.copy()
            for i in range(len(v)):
                for b in r.choice(bits, errors, replace=False):
                    v[i] ^= np.uint32(1 << int(b))
            for a, b in zip(golay.keys(w, bits), golay.keys(v, bits), strict=True):
                assert set(a.tolist()) & set(b.tolist()) - {-1}


def test_golay_code_is_perfect():
    assert len(set(golay.decode(np.arange(1 << 12, dtype=np.uint32) << np.uint32(11)).tolist())) <= 1 << 12
    one, errors = golay._tables()
    assert len(one) == 23 and len(errors) == 2048 and (errors[1:] > 0).all()


def planted(n, seed):
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = r.choice(out)
        for b in r.sample(range(64), r.randint(1, 6)):
            x ^= 1 << b
        out.append(x)
    hub = r.getrandbits(64)  # a dense group: longer runs than pair by shifts
    return out + [hub ^ (1 << a) ^ (1 << b) for a in range(10) for b in range(a)]


@pytest.mark.parametrize("wide", [False, True])
def test_links_have_the_components_of_all_pairs(spark, wide):
    fps = sorted(set(planted(150, 5)))
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.fingerprint_links(df, wide=wide)
    at = {x: i for i, x in enumerate(signed)}
    for a, b in edges.collect():
        assert a in at and b in at
    found = {r.node: r.component for r in connected_components(edges).collect()}
    want = brute_components(fps)
    groups = {}
    for x, g in zip(signed, want, strict=True):
        groups.setdefault(g, []).append(x)
    assert sum(len(g) > 1 for g in groups.values()) > 20
    for g in groups.values():
        assert {found.get(x, x) for x in g} == {min(g)}


def test_wide_keys_meet_within_four_errors():
    r = np.random.default_rng(6)
    w = r.integers(0, 1 << 63, 600).astype(np.uint64)
    v = w.copy()
    for i in range(len(v)):
        low, bits = simhash.SEGMENTS[i % 3]
        inside = r.choice(bits, i % 5, replace=False) + low  # errors in one segment, and the rest anywhere
        for b in [*inside, *r.choice(64, 4 - i % 5, replace=False)]:
            v[i] ^= np.uint64(1 << int(b))
    keys = [set(), set()]
    for k, x in enumerate((w, v)):
        row, key = simhash.join_keys(x, True)
        keys[k] = set(zip(row.tolist(), key.tolist(), strict=True))
    assert {row for row, _ in keys[0] & keys[1]} == set(range(len(w)))


def test_components_of_chains_and_repeats(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (50, 60), (60, 55)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[60] == got[55] == 50
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(docs, empty):
    got = [tuple(r) for r in simhash.simhash_components(docs).select("id", "fp", "component_id").collect()]
    assert len(got) == docs.count()
    by = {}
    for i, fp, c in got:
        by.setdefault(i, []).append((fp, c))
    assert by[1][0][1] == by[2][0][1] == 1  # case and white space don't count
    assert by[4] == by[5] == by[10] == [(0, 4)] and (0, 4) in by[None]  # no words: fingerprint zero, linked
    assert by[6][0][1] == by[7][0][1] == 6
    assert simhash.simhash_components(empty).count() == 0


def test_one_of_each_group_stays(docs, empty):
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert [i for n, i in ids if not n] == [1, 3, 4, 6, 9]
    assert sum(n for n, _ in ids) == 1  # the null id of a group of its own
    assert simhash.keep_representatives(empty).count() == 0
    again = docs.selectExpr("7 AS doc_id", "'the same words' AS text", "source", "n_chars")
    first = simhash.keep_representatives(again).collect()
    assert len(first) == 1 and simhash.keep_representatives(again.repartition(3)).collect() == first


def test_query_matches_brute_force(spark, sf):
    rows = simhash.op9(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i]) for i in ids]
    want = dict(zip(ids, zip(fps, [ids[c] for c in brute_components(fps)], strict=True), strict=True))
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in rows} == want
