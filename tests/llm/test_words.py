"""Licence scan, ranked search and resampling against plain versions, and their odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lodestore.llm import licenses, maxscore, resample
from lodestore.llm.licenses import Template
from lodestore.llm.words import plain_words
from tests import oracle
from tests.test_plans import plan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def make(spark, rows, names="doc_id long, text string"):
    return spark.createDataFrame(rows, names)


ODD = [
    (1, "Under the MIT License. Under the mit license; under, the MIT license"), (2, None), (3, ""), (4, " .,!? \n\t"), (None, "Apache License, Version 2.0 and more"), (None, "apache license version 3"),
    (5, "Été ÀÉ straße İstanbul çà 12 a1b2 CC-BY-NC"), (5, "Été ÀÉ straße İstanbul çà 12 a1b2 CC-BY-NC"), (6, "under the the mit license mit"), (7, "license mit the under " * 20), (8, "cc by nc " * 3000),
    (9, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction"),
    (10, "x Permission is hereby granted, free of charge, to all people obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction!"),
    (11, " ".join(f"w{i * i % 7919}" for i in range(9000))), (12, "GNU General Public License version 3"), (13, "this work is licensed under the GNU General Public License, version 3."),
]


def plain_matches(rows, templates, rare=4):
    """Every alignment of every template by direct comparison."""
    vocab = {w for t in templates for w in t.notice.split()}
    df = Counter(w for _, text in rows for w in set(words(text)) & vocab)
    n = len(rows)
    idf = {w: math.log((2 * n + 2) / (2 * df[w] + 1)) for w in vocab}
    out = []
    for i, text in rows:
        ws = words(text)
        found = []
        for t in templates:
            tw, must = t.notice.split(), licenses.mandatory(t)
            look = sorted(set(ws) & set(tw), key=lambda w: (df[w], w))[:rare]
            asked = [o for o, w in enumerate(tw) if w in look]
            for a in range(len(ws)):
                at = lambda o: ws[a + o] if a + o < len(ws) else None  # noqa: B023, E731
                if asked and 2 * sum(at(o) == tw[o] for o in asked) >= len(asked) and all(at(o) == tw[o] for o in must):
                    found.append((t.label, t.base, a, a + len(tw), round(sum(idf[w] for o, w in enumerate(tw) if at(o) == w) / sum(idf[w] for w in tw), 6)))
        out.append((i, len(ws), sorted(found)))
    return sorted(out, key=str)


def test_words_are_the_same_in_a_task():
    for _, text in ODD:
        assert [w.decode() for w in plain_words(text)] == words(text)


@pytest.mark.parametrize("templates", [licenses.TEMPLATES, (Template("a", "b c b c d", ("b c",)), Template("a", "b c d", ("d",), True), Template("z", "q q q q", ("q q",)))])
def test_licence_matches_equal_all_alignments(spark, templates):
    rows = ODD + [(20 + i, " ".join("bcdq"[(i * j + j // 3) % 4] for j in range(40))) for i in range(8)]
    got = licenses.licence_matches(make(spark, rows), templates=templates).collect()
    assert sorted(((r["id"], r["n_words"], sorted(tuple(m) for m in r["matches"])) for r in got), key=str) == plain_matches(rows, templates)


def test_every_place_of_a_phrase_counts(spark):
    got = {r["id"]: r["matches"] for r in licenses.licence_matches(make(spark, ODD)).collect()}
    assert sorted(m["start"] for m in got[1] if m["base"]) == [0, 4, 8]
    assert [m["start"] for m in got[6] if m["base"]] == []  # a word between
    assert sum(m["base"] for m in got[8]) == 3000 and {m["score"] for m in got[8] if m["base"]} == {1.0}
    # other words in the place of some leave the notice recognised, words missing or added don't shift the key phrases
    assert {m["label"] for m in got[10]} == {"mit"} and 0 < max(m["score"] for m in got[10]) < 1 and got[9] == []
    assert {m["label"] for m in got[13]} == {"gpl-3"}


def test_key_phrases_must_be_in_their_notice():
    with pytest.raises(ValueError, match="not in its notice"):
        licenses.mandatory(Template("x", "a b c", ("a c",)))


def plain_search(rows, items, k):
    docs = [(i, Counter(words(t)), len(words(t))) for i, t in rows]
    n, total = sum(1 for d in docs if d[2]), sum(d[2] for d in docs)
    df = Counter(w for d in docs for w in d[1])
    out = []
    for item, text in items:
        scored = []
        for i, tf, size in docs:
            if size:
                m = 100 - 50 + 50 * size * n // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 20 * m)) for w in set(words(text)) if w in tf)
                if s > 0:
                    scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "shard_terms", "block_chars"), [(50, 1 << 20, 1 << 20), (3, 40, 60), (1, 1, 1)])
def test_search_equals_scoring_all(spark, k, shard_terms, block_chars):
    rows = ODD + [(100 + i, " ".join(f"t{(i * j) % 17}" for j in range(3 + i % 40))) for i in range(120)] + [(300, "t1 t2"), (300, "t1 t2"), (301, "t2 t1")]
    items = [(1, "t1 t2 t3 t3 T1"), (1, "t16 license"), (2, None), (3, "nothing here"), (None, "été the t0"), (4, ""), (5, " ".join(f"t{i}" for i in range(17)))]
    got = maxscore.ranked_search(make(spark, rows).repartition(3), make(spark, items, "item_id long, text string"), k=k, shard_terms=shard_terms, block_chars=block_chars)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(rows, items, k)


def test_search_reads_few_postings_of_common_terms():
    """A common term's list is probed, not read, once rare terms fill the best."""
    import numpy as np

    n = 1000
    at = np.concatenate([np.arange(60), np.arange(n)])
    term = np.concatenate([np.zeros(60, np.int32), np.ones(n, np.int32)])
    shard = maxscore.Shard(np.arange(n), np.zeros(n, bool), np.full(n, 100), term, at, np.array([5000, 1]))
    best = maxscore.Best(50)
    read = []
    whole = maxscore.Shard._kth

    def kth(score, k):
        read.append(len(score))
        return whole(score, k)

    maxscore.Shard._kth = staticmethod(kth)
    try:
        shard.search(np.array([0, 1]), best)
    finally:
        maxscore.Shard._kth = staticmethod(whole)
    assert best.doc.tolist() == list(range(50)) and max(read) == 60


def plain_resample(rows, target, n, buckets, percent, min_words, seed):
    def runs(text):
        ws = words(text)
        return [" ".join(ws[i : i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)]

    b = lambda run: zlib.crc32(run.encode()) % buckets
    s, t = Counter(b(r) for _, x in rows for r in runs(x)), Counter(b(r) for x in target for r in runs(x))
    sa, ta = sum(s.values()), sum(t.values())
    gain = lambda x: math.floor(1000 * math.log((t[x] + 1) * (sa + buckets) / ((s[x] + 1) * (ta + buckets))))
    out = []
    for i, text in rows:
        rs = runs(text)
        w = sum(gain(b(r)) for r in rs) // len(rs) if rs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words(text)), len(rs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = defaultdict(list)
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        rank[r].append(k + 1)
    return sorted(((*r, rank[r].pop() if rank.get(r) else None) for r in out), key=str)


@pytest.mark.parametrize(("n", "chunk_words", "long_chars", "percent"), [(1, 4096, 1 << 16, 10), (3, 7, 20, 60), (2, 1, 0, 100), (1, 3, 10, 0)])
def test_resample_equals_plain_version(spark, n, chunk_words, long_chars, percent):
    rows = ODD + [(100 + i, " ".join(f"t{(i * j) % 17}" for j in range(3 + i % 60))) for i in range(90)]
    target = [(1, "t1 t2 t3 the mit license"), (2, None), (3, "")]
    got = resample.resample(make(spark, rows), make(spark, target, "item_id long, text string"), n=n, buckets=97, percent=percent, chunk_words=chunk_words, long_chars=long_chars)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resample(rows, [t for _, t in target], n, 97, percent, 20, 2024)


def test_long_texts_are_dealt(spark):
    """Chunks of a long text are dealt by their number, each with its own starts and the carried words."""
    text = " ".join(f"w{i}" for i in range(1000))
    chunks = resample.long_chunks(make(spark, [(1, text)]), "text", 100, 3, 100)
    rows = chunks.select("_chunk", "_words", "_runs").collect()
    assert [len(r["_words"]) for r in sorted(rows)] == [102] * 9 + [100] and sum(len(r["_runs"]) for r in rows) == 1000 + 999 + 998
    assert re.search(r"hashpartitioning\(doc_id#\d+L, _a#\d+L, _b#\d+, _chunk#\d+", plan(chunks))


@pytest.mark.parametrize("name", ["op11", "op12", "op13"])
def test_empty_and_clashing_tables(spark, docs, empty, name):
    items = spark.createDataFrame([(1, "alpha word1")], "item_id long, text string")
    ops = {
        "op11": lambda d: licenses.licence_matches(d), "op12": lambda d: maxscore.ranked_search(d, items), "op13": lambda d: resample.resample(d, items),
    }
    assert ops[name](empty).count() == 0
    clash = docs.selectExpr("*", "1 AS item_id", "2 AS rank", "3 AS _words", "4 AS ws", "5 AS weight", "6 AS held", "7 AS query", "8 AS doc")
    plain = docs.select("doc_id", "text")
    assert sorted(map(str, ops[name](clash).collect())) == sorted(map(str, ops[name](plain).collect()))
    if name != "op12":
        assert ops[name](clash).count() == docs.count()
    else:
        assert maxscore.ranked_search(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize(("query", "sql"), [(licenses.op11, licenses.OP11_SQL), (maxscore.op12, maxscore.OP12_SQL), (resample.op13, resample.OP13_SQL)])
def test_queries_equal_their_sql(spark, sf, query, sql):
    assert oracle.spark_rows(query(spark, sf)) == oracle.sql_rows(oracle.connect(sf), sql)
