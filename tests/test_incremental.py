"""Indexes and tables that batches change: equal to those made anew, one step or none, and only what is touched is read or written."""

import random

import pytest
from pyspark.sql import functions as F

from lodestore.operators import search as S
from lodestore.operators import segments as G
from lodestore.session import own_dir
from lodestore.sources import buckets, manifest
from lodestore.sources.buckets import BucketTable

ROW = "id long, text string, deleted boolean, at int"


@pytest.fixture
def folder(spark, request):
    return f"{own_dir(spark)}/{request.node.name.replace('[', '-').replace(']', '')}-{random.randrange(1 << 40)}"


def changes(spark, rows):
    return spark.createDataFrame(rows, ROW)


@pytest.mark.parametrize("fanout", [2, 3])
def test_segments_equal_one_index(spark, folder, fanout):
    rng = random.Random(fanout)
    word = lambda: rng.choice(["alpha", "alphabet", "beta", "gamma", "delta", "the", "Él"])
    final, index = {}, G.SegmentIndex(spark, folder, fanout=fanout, files=2)
    for batch in range(5):
        rows = [(rng.randrange(30), None if rng.random() < 0.1 else " ".join(word() for _ in range(rng.randrange(6))), rng.random() < 0.25, i) for i in range(12)]
        if batch == 3:
            rows += [(None, "alpha beta", False, 0)]
        for i, text, gone, _ in rows:
            final.pop(i, None) if gone else final.__setitem__(i, text or "")
        assert index.apply(changes(spark, rows), batch) and not index.apply(changes(spark, rows), batch)
    docs = spark.createDataFrame(list(final.items()), "id long, text string")
    queries = {0: "alpha the the", 1: "beta nothing", 2: "él"}
    pick = lambda df: sorted(map(tuple, df.select("qid", "id", F.round("score", 9)).collect()), key=str)
    again = G.SegmentIndex(spark, folder, fanout=fanout)
    assert pick(again.bm25(queries)) == pick(S.bm25(docs, queries))
    assert len(again.state["segments"]) < 5 and again.state["docs"] == len(final)
    # a prefix counts all terms that begin with it as one
    got = {(r.qid, r.id): (r.tf, r.asked) for r in again.matches({0: "alph"}, prefix=True).collect()}
    want = {(0, i): (n, "alph") for i, t in final.items() if (n := sum(w.startswith("alph") for w in t.lower().split()))}
    assert got == want
    assert {r.id for r in again.bm25({0: "alph bet"}, prefix=True, every=True).collect()} == {i for i, t in final.items() if all(any(w.startswith(p) for w in t.lower().split()) for p in ("alph", "bet"))}
    gone = again.vacuum()
    assert gone and pick(G.SegmentIndex(spark, folder).bm25(queries)) == pick(S.bm25(docs, queries))


def test_a_prefix_reads_the_files_of_its_range(spark, folder):
    index = G.SegmentIndex(spark, folder, files=8)
    index.apply(spark.range(2000).selectExpr("id", "concat('w', lpad(id, 5, '0'), ' common') AS text", "false AS deleted"), 0)
    every = index.files_of([("", G.LAST)])
    some = index.files_of([("w0001", "w0001" + G.LAST)])
    assert len(every) == 8 and len(some) <= 2
    read = index.matches({0: "w0001"}, prefix=True)
    assert read.count() == 10
    rows = index._postings(some)
    assert set(rows.inputFiles()) <= {f for _, f in some}
    assert "StringStartsWith(term" in rows.filter(F.startswith("term", F.lit("w0001")))._jdf.queryExecution().executedPlan().toString()


def test_an_index_without_documents(spark, folder):
    index = G.SegmentIndex(spark, folder)
    index.apply(changes(spark, [(1, "a", True, 0)]), 0)
    assert index.bm25({0: "a"}).count() == 0 and index.bm25({0: " "}).count() == 0 and index.documents().count() == 0


def test_untouched_buckets_keep_their_files(spark, folder):
    rows = spark.range(1000).selectExpr("id", "cast(id AS string) AS name", "0 AS hits")
    table = BucketTable(spark, folder, ["id"], 32)
    assert table.upsert(rows, 0)
    before, old = table.files(), BucketTable(spark, folder, ["id"])
    few = spark.createDataFrame([(5, "five", 9), (5, "fivf", 8), (70, "seventy", 7), (5000, "new", 6)], "id long, name string, hits int")
    assert table.upsert(few, 1, keep=["hits"])
    changed = {b for b, p in table.files().items() if before.get(b) != p}
    assert 1 <= len(changed) <= 3 and len(before) == 32
    got = {r.id: (r.name, r.hits) for r in table.read().collect()}
    assert (got[5], got[70], got[5000], got[6], len(got)) == (("fivf", 0), ("seventy", 0), ("new", 6), ("6", 0), 1001)
    assert {r.id: r.name for r in old.read().collect()}[5] == "5"  # pinned to its version
    # a batch that is retried changes nothing, also from a process that starts anew
    files = table.files()
    assert not table.upsert(few, 1) and not BucketTable(spark, folder, ["id"]).upsert(few, 1)
    assert BucketTable(spark, folder, ["id"]).files() == files
    # of two writers one loses, and the table is the other's
    with pytest.raises(manifest.ConflictError):
        old.upsert(few.withColumn("name", F.lit("lost")), 7)
    assert {r.name for r in BucketTable(spark, folder, ["id"]).read().filter("id = 5").collect()} == {"fivf"}
    assert table.vacuum() and table.read().count() == 1001


def test_replace_and_delete_by_key(spark, folder):
    table = BucketTable(spark, folder, ["file"], 4)
    rows = lambda r: spark.createDataFrame(r, "file string, line long")
    with pytest.raises(ValueError, match="no table"):
        table.read()
    table.replace(rows([("a", 1), ("a", 2), ("a", 2), ("b", 1), (None, 1), (None, 2)]), 0)
    table.replace(rows([("a", 9), (None, 7)]), 1)
    table.delete(spark.createDataFrame([("b",)], "file string"), 2)
    assert sorted(map(tuple, table.read().collect()), key=str) == [("a", 9), (None, 7)]
    table.replace(rows([]), 3)
    table.delete(spark.createDataFrame([("a",), (None,), ("zzz",)], "file string"), 4)
    assert table.read().count() == 0 and table.state["batch"] == 4


def test_a_stream_changes_a_table_once(spark, folder, monkeypatch):
    """A batch that fails after it was applied is retried and not applied twice."""
    spark.createDataFrame([(1, 1), (2, 1)], "id long, n int").write.parquet(f"{folder}/in")
    table, calls = BucketTable(spark, f"{folder}/t", ["id"], 4), []

    def once(t, df, n):
        calls.append(t.upsert(df, n))
        if len(calls) == 1:
            raise RuntimeError("lost")

    stream = lambda: spark.readStream.schema("id long, n int").parquet(f"{folder}/in")
    with pytest.raises(Exception, match="lost"):
        buckets.follow(table, stream(), f"{folder}/c", once)
    buckets.follow(BucketTable(spark, f"{folder}/t", ["id"]), stream(), f"{folder}/c", once)
    assert calls == [True, False] and BucketTable(spark, f"{folder}/t", ["id"]).version == 1
