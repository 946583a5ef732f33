"""Queries over indexes and tables that are kept up to date batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestore.operators import search as S
from lodestore.operators import segments as G
from lodestore.plans import data as D
from lodestore.plans.search_queries import _bm25_sql
from lodestore.session import own_dir
from lodestore.sources.buckets import BucketTable

Q, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


#: three batches of changes to an index of documents: all but some, replacements and deletions, some of the deleted again
CHANGES = (
    ("doc_id % 7 <> 5", "text", "false"),
    ("doc_id % 10 IN (3, 7)", "concat('the new text that follows ', text)", "doc_id % 10 = 7"),
    ("doc_id % 20 = 7 OR doc_id % 70 = 5", "concat_ws(' ', source, lang, 'the', 'the', source)", "false"),
)
SEARCHES = {0: "the of that the", 1: "new text", 2: "und der", 3: "src en"}
FINAL = """c AS (
  SELECT doc_id, 0 AS b, text, false AS gone FROM documents WHERE doc_id % 7 <> 5 UNION ALL
  SELECT doc_id, 1, 'the new text that follows ' || coalesce(text, ''), doc_id % 10 = 7 FROM documents WHERE doc_id % 10 IN (3, 7) UNION ALL
  SELECT doc_id, 2, concat_ws(' ', source, lang, 'the', 'the', source), false FROM documents WHERE doc_id % 20 = 7 OR doc_id % 70 = 5),
f AS (SELECT doc_id, max_by(text, b) AS text, max_by(gone, b) AS gone FROM c GROUP BY doc_id),
final AS (SELECT doc_id, coalesce(text, '') AS text FROM f WHERE NOT gone)"""


@query(
    "stream_index_search",
    f"WITH {FINAL}, {_bm25_sql(SEARCHES, 'final')}, r AS (SELECT qid::INTEGER AS qid, id AS doc_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) - 1)::INTEGER AS rank FROM bm) SELECT * FROM r WHERE rank < 20",
)
def _(s, d):
    """The index follows a stream of changes through three runs, each going on at the checkpoint of the one before."""
    base = f"{own_dir(s)}/follow-{uuid.uuid4().hex}"
    docs = D.table(s, d, "documents")
    for part, text, gone in CHANGES:
        batch = docs.filter(part).select(F.col("doc_id").alias("id"), F.expr(text).alias("text"), F.expr(gone).alias("deleted"))
        batch.write.mode("append").option("compression", "zstd").parquet(f"{base}/changes")
        G.follow(G.SegmentIndex(s, f"{base}/index", fanout=3), s.readStream.schema(batch.schema).parquet(f"{base}/changes"), f"{base}/checkpoint")
    return S.top(G.SegmentIndex(s, f"{base}/index").bm25(SEARCHES), 20, ["qid"]).withColumnRenamed("id", "doc_id")


PREFIXES = {0: "wid re", 1: "sup 0000000", 2: "customer 00000000", 3: "sm", 4: "b r"}
NAMES = """names AS (
  SELECT p_partkey * 3 AS id, p_name AS name FROM part UNION ALL SELECT s_suppkey * 3 + 1, s_name FROM supplier UNION ALL SELECT c_custkey * 3 + 2, c_name FROM customer)"""
_ASKED = ", ".join(f"({i}, '{t}')" for i, q in PREFIXES.items() for t in q.split())


@query(
    "prefix_index_search",
    f"""WITH {NAMES}, k AS (SELECT id, list_filter(string_split_regex(lower(name), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS toks FROM names),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM k),
q AS (SELECT * FROM (VALUES {_ASKED}) v(qid, asked)),
h AS (SELECT qid, asked, id, len(toks) AS dl, len(list_filter(toks, lambda t: starts_with(t, asked))) AS tf FROM k, q),
m AS (SELECT * FROM h WHERE tf > 0),
df AS (SELECT qid, asked, count(*) AS df FROM m GROUP BY ALL),
sc AS (SELECT qid, id, sum(greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score, count(*) AS found FROM m JOIN df USING (qid, asked), st GROUP BY qid, id),
e AS (SELECT sc.* FROM sc JOIN (SELECT qid, count(*) AS wanted FROM q GROUP BY qid) USING (qid) WHERE found = wanted),
r AS (SELECT qid::INTEGER AS qid, id, round(score, 6) AS score, (row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) - 1)::INTEGER AS rank FROM e)
SELECT * FROM r WHERE rank < 20""",
)
def _(s, d):
    """Names of parts, suppliers and customers by the beginnings of their words; only files whose terms may begin so are read."""
    names = None
    for i, (table, key, name) in enumerate((("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"))):
        one = D.table(s, d, table).select((F.col(key) * 3 + i).alias("id"), F.col(name).alias("text"), F.lit(False).alias("deleted"))
        names = one if names is None else names.unionByName(one)
    index = G.SegmentIndex(s, f"{own_dir(s)}/names-{uuid.uuid4().hex}", G.name_tokens)
    index.apply(names, 0)
    return S.top(index.bm25(PREFIXES, prefix=True, every=True), 20, ["qid"])


UPSERTED = """c AS (
  SELECT o_orderkey AS id, 0 AS b, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 9 <> 4 UNION ALL
  SELECT o_orderkey, 1, 'X', o_totalprice + 1 FROM orders WHERE o_custkey IN (SELECT min(o_custkey) FROM orders UNION ALL SELECT max(o_custkey) FROM orders) UNION ALL
  SELECT o_orderkey, 2, 'N', o_totalprice * 2 FROM orders WHERE o_orderkey % 90 = 4)"""


@query("bucket_upsert", f"WITH {UPSERTED} SELECT id, max_by(status, b) AS status, max_by(price, b) AS price, max(b)::INTEGER AS changed FROM c GROUP BY id")
def _(s, d):
    """Orders by key: a first load, the orders of two customers changed, others added."""
    o = D.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust"))
    ends = o.agg(F.min("cust").alias("lo"), F.max("cust").alias("hi"))  # one row
    two = o.join(F.broadcast(ends), (F.col("cust") == F.col("lo")) | (F.col("cust") == F.col("hi")))
    batches = (
        o.filter("id % 9 <> 4").select("id", "status", "price", F.lit(0).alias("changed")),
        two.select("id", F.lit("X").alias("status"), (F.col("price") + 1).alias("price"), F.lit(1).alias("changed")),
        o.filter("id % 90 = 4").select("id", F.lit("N").alias("status"), (F.col("price") * 2).alias("price"), F.lit(2).alias("changed")),
    )
    table = BucketTable(s, f"{own_dir(s)}/orders-{uuid.uuid4().hex}", ["id"], 16)
    for i, b in enumerate(batches):
        table.upsert(b, i)
    return table.read()


@query(
    "bucket_replace",
    """WITH first AS (SELECT * FROM lineitem WHERE l_orderkey % 11 <> 3),
new AS (SELECT l_orderkey, 'new' AS flag, l_quantity FROM lineitem WHERE l_orderkey % 50 = 1 AND l_linenumber = 1)
SELECT l_orderkey AS file, l_returnflag AS kind, l_quantity AS size FROM first WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new) AND l_orderkey % 100 <> 2
UNION ALL SELECT l_orderkey, flag, l_quantity FROM new""",
)
def _(s, d):
    """Lines as what is known of an order's file: some files are read again, of others nothing is left."""
    rows = D.table(s, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("size"), F.col("l_linenumber").alias("line"))
    table = BucketTable(s, f"{own_dir(s)}/files-{uuid.uuid4().hex}", ["file"], 16)
    table.replace(rows.filter("file % 11 <> 3").drop("line"), 0)
    table.replace(rows.filter("file % 50 = 1 AND line = 1").select("file", F.lit("new").alias("kind"), "size"), 1)
    table.delete(rows.filter("file % 100 = 2").select("file"), 2)
    return table.read()


@query(
    "bucket_cache",
    """WITH e AS (SELECT event_type || ':' || user_id AS hash, ts, event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 3 END AS b FROM events),
l AS (SELECT hash, b, max_by(event_id, (ts, event_id)) AS answer, count(*) AS n FROM e GROUP BY hash, b),
f AS (SELECT hash, min(b) AS first, max(b) AS last FROM l GROUP BY hash)
SELECT hash, max(answer) FILTER (WHERE b = last) AS answer, max(n) FILTER (WHERE b = first) AS hits FROM l JOIN f USING (hash) GROUP BY hash""",
)
def _(s, d):
    """Answers by request: a new answer of a known request replaces the old one and keeps its hits."""
    e = D.table(s, d, "events").select(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("hash"), "ts", "event_id")
    table = BucketTable(s, f"{own_dir(s)}/answers-{uuid.uuid4().hex}", ["hash"], 16)
    for i in range(3):
        new = e.filter(F.col("event_id") % 3 == i).groupBy("hash").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("answer"), F.count("*").alias("hits"))
        table.upsert(new, i, keep=["hits"])
    return table.read()
