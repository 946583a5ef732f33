"""Ranked lexical search of a set of queries by MaxScore, shard by shard.

A task reads its share of the documents and gathers postings of the queries' terms until they
make a shard. In a shard each term's list has an upper bound, the largest share it adds to any
score. A query's lists are read from the highest bound down for as long as a document that holds
only the others could still be among its best (the essential lists); the others are probed for
candidates alone, and a candidate goes as soon as its score and the bounds of the lists not yet
probed stay below the least of the best. What a task has found in earlier shards raises that
least score in later ones. Only each task's best of each query are shuffled.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.llm.words import SQL_WORDS, plain_words, words
from lodestore.session import python_path, read_table

SCALE = 10**9
#: characters of the queries that go to the tasks at once; more make further rounds over the documents
BLOCK_CHARS = 8 << 20
#: occurrences of query terms in a shard
SHARD_TERMS = 1 << 20


class Best:
    """The k highest (score, document) so far: highest score first, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """What a document's score has to reach; an equal one may have the smaller id."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = np.concatenate([self.score, score]), np.concatenate([self.doc, doc]), np.concatenate([self.null, null])
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


class Shard:
    """Postings of some documents: for each term the documents in order and what the term adds to their scores."""

    def __init__(self, doc: np.ndarray, null: np.ndarray, length_part: np.ndarray, term: np.ndarray, at: np.ndarray, weight: np.ndarray):
        self.doc, self.null = doc, null
        key, tf = np.unique(term.astype(np.int64) * len(doc) + at, return_counts=True)
        terms, self.at = np.divmod(key, len(doc))
        self.adds = weight[terms] * (SCALE * tf // (1000 * tf + 20 * length_part[self.at]))
        self.terms, first = np.unique(terms, return_index=True)
        self.first = np.append(first, len(terms))
        self.bound = np.maximum.reduceat(self.adds, first) if len(first) else np.empty(0, np.int64)

    def search(self, query: np.ndarray, best: Best) -> None:
        """Add what this shard has for a query of distinct terms."""
        found = np.searchsorted(self.terms, query)
        lists = [i for i in found[(found < len(self.terms)) & (self.terms[np.minimum(found, len(self.terms) - 1)] == query)]]
        lists.sort(key=lambda i: -self.bound[i])
        rest = int(sum(self.bound[i] for i in lists))
        score = np.zeros(len(self.doc), np.int64)
        least = best.least
        n = 0
        while n < len(lists) and rest >= least:  # essential
            i = lists[n]
            score[self.at[self.first[i] : self.first[i + 1]]] += self.adds[self.first[i] : self.first[i + 1]]
            rest -= int(self.bound[i])
            n += 1
            if rest < least or n & (n - 1) == 0:
                least = max(least, self._kth(score[score > 0], best.k))
        at = np.flatnonzero(score)
        value = score[at]
        for i in lists[n:]:
            can = value + rest >= least
            at, value = at[can], value[can]
            docs, adds = self.at[self.first[i] : self.first[i + 1]], self.adds[self.first[i] : self.first[i + 1]]
            j = np.minimum(np.searchsorted(docs, at), len(docs) - 1)
            value = value + np.where(docs[j] == at, adds[j], 0)
            rest -= int(self.bound[i])
            least = max(least, self._kth(value, best.k))
        keep = value >= least
        best.add(value[keep], self.doc[at[keep]], self.null[at[keep]])

    @staticmethod
    def _kth(score: np.ndarray, k: int) -> int:
        """A score that k documents reach at least."""
        return int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0


def length_part(n: int, docs: int, terms: int) -> int:
    return 50 + 50 * n * docs // terms


def shards(batches: Iterator[pa.RecordBatch], number: dict[bytes, int], weight: np.ndarray, docs: int, terms: int, shard_terms: int) -> Iterator[Shard]:
    """Shards of at most ``shard_terms`` occurrences, unless one document alone has more."""
    doc, null, part, term, size = array("q"), array("b"), array("q"), array("i"), array("q")

    def shard() -> Shard:
        as_np = lambda a, t: np.frombuffer(a, t).copy()
        sizes = as_np(size, np.int64)
        out = Shard(as_np(doc, np.int64), as_np(null, np.int8).astype(bool), as_np(part, np.int64), as_np(term, np.int32), np.repeat(np.arange(len(sizes)), sizes), weight)
        for a in (doc, null, part, term, size):
            del a[:]
        return out

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ws = plain_words(text.as_py())
            here = [n for w in ws if (n := number.get(w)) is not None]
            if here:
                if len(doc) and len(term) + len(here) > shard_terms:
                    yield shard()
                doc.append(i or 0)
                null.append(i is None)
                part.append(length_part(len(ws), docs, terms))
                term.extend(here)
                size.append(len(here))
    if len(doc):
        yield shard()


def best_of_tasks(docs: DataFrame, queries: list[list[bytes]], dfs: dict[bytes, int], n_docs: int, n_terms: int, k: int, shard_terms: int) -> DataFrame:
    """(query, doc, score): of each task and query the k best; ``queries`` are lists of distinct terms that documents hold."""
    number = {w: n for n, w in enumerate(sorted(dfs))}
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * dfs[w] + 1))) for w in sorted(dfs)], np.int64)
    asked = [np.array(sorted(number[w] for w in q), np.int64) for q in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        for shard in shards(batches, number, weight, n_docs, n_terms, shard_terms):
            for q, b in zip(asked, best, strict=True):
                shard.search(q, b)
        for i, b in enumerate(best):
            if len(b.score):
                ids = pa.array(b.doc, pa.int64(), mask=b.null)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), i), pa.int64()), ids, pa.array(b.score, pa.int64())], ["query", "doc", "score"])

    return docs.mapInArrow(run, "query long, doc long, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 50, block_chars: int = BLOCK_CHARS, shard_terms: int = SHARD_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0.

    Weights count all documents. Null, empty and wordless texts hold no terms; items without terms
    have no rows, rows that repeat an item id are each an item. Rows that repeat a document id are
    documents of their own; null ids come after others of their score. Other columns don't matter.
    Empty tables give no rows. Items go to the tasks in blocks of ``block_chars`` characters, each
    block a pass over the documents; results don't depend on it or on ``shard_terms``.
    """
    spark = docs.sparkSession
    python_path(spark)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    q = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    chars = q.agg(F.sum(F.length("text"))).first()[0] or 0
    n_docs, n_terms = d.select(F.size(words("text")).alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not chars or not n_docs:
        return none
    blocks = math.ceil(chars / block_chars)
    q = q.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        here = q.filter(F.col("block") == block)
        asked = [(r["item"], sorted({bytes(w) for w in plain_words(r["text"])})) for r in here.select("item", "text").collect()]
        terms = here.select(F.explode(words("text")).alias("term")).distinct()
        held = d.select(F.explode(F.array_distinct(words("text"))).alias("term")).join(terms, "term", "left_semi").groupBy("term").count()
        dfs = {r["term"].encode(): r["count"] for r in held.collect()}  # no more terms than the block has
        asked = [(item, t) for item, ts in asked if (t := [w for w in ts if w in dfs])]
        if not asked:
            continue
        found = best_of_tasks(d, [t for _, t in asked], dfs, n_docs, n_terms, k, shard_terms)
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
        found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(asked)], "query long, item_id long")
        found = found.join(names, "query").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
        out = found if out is None else out.unionByName(found)
    return none if out is None else out


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all ``documents`` for each ``benchmark`` item. Nulls, empty and long texts, ties, repeated rows and empty tables as in ``ranked_search``."""
    return ranked_search(read_table(spark, f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS} AS ws FROM documents),
c AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS n, sum(len(ws))::BIGINT AS l FROM d),
p AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
t AS (SELECT w, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY w, n),
m AS (SELECT r, doc_id, 50 + (50 * len(ws) * n) // l AS m FROM d, c),
q AS (SELECT DISTINCT i, item_id, w FROM (SELECT row_number() OVER () AS i, item_id, unnest({SQL_WORDS}) AS w FROM benchmark)),
s AS (
  SELECT i, item_id, doc_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN t USING (w) JOIN p USING (w) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS k FROM s WHERE score > 0)
SELECT item_id, k::INT AS "rank", doc_id, score FROM o WHERE k <= 50
"""
