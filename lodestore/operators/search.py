"""Full-text, vector and fused ranking over DataFrames.

Texts are a frame (id, text). Ranks are by score rounded to six places, then id, so that every
engine breaks ties alike. Query terms and vectors are literals in the plan or small frames;
postings are joined on the term, and only postings of query terms leave the scan's stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.functions import text as X
from lodestore.functions.vector import cosine
from lodestore.session import materialize

K1, B, RRF_K = 1.2, 0.75, 60


def searchable_research(topic: Column, tags: Column, finding: Column, entities: Column) -> Column:
    return F.concat_ws(" ", topic, F.array_join(tags, " "), finding, F.array_join(entities, " "))


def searchable_script(name: Column, description: Column, tags: Column) -> Column:
    """Name and tags count twice."""
    t = F.array_join(tags, " ")
    return F.concat_ws(" ", name, t, name, description, t)


def searchable_decision(decision: Column, rationale: Column, category: Column) -> Column:
    """The category counts twice: as topic and in the text."""
    return F.concat_ws(" ", category, decision, rationale, category)


def searchable_exploration(query: Column, tags: Column, files: Column, entities: Column) -> Column:
    t, e = F.array_join(tags, " "), F.array_join(entities, " ")
    return F.concat_ws(" ", query, t, query, F.array_join(files, " "), e, t, e)


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, dl): the inverted index, dl being the document's length in tokens."""
    t = docs.select(F.col(id_col).alias("id"), X.tokens(F.col(text_col)).alias("toks"))
    t = t.select("id", F.size("toks").cast("long").alias("dl"), F.explode("toks").alias("term"))
    return t.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row (n, avgdl)."""
    return docs.select(F.size(X.tokens(F.col(text_col))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(df: DataFrame, queries: dict[int, str]) -> DataFrame:
    """(qid, term, mult): terms with how often each query repeats them. Queries are few and given in the plan."""
    given = F.array(*(F.struct(F.lit(i).cast("int").alias("qid"), F.lit(q).alias("q")) for i, q in sorted(queries.items())))
    q = df.sparkSession.range(1).select(F.inline(given))
    return q.select("qid", F.explode(X.tokens(F.col("q"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("mult"))


def bm25(docs: DataFrame, queries: dict[int, str], id_col: str = "id", text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(qid, id, score) of documents that have a query term.

    Texts are tokenised once: each document's length and query terms are written to the shared
    folder, a few bytes a document, and the corpus figures (n, average length, document
    frequencies, over all documents) and the matches are read from there. What is shuffled is the
    matches, not the corpus; the table of weights has a row per query term.
    """
    terms = query_terms(docs, queries)
    wanted = [r.term for r in terms.select("term").distinct().orderBy("term").collect()]
    toks = docs.select(F.col(id_col).alias("id"), X.tokens(F.col(text_col)).alias("toks"))
    lens = materialize(toks.select("id", F.size("toks").cast("long").alias("dl"), F.filter("toks", lambda t: t.isin(*wanted) if wanted else F.lit(False)).alias("hits")), "bm25")
    stats = lens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = lens.filter(F.size("hits") > 0).select("id", "dl", F.explode("hits").alias("term")).groupBy("id", "term").agg(F.first("dl").alias("dl"), F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weight = terms.join(df, "term").crossJoin(stats)  # stats is one row
    idf = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    part = F.col("mult") * idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)))
    return hits.join(F.broadcast(weight), "term").groupBy("qid", "id").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, k: int, partition: Sequence[str] = (), id_col: str = "id", score_col: str = "score") -> DataFrame:
    """The k best rows, per ``partition`` if given, with 0-based ``rank``; scores are rounded first."""
    s = scored.withColumn(score_col, F.round(score_col, 6))
    if not partition:
        s = s.orderBy(F.desc(score_col), id_col).limit(k)
    w = W.partitionBy(*partition).orderBy(F.desc(score_col), id_col)
    return s.withColumn("rank", (F.row_number().over(w) - 1).cast("int")).filter(F.col("rank") < k)


def cosine_scores(vectors: DataFrame, query: Sequence[float], id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id, score) of every vector against one query vector, which is a literal of the plan."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(F.col(id_col).alias("id"), cosine(F.col(vec_col), q).alias("score"))


def fuse(lists: dict[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """(id, score, sources): reciprocal-rank fusion of ranked lists (id, rank)."""
    every = None
    for label, ranked in lists.items():
        part = ranked.select("id", (F.lit(1.0) / (F.lit(k) + F.col("rank") + 1)).alias("r"), F.lit(label).alias("source"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("id").agg(F.sum("r").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))


def hybrid(docs: DataFrame, vectors: DataFrame, text_query: str, vector_query: Sequence[float], candidates: int = 20, limit: int = 10) -> DataFrame:
    """(id, score, sources): the best of BM25 and cosine, each limited before they are fused."""
    lists = {"bm25": top(bm25(docs, {0: text_query}).select("id", "score"), candidates), "embedding": top(cosine_scores(vectors, vector_query), candidates)}
    return top(fuse(lists), limit)


def prefix_search(nodes: DataFrame, query: str, cols: Sequence[str], key: str, limit: int = 20) -> DataFrame:
    """Rows with, for each white-space term of the query, a token that starts with it; by hits, then key."""
    terms = [t for t in query.lower().split() if t]
    toks = F.filter(F.split(F.lower(F.concat_ws(" ", *cols)), "[^\\p{L}\\p{N}]+"), lambda t: F.length(t) > 0)
    f = nodes.withColumn("_t", toks)
    hits = F.lit(0)
    for t in map(F.lit, terms):
        n = F.size(F.filter("_t", lambda x: F.startswith(x, t)))  # noqa: B023  used before the next turn
        f = f.filter(n > 0)
        hits = hits + n
    return f.withColumn("hits", hits.cast("long")).drop("_t").orderBy(F.desc("hits"), key).limit(limit)


def like_search(nodes: DataFrame, query: str, cols: Sequence[str]) -> DataFrame:
    """Rows with the query anywhere in a column, ASCII case ignored; its wildcards are literal."""
    safe = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.col(c).ilike(f"%{safe}%")
    return nodes.filter(cond)


def substring_filter(findings: DataFrame, query: str) -> DataFrame:
    """Findings with the query in a tag, the topic or the text."""
    q = query.lower()
    has = lambda c: F.contains(F.lower(X.blank(c)), F.lit(q))
    return findings.filter(has(F.col("topic")) | has(F.col("finding")) | F.coalesce(F.exists("tags", has), F.lit(False)))


def resolve(nodes: DataFrame, name: str, cols: Sequence[str], key: str = "qualified_name") -> DataFrame:
    """The node of that key, else the first that a prefix search finds."""
    exact = nodes.filter(F.col(key) == name).withColumn("_p", F.lit(0)).withColumn("hits", F.lit(0).cast("long"))
    near = prefix_search(nodes, name, cols, key, 1).withColumn("_p", F.lit(1))
    return exact.unionByName(near).orderBy("_p", key).limit(1).drop("_p", "hits")


def staleness_badge(staleness: Column) -> Column:
    return F.when(staleness == "stable", "FRESH").when(staleness == "versioned", "CHECK VERSION").otherwise("VERIFY")


def save_index(docs: DataFrame, path: str, version: str, id_col: str = "id", text_col: str = "text", buckets: int = 64) -> None:
    """Write the inverted index for reuse: postings dealt by term, so a query reads the files of its terms only, and the corpus figures."""
    p = postings(docs, id_col, text_col).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    p.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{version}/postings")
    corpus_stats(docs, text_col).write.mode("overwrite").parquet(f"{path}/{version}/stats")


def indexed_bm25(spark, path: str, version: str, queries: dict[int, str], buckets: int = 64, k1: float = K1, b: float = B) -> DataFrame:
    """``bm25`` from a saved index; the version is the staleness key: another one is another index."""
    every = spark.read.parquet(f"{path}/{version}/postings")
    stats = spark.read.parquet(f"{path}/{version}/stats")
    terms = query_terms(every, queries)
    wanted = [(r.term, r.bucket) for r in terms.select("term", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")).distinct().collect()]
    hits = every.filter(F.col("bucket").isin([x for _, x in wanted]) & F.col("term").isin([t for t, _ in wanted]))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weight = terms.join(df, "term").crossJoin(stats)  # stats is one row
    idf = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    part = F.col("mult") * idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)))
    return hits.join(F.broadcast(weight), "term").groupBy("qid", "id").agg(F.sum(part).alias("score"))


def graph_reranked(scores: DataFrame, entries: DataFrame, hops, best: int = 5, base: float = 0.01) -> DataFrame:
    """(id, score, from_graph): vector scores, and ``base`` for entries that only the graph around the best ones' entities finds.

    ``hops``: a function from entity names to connections (…, src); ``entries``: id, entities.
    The few best entries' entities are fetched to seed the traversal.
    """
    lead = top(scores, best).select("id").join(entries, "id").select(F.explode("entities").alias("e")).distinct()
    seeds = [r.e for r in lead.orderBy("e").collect()]
    if not seeds:
        return scores.withColumn("from_graph", F.lit(False))
    found = hops(seeds).select(F.col("src").alias("id")).distinct().withColumn("g", F.lit(True))
    out = scores.join(found, "id", "full")
    return out.select("id", F.coalesce("score", F.lit(base)).alias("score"), (F.col("score").isNull() & F.col("g")).alias("from_graph"))


def across_projects(stores: dict[str, DataFrame], query: Sequence[float], min_percent: float = 5.0) -> DataFrame:
    """(project, id, percent) of vectors (id, vec) of several projects, best first among those above a share."""
    out = None
    for name, df in stores.items():
        part = cosine_scores(df, query).select(F.lit(name).alias("project"), "id", (F.round(F.col("score") * 1000) / 10).alias("percent"))
        out = part if out is None else out.unionByName(part)
    return out.filter(F.col("percent") > min_percent)
