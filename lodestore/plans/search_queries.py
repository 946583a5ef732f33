"""Text, vector and fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.functions import text as X
from lodestore.functions import vector as V
from lodestore.operators import search as S
from lodestore.plans import data as D

Q, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


SEP = X.SEPARATORS.replace("'", "''")
TOK = f"list_filter(string_split_regex(lower(regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '{SEP}'), lambda t: len(t) > 0)"
TERMS = "the of that the"


def _docs(s, d):
    return D.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query("tokenize_stats", f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {TOK} AS t FROM documents)")
def _(s, d):
    t = D.table(s, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("inverted_index_top_terms", f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY term ORDER BY cf DESC, term LIMIT 50")
def _(s, d):
    p = S.postings(_docs(s, d))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).orderBy(F.desc("cf"), "term").limit(50)


def _bm25_sql(queries: dict[int, str], source: str = "documents", key: str = "doc_id", x: str = "") -> str:
    """CTEs that end in <x>bm(qid, id, score) over the texts of ``source``."""
    vals = ", ".join(f"({i}, '{t}')" for i, q in queries.items() for t in q.split())
    return f"""{x}tok AS (SELECT {key} AS id, {TOK} AS t FROM {source}),
{x}stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {x}tok),
{x}q AS (SELECT qid, term, count(*) AS mult FROM (VALUES {vals}) v(qid, term) GROUP BY ALL),
{x}p AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM {x}tok),
{x}h AS (SELECT id, term, dl, count(*) AS tf FROM {x}p WHERE term IN (SELECT term FROM {x}q) GROUP BY ALL),
{x}df AS (SELECT term, count(*) AS df FROM {x}h GROUP BY term),
{x}bm AS (SELECT qid, id, sum(mult * greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
       FROM {x}h JOIN {x}q USING (term) JOIN {x}df USING (term), {x}stats GROUP BY ALL)"""


@query("bm25_search", f"WITH {_bm25_sql({0: TERMS})} SELECT id AS doc_id, round(score, 6) AS score, (row_number() OVER (ORDER BY round(score, 6) DESC, id) - 1)::INTEGER AS rank FROM bm ORDER BY rank LIMIT 20")
def _(s, d):
    return S.top(S.bm25(_docs(s, d), {0: TERMS}).select("id", "score"), 20).withColumnRenamed("id", "doc_id")


MULTI = {1: "the and", 2: "token secret", 3: "que de la", 4: "nicht der zzz"}


@query("bm25_multi_query", f"WITH {_bm25_sql(MULTI)}, r AS (SELECT qid::INTEGER AS qid, id AS doc_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) - 1)::INTEGER AS rank FROM bm) SELECT * FROM r WHERE rank < 10")
def _(s, d):
    return S.top(S.bm25(_docs(s, d), MULTI), 10, ["qid"]).withColumnRenamed("id", "doc_id")


@query("searchable_text_projection", f"WITH {D.FINDINGS} SELECT id, md5(topic || ' ' || array_to_string(tags, ' ') || ' ' || finding) AS digest, md5(topic || ' ' || array_to_string(tags, ' ') || ' ' || topic || ' ' || finding || ' ' || array_to_string(tags, ' ')) AS script_digest, md5(topic || '. ' || finding) AS embed_digest FROM findings")
def _(s, d):
    f = D.findings(s, d)
    none = F.lit(None).cast("array<string>")
    return f.select("id", F.md5(S.searchable_research(F.col("topic"), F.col("tags"), F.col("finding"), none)).alias("digest"), F.md5(S.searchable_script(F.col("topic"), F.col("finding"), F.col("tags"))).alias("script_digest"), F.md5(F.concat_ws(". ", "topic", "finding")).alias("embed_digest"))


@query("substring_filter", f"WITH {D.FINDINGS} SELECT id, topic FROM findings WHERE contains(lower(topic), 'src1') OR contains(lower(finding), 'token =') OR len(list_filter(tags, lambda t: contains(lower(t), 'token ='))) > 0")
def _(s, d):
    return S.substring_filter(D.findings(s, d), "Token =").select("id", "topic")


VEC0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _vec0(s, d):
    r = D.table(s, d, "embeddings").filter("vec_id = 0").select("embedding").first()
    return list(r[0]) if r else []


def _vecs(s, d):
    return D.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query("cosine_topk", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {VEC0}), 6) AS score, (row_number() OVER (ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], {VEC0}), 6) DESC, vec_id) - 1)::INTEGER AS rank FROM embeddings ORDER BY rank LIMIT 20")
def _(s, d):
    return S.top(S.cosine_scores(_vecs(s, d), _vec0(s, d)), 20).withColumnRenamed("id", "vec_id")


@query("cosine_hits", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {VEC0}) * 1000) / 10 AS percent FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {VEC0}) >= 0.2")
def _(s, d):
    c = S.cosine_scores(_vecs(s, d), _vec0(s, d)).filter("score >= 0.2")
    return c.select(F.col("id").alias("vec_id"), (F.round(F.col("score") * 1000) / 10).alias("percent"))


FUSION = f"""WITH {_bm25_sql({0: TERMS})},
b AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) - 1 AS rank FROM bm ORDER BY rank LIMIT 20),
e AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], {VEC0}), 6) DESC, vec_id) - 1 AS rank FROM embeddings ORDER BY rank LIMIT 20),
f AS (SELECT id, sum(1.0::DOUBLE / (61 + rank)) AS score, list_sort(list(source)) AS sources FROM (SELECT *, 'bm25' AS source FROM b UNION ALL SELECT *, 'embedding' FROM e) GROUP BY id)"""


@query("rrf_fusion", FUSION + " SELECT id, round(score, 6) AS score, array_to_string(sources, '+') AS sources FROM f")
def _(s, d):
    lists = {"bm25": S.top(S.bm25(_docs(s, d), {0: TERMS}).select("id", "score"), 20), "embedding": S.top(S.cosine_scores(_vecs(s, d), _vec0(s, d)), 20)}
    return S.fuse(lists).select("id", F.round("score", 6).alias("score"), F.array_join("sources", "+").alias("sources"))


@query("hybrid_search", FUSION + " SELECT id, round(score, 6) AS score, array_to_string(sources, '+') AS sources, (row_number() OVER (ORDER BY round(score, 6) DESC, id) - 1)::INTEGER AS rank FROM f ORDER BY rank LIMIT 10")
def _(s, d):
    return S.hybrid(_docs(s, d), _vecs(s, d), TERMS, _vec0(s, d)).withColumn("sources", F.array_join("sources", "+"))


@query("quantized_size", "SELECT vec_id, (ceil(len(embedding) * 3 / 8.0) + ceil(len(embedding) / 8.0))::BIGINT AS with_residual, ceil(len(embedding) * 3 / 8.0)::BIGINT AS plain, len(embedding) * 4::BIGINT AS raw FROM embeddings")
def _(s, d):
    n = F.size("embedding")
    return D.table(s, d, "embeddings").select("vec_id", V.quantized_size(n, 3).alias("with_residual"), V.quantized_size(n, 3, False).alias("plain"), (n * 4).cast("long").alias("raw"))


@query("scalar_quantize_error", "WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_transform(embedding::DOUBLE[], lambda x: floor(least(greatest((x + 1) / 2, 0), 1) * 15 + 0.5) / 15.0::DOUBLE * 2 - 1) AS w FROM embeddings) SELECT vec_id, round(list_max(list_transform(list_zip(v, w), lambda p: abs(p[1] - p[2]))), 6) AS worst FROM q")
def _(s, d):
    v = F.col("embedding").cast("array<double>")
    w = V.dequantize(V.quantize(v, 4), 4)
    return D.table(s, d, "embeddings").select("vec_id", F.round(F.array_max(F.zip_with(v, w, lambda a, b: F.abs(a - b))), 6).alias("worst"))


NODES = [(1, "a.b.FindAll", "Method", "src/a/b.cs", "FindAll(x)"), (2, "a.b.FindOne", "Method", "src/a/b.cs", "FindOne()"), (3, "a.Finder", "Class", "src/a/f.cs", None), (4, "z.other", "Function", "lib/z.py", "def other(find)"), (5, "z.percent%x", "Function", "lib/z.py", None)]
NODE_SCHEMA = "id long, qualified_name string, kind string, file_path string, signature string"
NODE_SQL = D.sql_values(NODES, NODE_SCHEMA, "nodes")
FTS = "list_filter(string_split_regex(lower(concat_ws(' ', qualified_name, file_path, signature)), '[^\\p{L}\\p{N}]+'), lambda t: len(t) > 0)"


@query("prefix_search", f"WITH {NODE_SQL}, t AS (SELECT *, {FTS} AS toks FROM nodes), h AS (SELECT *, len(list_filter(toks, lambda x: starts_with(x, 'find'))) AS h1, len(list_filter(toks, lambda x: starts_with(x, 'a'))) AS h2 FROM t) SELECT id, qualified_name, (h1 + h2)::BIGINT AS hits FROM h WHERE h1 > 0 AND h2 > 0 ORDER BY hits DESC, qualified_name LIMIT 20")
def _(s, d):
    return S.prefix_search(D.values(s, NODES, NODE_SCHEMA), "Find a", ["qualified_name", "file_path", "signature"], "qualified_name").select("id", "qualified_name", "hits")


@query("like_search", f"WITH {NODE_SQL} SELECT id, qualified_name FROM nodes WHERE qualified_name ILIKE '%percent\\%%' ESCAPE '\\'")
def _(s, d):
    return S.like_search(D.values(s, NODES, NODE_SCHEMA), "PERCENT%", ["qualified_name"]).select("id", "qualified_name")


@query("fuzzy_resolve", f"WITH {NODE_SQL} SELECT id, qualified_name FROM nodes WHERE id = 4")
def _(s, d):
    return S.resolve(D.values(s, NODES, NODE_SCHEMA), "oth", ["qualified_name", "file_path", "signature"]).select("id", "qualified_name")


@query("staleness_badges", f"WITH {D.FINDINGS} SELECT CASE staleness WHEN 'stable' THEN 'FRESH' WHEN 'versioned' THEN 'CHECK VERSION' ELSE 'VERIFY' END AS badge, count(*) AS n FROM findings GROUP BY 1")
def _(s, d):
    return D.findings(s, d).groupBy(S.staleness_badge(F.col("staleness")).alias("badge")).agg(F.count("*").alias("n"))


SCRIPTS = "(SELECT item_id, 'item ' || item_id || ' tag' || (item_id % 5) || ' ' || 'item ' || item_id || ' ' || text || ' tag' || (item_id % 5) AS text FROM benchmark)"


@query("script_search", f"WITH {_bm25_sql({0: 'the tag1'}, SCRIPTS, 'item_id')} SELECT id, round(score, 6) AS score, (row_number() OVER (ORDER BY round(score, 6) DESC, id) - 1)::INTEGER AS rank FROM bm ORDER BY rank LIMIT 5")
def _(s, d):
    b = D.table(s, d, "benchmark")
    scripts = b.select(F.col("item_id").alias("id"), S.searchable_script(F.concat(F.lit("item "), F.col("item_id").cast("string")), F.col("text"), F.array(F.concat(F.lit("tag"), (F.col("item_id") % 5).cast("string")))).alias("text"))
    return S.top(S.bm25(scripts, {0: "the tag1"}).select("id", "score"), 5)
