"""Quantization, clustering, compression, sources, tools and streams: mostly queries whose rows SQL cannot give."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore import tools
from lodestore.operators import compress as Z
from lodestore.operators import quantize as V
from lodestore.operators import search as S
from lodestore.operators import snapshot as P
from lodestore.plans import data as D
from lodestore.plans import graph_queries as G
from lodestore.plans.request_queries import BREAKER
from lodestore.plans.search_queries import VEC0, _bm25_sql
from lodestore.plans.session_queries import ORDER
from lodestore.sources import code as C
from lodestore.sources import files as S_
from lodestore.streaming import streams as X
from lodestore.streaming import translate as TR

Q, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _vecs(s, d):
    return D.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query("quantized_bytes", "SELECT vec_id AS id, len(embedding)::INTEGER AS dim, ceil(len(embedding) * 3 / 8.0)::INTEGER AS packed, ceil(len(embedding) / 8.0)::INTEGER AS sign_bytes FROM embeddings")
def _(s, d):
    return V.quantize_vectors(_vecs(s, d)).select("id", "dim", F.length("quantized").alias("packed"), F.length("signs").alias("sign_bytes"))


@query("quantized_roundtrip")
def _(s, d):
    back = V.dequantize_vectors(V.quantize_vectors(_vecs(s, d), 8), 8).withColumnRenamed("vec", "back")
    both = _vecs(s, d).join(back, "id")
    err = F.aggregate(F.zip_with(F.col("vec").cast("array<double>"), "back", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    return both.select("id", F.round(F.sqrt(err), 4).alias("error"))


UNROTATED = """WITH x AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x FROM embeddings), q AS (SELECT id, x, floor(least(greatest((x + 1) / 2, 0), 1) * 255 + 0.5) / 255 * 2 - 1 AS v FROM x)
SELECT id, round(sqrt(sum(power(x - v - CASE WHEN x >= v THEN 0.05 ELSE -0.05 END, 2))), 4) AS error FROM q GROUP BY id"""


@query("quantized_unrotated", UNROTATED)
def _(s, d):
    back = V.dequantize_vectors(V.quantize_vectors(_vecs(s, d), 8, None), 8, None).withColumnRenamed("vec", "back")
    err = F.aggregate(F.zip_with(F.col("vec").cast("array<double>"), "back", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    return _vecs(s, d).join(back, "id").select("id", F.round(F.sqrt(err), 4).alias("error"))


@query("quantized_topk")
def _(s, d):
    packed = V.quantize_vectors(_vecs(s, d), 4)
    return V.similar_to(packed, packed.filter("id % 100 = 0"), 4, 5)


@query("quantized_recall")
def _(s, d):
    packed = V.quantize_vectors(_vecs(s, d), 6)
    return V.quality(V.best_matches(_vecs(s, d), _vecs(s, d).filter("id % 100 = 0"), 3), V.similar_to(packed, packed.filter("id % 100 = 0"), 6, 3))


@query("quantized_cache_stats", "SELECT count(*) AS vectors, sum(ceil(len(embedding) * 3 / 8.0) + ceil(len(embedding) / 8.0))::BIGINT AS bytes, sum(len(embedding) * 4)::BIGINT AS full_bytes, round((1 - sum(ceil(len(embedding) * 3 / 8.0) + ceil(len(embedding) / 8.0))::DOUBLE / sum(len(embedding) * 4)) * 100, 1) AS saved_pct FROM embeddings")
def _(s, d):
    return V.cache_stats(V.quantize_vectors(_vecs(s, d)))


@query("kmeans_clusters")
def _(s, d):
    return P.kmeans(_vecs(s, d), 10)[0]


@query("corpus_snapshot")
def _(s, d):
    return tools.get_corpus_snapshot(tools.Store(D.findings(s, d), D.table(s, d, "benchmark")))


SNAPSHOT = """WITH f AS (
  SELECT doc_id AS id, source AS cluster, 1704067200 + doc_id * 3600 AS epoch, '- ' || substring(text, 1, 60) || ': ' || CASE WHEN len(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS line FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY epoch DESC, id) AS ord FROM f),
u AS (SELECT *, sum(len(line) + 1) OVER (ORDER BY ord, cluster DESC ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT cluster, ord, id, md5(line) AS line FROM u WHERE upto <= 9000"""


@query("snapshot_budget", SNAPSHOT)
def _(s, d):
    """The newest documents of each source within a budget that forces the largest sources to lose their oldest."""
    f = D.findings(s, d)
    return P.snapshot(f, f.select("id", F.element_at("tags", 2).alias("cluster")), 9000).select("cluster", "ord", "id", F.md5("line").alias("line"))


PAIR = """t AS (SELECT regexp_extract_all(text, '(\\s*)([a-zA-Z]+(?:''[a-zA-Z]+)*|\\d+(?:\\.\\d+)?|\\S)') AS g FROM benchmark),
x AS (SELECT unnest(list_zip(g[1:-2], g[2:])) AS p FROM t WHERE len(g) > 1)
SELECT regexp_replace(p[1], '^\\s+', '') AS a, substring(p[2], 2) AS b, count(*) AS n FROM x WHERE regexp_matches(p[2], '^ \\S') GROUP BY ALL"""


@query("bpe_pair_counts", "WITH " + PAIR)
def _(s, d):
    return Z.pair_counts(D.table(s, d, "benchmark"))


@query("bpe_compress")
def _(s, d):
    b = D.table(s, d, "benchmark")
    return Z.compressed(b, Z.train(b), "item_id").select("id", F.round("ratio", 4).alias("ratio"), "lossless")


@query("bpe_merges")
def _(s, d):
    """512 merges learnt from all documents, in their order."""
    return D.values(s, [(i, *p) for i, p in enumerate(Z.train(D.table(s, d, "documents")))], "rank long, a string, b string")


SOURCES = [
    ("src/a.py", "import os\nfrom .b import f\n\nclass A(B):\n    def __init__(self):\n        self.x = f(1)\n\n    def run(self):\n        return os.getcwd()\n\ndef main():\n    A().run()\n"),
    ("src/c.js", "import x from './d.js';\nconst y = require('fs');\nclass C extends Base {\n  constructor() { super(); }\n  go(n) { return helper(n); }\n}\nfunction helper(n) { return n; }\n"),
    ("src/e.cs", "using System.Text;\npublic class E : IFace {\n  public int Run(int n) { return Help(n); }\n}\ninterface IFace {\n}\n"),
]
NODES = [
    ("File", "src/a.py"), ("Class", "src/a.py::A"), ("Constructor", "src/a.py::A.__init__"), ("Method", "src/a.py::A.run"), ("Function", "src/a.py::main"),
    ("File", "src/c.js"), ("Class", "src/c.js::C"), ("Constructor", "src/c.js::C.constructor"), ("Method", "src/c.js::C.go"), ("Function", "src/c.js::helper"),
    ("File", "src/e.cs"), ("Class", "src/e.cs::E"), ("Interface", "src/e.cs::IFace"), ("Method", "src/e.cs::E.Run"),
]


@query("source_nodes", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{q}')" for k, q in NODES) + ") v(kind, qualified_name)")
def _(s, d):
    return C.code_graph(D.values(s, SOURCES, "path string, content string"))[0].select("kind", "qualified_name")


EDGES = [
    ("CALLS", "src/a.py::A.__init__", "f", "src/a.py", 6), ("CALLS", "src/a.py::A.run", "os.getcwd", "src/a.py", 9), ("CALLS", "src/a.py::main", "A", "src/a.py", 12), ("CALLS", "src/a.py::main", "A().run", "src/a.py", 12),
    ("CALLS", "src/c.js::C.go", "helper", "src/c.js", 5), ("CALLS", "src/e.cs::E.Run", "Help", "src/e.cs", 3), ("CONTAINS", "src/a.py::A", "src/a.py::A.__init__", "src/a.py", 5), ("CONTAINS", "src/a.py::A", "src/a.py::A.run", "src/a.py", 8),
    ("CONTAINS", "src/c.js::C", "src/c.js::C.constructor", "src/c.js", 4), ("CONTAINS", "src/c.js::C", "src/c.js::C.go", "src/c.js", 5), ("CONTAINS", "src/e.cs::E", "src/e.cs::E.Run", "src/e.cs", 3), ("IMPORTS", "src/a.py", ".b", "src/a.py", 2),
    ("IMPORTS", "src/a.py", "os", "src/a.py", 1), ("IMPORTS", "src/c.js", "./d.js", "src/c.js", 1), ("IMPORTS", "src/c.js", "fs", "src/c.js", 2), ("IMPORTS", "src/e.cs", "System.Text", "src/e.cs", 1),
    ("INHERITS", "src/a.py::A", "B", "src/a.py", 4), ("INHERITS", "src/c.js::C", "Base", "src/c.js", 3), ("INHERITS", "src/e.cs::E", "IFace", "src/e.cs", 2),
]


@query("source_edges", D.sql_rows(EDGES, "kind string, source_qualified string, target_qualified string, file_path string, line int"))
def _(s, d):
    return C.code_graph(D.values(s, SOURCES, "path string, content string"))[1]


@query("file_hashes", "SELECT doc_id, substring(sha256(text), 1, 16) AS hash FROM documents")
def _(s, d):
    return D.table(s, d, "documents").select("doc_id", S_.file_hash(F.col("text")).alias("hash"))


DOC = "head\n<!-- a -->\nold\n<!-- b -->\ntail"


@query("section_replace", "SELECT * FROM (VALUES (1::BIGINT, 'head' || chr(10) || '<!-- a -->' || chr(10) || 'new' || chr(10) || '<!-- b -->' || chr(10) || 'tail'), (2, 'plain' || chr(10) || '<!-- a -->' || chr(10) || 'new' || chr(10) || '<!-- b -->')) v(id, text)")
def _(s, d):
    t = D.values(s, [(1, DOC), (2, "plain")], "id long, text string")
    return t.select("id", S_.replace_section(F.col("text"), "<!-- a -->", "<!-- b -->", F.lit("new")).alias("text"))


@query("safe_urls", "SELECT page_id, regexp_matches(url, '(?i)^https?://[^\\s/@?#]+(?:[/?#].*)?$') AS safe FROM pages")
def _(s, d):
    return D.table(s, d, "pages").select("page_id", S_.safe_url(F.col("url")).alias("safe"))


def _store(s, d):
    n, e = G._code(s, d)
    name = F.regexp_extract("qualified_name", r"[^.]+$", 0)
    b = D.table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("scope").alias("category"), F.col("text").alias("decision"), F.lit("why").alias("rationale"))
    return tools.Store(D.findings(s, d), b, vectors=_vecs(s, d), triples=D.triples(s, d), nodes=n.select("*", name.alias("name"), F.lit(None).cast("string").alias("signature")), edges=e)


_Q = {0: "the of that"}
_RESEARCH = _bm25_sql(_Q, "(SELECT id, topic || ' ' || array_to_string(tags, ' ') || ' ' || finding AS text FROM findings)", "id")
_DECISION = _bm25_sql(_Q, "(SELECT item_id, 'scope ' || text || ' why scope' AS text FROM benchmark)", "item_id", "d_")
MEMORY = f"""WITH {D.FINDINGS}, {_RESEARCH}, {_DECISION},
b AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) - 1 AS rank FROM bm ORDER BY rank LIMIT 20),
e AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], {VEC0}), 6) DESC, vec_id) - 1 AS rank FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY rank LIMIT 20),
f AS (SELECT id, sum(1.0::DOUBLE / (61 + rank)) AS score, string_agg(source, '+' ORDER BY source) AS sources FROM (SELECT *, 'bm25' AS source FROM b UNION ALL SELECT *, 'embedding' FROM e) GROUP BY id)
(SELECT 'research' AS kind, id, round(score, 6) AS score, (row_number() OVER (ORDER BY round(score, 6) DESC, id) - 1)::INTEGER AS rank, sources FROM f ORDER BY rank LIMIT 10)
UNION ALL (SELECT 'decision', id, round(score, 6), (row_number() OVER (ORDER BY round(score, 6) DESC, id) - 1)::INTEGER AS rank, 'bm25' FROM d_bm ORDER BY rank LIMIT 3)"""


@query("memory_search", MEMORY)
def _(s, d):
    q = D.table(s, d, "embeddings").filter("vec_id = 0").first()
    return tools.memory_search(_store(s, d), "the of that", list(q.embedding) if q else None)


@query("get_context", "SELECT 'research' AS store, count(*) AS n FROM documents UNION ALL SELECT 'decisions', count(*) FROM benchmark UNION ALL SELECT 'nodes', (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'edges', n FROM (WITH " + G.CODE + " SELECT count(*) AS n FROM edges)")
def _(s, d):
    return tools.get_context(_store(s, d))


@query("session_summary", "SELECT (SELECT count(*) FROM documents) AS research, (SELECT count(*) FROM benchmark) AS decisions, (SELECT count(*) FROM events WHERE event_type = 'error') AS unsaved, 'PENDING_SAVES' AS status")
def _(s, d):
    return tools.session_summary(_store(s, d), D.table(s, d, "events").filter("event_type = 'error'"))


@query("graph_context", f"WITH {D.TRIPLES} SELECT 1 AS hop, o AS entity, p AS predicate, s AS target, src, 'in' AS direction FROM triples WHERE o = 'region_1' ORDER BY entity, target, predicate, src LIMIT 20")
def _(s, d):
    return tools.graph_context(_store(s, d), "region_1", 1)


@query("code_search", f"WITH {G.CODE}, n AS (SELECT *, regexp_extract(qualified_name, '[^.]+$') AS name FROM nodes), t AS (SELECT *, list_filter(string_split_regex(lower(concat_ws(' ', name, qualified_name, file_path)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: len(x) > 0) AS toks FROM n), h AS (SELECT *, len(list_filter(toks, lambda x: starts_with(x, 'supp'))) AS a, len(list_filter(toks, lambda x: starts_with(x, '3'))) AS b FROM t) SELECT qualified_name, (a + b)::BIGINT AS hits FROM h WHERE a > 0 AND b > 0 ORDER BY hits DESC, qualified_name LIMIT 20")
def _(s, d):
    return tools.code_search(_store(s, d), "supp 3").select("qualified_name", "hits")


_REL = "(SELECT * FROM (SELECT '{0}' AS relation, {1} AS qualified_name FROM edges WHERE kind = '{2}' AND {3} = 'supp.3') LEFT JOIN (SELECT qualified_name, kind, file_path FROM nodes) USING (qualified_name) ORDER BY qualified_name LIMIT {4})"
_RELS = " UNION ALL ".join(_REL.format(*x) for x in (("caller", "source_qualified", "CALLS", "target_qualified", 20), ("callee", "target_qualified", "CALLS", "source_qualified", 20), ("inheritor", "source_qualified", "INHERITS", "target_qualified", 10), ("test", "target_qualified", "TESTED_BY", "source_qualified", 10)))


@query("code_context", f"WITH {G.CODE} SELECT relation, qualified_name, kind, file_path FROM ({_RELS}) UNION ALL SELECT * FROM (SELECT 'member' AS relation, qualified_name, kind, file_path FROM nodes WHERE parent_name = 'supp.3' ORDER BY qualified_name LIMIT 30)")
def _(s, d):
    return tools.code_context(_store(s, d), "supp.3")


@query(
    "stream_sessions",
    "WITH g AS (SELECT user_id, ts::TIMESTAMP AS ts, CASE WHEN epoch_us(ts::TIMESTAMP) - lag(epoch_us(ts::TIMESTAMP)) OVER w <= 90000000 THEN 0 ELSE 1 END AS cut FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n FROM r GROUP BY user_id, run",
)
def _(s, d):
    emitted = X.run_append(X.sessions(X.stream_table(s, d, "events")))
    every = X.with_open_sessions(emitted, s.read.parquet(f"{d}/events.parquet"))
    return every.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(s, d):
    return X.run_append(X.deduplicated(X.stream_table(s, d, "events"), ["user_id", "event_type"], "60 days").select("user_id", "event_type")).distinct()


@query("stream_rollup", "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    path = f"{X.own_dir(s)}/rollup-{__import__('uuid').uuid4().hex}"
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("date")
    X.daily_upserts(X.stream_table(s, d, "events"), path, lambda b: b.groupBy(day).agg(F.count("*").alias("n")), lambda b: b.groupBy("date").agg(F.sum("n").alias("n")))
    return s.read.parquet(path).select(F.date_format(F.col("date").cast("date"), "yyyy-MM-dd").alias("date"), "n")


@query("stream_breaker", BREAKER)
def _(s, d):
    e = X.stream_table(s, d, "events")
    calls = e.select(F.col("event_type").alias("provider"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), (F.get_json_object("props", "$.k").cast("long") % 3 == 0).alias("ok"))
    return X.run_append(X.breakers(calls, rest_ms=30_000_000))


@query("stream_checkpoints", f"WITH {D.HISTORY}, c AS (SELECT user_id, event_id, row_number() OVER ({ORDER}) AS calls FROM history) SELECT * FROM c WHERE calls % 40 = 0")
def _(s, d):
    return X.run_append(X.checkpoints(X.stream_table(s, d, "events").select("user_id", "event_id", "ts"), 40))


FRAMES = [("s1", 0, 'data: {"choices":[{"delta":{"content":"Hel'), ("s1", 1, 'lo"}}]}\n\ndata: {"choices":[{"delta":{"content":" you"},"finish_reason":"length"}],'), ("s1", 2, '"usage":{"prompt_tokens":3,"completion_tokens":2}}\n\n')]


def _frames(s):
    path = f"{X.own_dir(s)}/chunks-{__import__('uuid').uuid4().hex}"
    D.values(s, FRAMES, "stream_id string, seq long, chunk string").coalesce(1).write.parquet(path)
    return X.frames(s.readStream.schema("stream_id string, seq long, chunk string").parquet(path))


@query("stream_frames", """SELECT 's1' AS stream_id, n::BIGINT AS n, data FROM (VALUES (0, '{"choices":[{"delta":{"content":"Hello"}}]}'), (1, '{"choices":[{"delta":{"content":" you"},"finish_reason":"length"}],"usage":{"prompt_tokens":3,"completion_tokens":2}}')) v(n, data)""")
def _(s, d):
    return X.run_append(_frames(s))


TRANSLATED = [
    (0, -2, '{"type":"message_start"}'), (0, -1, '{"type":"content_block_start","index":0}'), (0, 0, '{"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"Hello"}}'), (1, 0, '{"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":" you"}}'),
    (1, 1, '{"type":"message_delta","delta":{"stop_reason":"max_tokens"},"usage":{"output_tokens":2}}'), (1, 10, '{"type":"content_block_stop","index":0}'), (1, 11, '{"type":"message_stop"}'),
]


@query("stream_translate", D.sql_rows([("s1", *r) for r in TRANSLATED], "stream_id string, n long, part int, data string"))
def _(s, d):
    return TR.translate(X.run_append(_frames(s)), "openai", "anthropic")


@query("stream_usage", "SELECT 's1' AS stream_id, 3::INTEGER AS tokens_in, 2::INTEGER AS tokens_out")
def _(s, d):
    return TR.usage(X.run_append(_frames(s)), "openai")


@query("stream_cache_hits", f"WITH {D.HISTORY}, r AS (SELECT event_id AS id, event_type || user_id AS hash, user_id AS tenant, (epoch_us(ts) // 1000) AS ts_ms FROM history) SELECT a.tenant || '/' || a.hash AS key, a.id, max_by(b.id, (b.ts_ms, b.id)) AS by FROM r a JOIN r b ON a.hash = b.hash AND a.tenant = b.tenant AND (b.ts_ms, b.id) < (a.ts_ms, a.id) AND a.ts_ms - b.ts_ms <= 86400000 GROUP BY ALL")
def _(s, d):
    e = X.stream_table(s, d, "events")
    r = e.select(F.col("event_id").alias("id"), F.concat("event_type", F.col("user_id").cast("string")).alias("hash"), F.col("user_id").alias("tenant"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return X.run_append(X.cache_hits(r))


@query("stream_counters", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(s, d):
    return X.run_complete(X.counters(X.stream_table(s, d, "events"), "event_type"))


@query("more_like_this", "WITH p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM p) SELECT * FROM r WHERE rank <= 10")
def _(s, d):
    return V.best_matches(_vecs(s, d), _vecs(s, d).filter("id % 100 = 0"), 10)
