"""Parameterisation, saved indexes, re-ranking, freshness, migration and multi-project queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestore.functions import extract as E
from lodestore.functions import parameters as P
from lodestore.functions import text as X
from lodestore.operators import graph as G
from lodestore.operators import maintain as M
from lodestore.operators import quantize as V
from lodestore.operators import requests as R
from lodestore.operators import search as S
from lodestore.plans import data as D
from lodestore.plans import graph_queries as GQ
from lodestore.plans.search_queries import MULTI, VEC0, _bm25_sql, _docs, _vec0, _vecs
from lodestore.session import materialize, own_dir

Q, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("parameterize", """SELECT * FROM (VALUES (1::BIGINT, 'project_id,build_id,title'), (2, ''), (3, ''), (4, 'file_path'), (5, ''), (6, ''), (7, ''), (8, '')) v(id, names)""")
def _(s, d):
    p = P.parameterized(D.values(s, GQ.COMMANDS, GQ.CMD_SCHEMA))
    return p.select("id", F.array_join(F.transform("parameters", lambda x: x["name"]), ",").alias("names"))


@query("indexed_bm25", f"WITH {_bm25_sql(MULTI)}, r AS (SELECT qid::INTEGER AS qid, id AS doc_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) - 1)::INTEGER AS rank FROM bm) SELECT * FROM r WHERE rank < 10")
def _(s, d):
    path = f"{own_dir(s)}/index-{uuid.uuid4().hex}"
    S.save_index(_docs(s, d), path, "v1", buckets=8)
    return S.top(S.indexed_bm25(s, path, "v1", MULTI, buckets=8), 10, ["qid"]).withColumnRenamed("id", "doc_id")


RERANKED = f"""WITH {D.TRIPLES}, c AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], {VEC0}) AS score FROM embeddings),
l AS (SELECT 'cust_' || id AS e FROM c ORDER BY round(score, 6) DESC, id LIMIT 5),
f AS (SELECT DISTINCT src AS id FROM triples WHERE s IN (SELECT e FROM l) OR o IN (SELECT e FROM l))
SELECT id, round(coalesce(score, 0.01), 6) AS score, score IS NULL AS from_graph FROM c FULL JOIN f USING (id)"""


@query("graph_reranked", RERANKED)
def _(s, d):
    entries = _vecs(s, d).select("id", F.array(F.concat(F.lit("cust_"), F.col("id").cast("string"))).alias("entities"))
    return S.graph_reranked(S.cosine_scores(_vecs(s, d), _vec0(s, d)), entries, lambda seeds: G.k_hop(D.triples(s, d), seeds, 1)).select("id", F.round("score", 6).alias("score"), "from_graph")


@query("across_projects", f"SELECT 'p' || (vec_id % 2) AS project, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {VEC0}) * 1000) / 10 AS percent FROM embeddings WHERE round(list_cosine_similarity(embedding::DOUBLE[], {VEC0}) * 1000) / 10 > 5")
def _(s, d):
    v = _vecs(s, d)
    return S.across_projects({f"p{i}": v.filter(F.col("id") % 2 == i) for i in (0, 1)}, _vec0(s, d))


NOW = 1_707_000_000
FRESH = f"""WITH {D.FINDINGS}, l AS (SELECT id, epoch, '- **' || topic || '**' || CASE WHEN staleness = 'stable' THEN '' ELSE ' [' || staleness || ']' END || ': ' || finding AS line FROM findings WHERE epoch >= {NOW} - 7 * 86400),
u AS (SELECT *, coalesce(sum(len(line) + 1) OVER (ORDER BY epoch DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + len(line) > 12000 AS ov FROM l),
p AS (SELECT *, max(ov::INTEGER) OVER (ORDER BY epoch DESC, id ROWS UNBOUNDED PRECEDING) AS past FROM u) SELECT id, line FROM p WHERE past = 0"""


@query("fresh_index", FRESH)
def _(s, d):
    return M.fresh_index(D.findings(s, d), NOW)


@query("freshness", f"WITH {D.FINDINGS} SELECT count(*) FILTER (epoch >= {NOW} - 7 * 86400) AS fresh, count(*) FILTER (epoch < {NOW} - 7 * 86400) AS stale FROM findings")
def _(s, d):
    return M.freshness(D.findings(s, d), NOW)


@query("since_session", f"WITH {D.FINDINGS} SELECT 'research' AS store, count(*) FILTER (epoch > {NOW}) AS n FROM findings")
def _(s, d):
    return M.since_session({"research": D.findings(s, d)}, NOW)


@query("overlapping_topics", f"WITH {D.FINDINGS}, t AS (SELECT id, lower(trim(topic)) AS t, tags, epoch FROM findings WHERE trim(topic) <> '') SELECT a.id, max_by(b.id, (b.epoch, b.id)) AS kept_id FROM t a JOIN t b ON a.tags = b.tags AND a.tags[1] <> a.tags[2] AND (b.epoch, b.id) > (a.epoch, a.id) AND (contains(a.t, b.t) OR contains(b.t, a.t)) GROUP BY a.id")
def _(s, d):
    return M.overlapping_topics(D.findings(s, d))


@query("global_graph_stats", f"WITH {D.TRIPLES}, g AS (SELECT *, 'p' || (src % 2) AS project FROM triples), e AS (SELECT project, count(DISTINCT x) AS entities FROM (SELECT project, s AS x FROM g UNION ALL SELECT project, o FROM g) GROUP BY project) SELECT project, count(*) AS triples, any_value(entities) AS entities FROM g JOIN e USING (project) GROUP BY project")
def _(s, d):
    t = D.triples(s, d)
    return G.project_stats(G.all_projects({f"p{i}": t.filter(F.col("src") % 2 == i) for i in (0, 1)}))


@query("similarity_correlation_3bit")
def _(s, d):
    return V.similarity_correlation(_vecs(s, d), 3)


@query("similarity_correlation")
def _(s, d):
    return V.similarity_correlation(_vecs(s, d), 6)


@query("packed_text_roundtrip", "SELECT count(*) AS n, 0::BIGINT AS changed FROM embeddings")
def _(s, d):
    p = V.quantize_vectors(_vecs(s, d))
    back = V.from_text(V.as_text(p)).select("id", F.col("quantized").alias("q2"), F.col("signs").alias("s2"))
    return p.join(back, "id").agg(F.count("*").alias("n"), F.count_if((F.col("quantized") != F.col("q2")) | (F.col("signs") != F.col("s2"))).alias("changed"))


CANONICAL = f"""WITH {D.HISTORY}, b AS (SELECT event_id AS id, '[{{"role":"user","content":"key ' || k || ' of item ' || (event_id % 7) || '"}}]' AS said, event_type AS kind, CASE event_id % 3
  WHEN 0 THEN '{{"stream":true,"model":"' || kind || '","user":"u' || user_id || '","messages":' || said || '}}'
  WHEN 1 THEN '{{"messages":' || said || ',"model":"' || kind || '"}}'
  ELSE '{{"model":"' || kind || '","messages":' || said || ',"temperature":0.5}}' END AS body FROM history)
SELECT id, min(id) OVER (PARTITION BY body ->> '$.model', body ->> '$.messages', body ->> '$.temperature') AS same_as FROM b"""


@query("canonical_requests", CANONICAL)
def _(s, d):
    """Each event as a request with its fields in one of three orders, some with volatile fields; the first request that asks the same."""
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    kind, user, form = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id") % 3
    said = say('[{"role":"user","content":"key ', F.col("k").cast("string"), " of item ", (F.col("event_id") % 7).cast("string"), '"}]')
    body = (
        F.when(form == 0, say('{"stream":true,"model":"', kind, '","user":"u', user, '","messages":', said, "}"))
        .when(form == 1, say('{"messages":', said, ',"model":"', kind, '"}'))
        .otherwise(say('{"model":"', kind, '","messages":', said, ',"temperature":0.5}'))
    )
    b = D.history(s, d).select(F.col("event_id").alias("id"), R.canonical_json(body).alias("c"))
    first = b.groupBy("c").agg(F.min("id").alias("same_as"))
    return b.join(first, "c").select("id", "same_as")


MIGRATE = [
    (1, 10, "Script: build", 'Run it: for x in a b; do curl -X POST "https://h/projects/1/builds/12345" -d \'{"name": "a name that is long enough"}\'; done # and some more text here', ["script", "ci"], "x"),
    (2, 20, "Script: build", 'Again: for x in a b; do curl -X POST "https://h/projects/1/builds/99" -d \'{"name": "another name that is long"}\'; done # and some more text here', ["script"], "x"),
    (3, 30, "Plain", "a finding", ["t"], None),
    (4, 40, "Note", "short: ls", ["script"], "auto-capture"),
]


@query("migrated_scripts", "SELECT 1::BIGINT AS id, 2::BIGINT AS usage_count, 20::BIGINT AS last_used, 'Run it' AS description, 'ci' AS tags")
def _(s, d):
    r = D.values(s, MIGRATE, "id long, epoch long, topic string, finding string, tags array<string>, source_tool string")
    scripts, _rest = M.migrated_scripts(r, P.parameterized)
    return scripts.select("id", "usage_count", "last_used", "description", F.array_join("tags", ",").alias("tags"))


@query("workflow_names", "SELECT * FROM (VALUES (1::BIGINT, 'Build + Test + Log Pipeline'), (2, 'Workflow: tidy up')) v(id, name)")
def _(s, d):
    w = D.values(s, [(1, ["build it", "run test log", "deploy"]), (2, ["tidy up"])], "id long, steps array<string>")
    return w.select("id", X.workflow_name(F.col("steps")).alias("name"))


@query("prompt_tags", "SELECT * FROM (VALUES (1::BIGINT, 'search,find,user-id,js'), (2, '')) v(id, tags)")
def _(s, d):
    p = D.values(s, [(1, "Search and find the user-id in a.js"), (2, None)], "id long, prompt string")
    return p.select("id", F.array_join(X.prompt_tags(F.col("prompt")), ",").alias("tags"))


PATHS = f"""WITH {D.NOTES}, p AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'see src/' || a || '.tsx and lib/' || noun || '.py, lib/' || noun || '.py' WHEN 1 THEN p_name || ': ../' || adj || '-' || p_size || '/' || noun || '.test.JSON' ELSE '.js' END AS t FROM words),
f AS (SELECT id, list_filter(regexp_extract_all(t, '(?i)(?:[\\w./-]+/)?[\\w.-]+\\.(?:{"|".join(X.PATH_EXTENSIONS)})'), lambda x: len(x) > 4) AS f FROM p)
SELECT id, coalesce(array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ','), '') AS paths FROM f"""


@query("file_paths", PATHS)
def _(s, d):
    """Paths in sentences made of each part's name."""
    adj, noun = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    kind = F.col("p_partkey") % 3
    t = F.when(kind == 0, say("see src/", F.initcap(adj), ".tsx and lib/", noun, ".py, lib/", noun, ".py")).when(kind == 1, say(F.col("p_name"), ": ../", adj, "-", F.col("p_size").cast("string"), "/", noun, ".test.JSON")).otherwise(".js")
    p = D.table(s, d, "part").select(F.col("p_partkey").alias("id"), t.alias("t"))
    return p.select("id", F.array_join(X.file_paths(F.col("t")), ",").alias("paths"))


TYPED = {"domservice.cs": "File", "domservice": "Class", "xpathdocument": "Concept", "findalldescendants": "Class", "automationelement": "Class", "getpagesourceasync": "Function", "parsetree": "Function", "npm": "Tool", "dev.example.com": "Namespace"}


@query("typed_entities", D.sql_rows([(i, e, TYPED.get(e, "Concept")) for i, es in GQ.FOUND.items() for e in es], "id long, name string, type string"))
def _(s, d):
    return D.values(s, GQ.TEXTS, GQ.TEXT_SCHEMA).select("id", F.inline(E.typed_entities(F.col("text"))))


@query("backfilled_triples", f"WITH {GQ.ENTITIES}, left_ AS (SELECT id FROM notes EXCEPT SELECT src FROM made WHERE src % 3 <> 0) SELECT (SELECT count(*) FROM left_) AS left_over, (SELECT count(*) FROM made WHERE src IN (FROM left_)) AS first_time, (SELECT count(*) FROM made WHERE src IN (SELECT id FROM left_ EXCEPT SELECT src FROM made)) AS second_time")
def _(s, d):
    """Notes of which no triple comes after an extraction that passed over every third, the triples a backfill makes of them, and those it makes when it runs again."""
    entries = D.notes(s, d)
    early = materialize(E.triples(entries.filter("id % 3 <> 0")), "early")
    left = G.not_yet_extracted(entries, early)
    late = materialize(E.triples(left), "late")
    again = E.triples(G.not_yet_extracted(left, late))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(left, "left_over").crossJoin(count(late, "first_time")).crossJoin(count(again, "second_time"))
