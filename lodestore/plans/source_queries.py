"""File sources, tools and keyed streams over the driver tables, which are first written out in the form that is read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestore import tools
from lodestore.functions import text as X
from lodestore.operators import classify as C
from lodestore.operators import graph as G
from lodestore.operators import maintain as M
from lodestore.plans import data as D
from lodestore.plans import graph_queries as GQ
from lodestore.plans.other_queries import _store
from lodestore.plans.search_queries import _bm25_sql
from lodestore.sources import code, files
from lodestore.streaming import streams as S
from lodestore.streaming import translate as TR

Q, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _folder(s, name):
    return f"{S.own_dir(s)}/{name}-{uuid.uuid4().hex}"


DOC = "doc_id long, lang string, source string, text string"


def _lines(s, d):
    """documents as JSON lines."""
    return D.table(s, d, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "source", "text")).alias("value"))


def _schema(s):
    return s.createDataFrame([], DOC).schema


@query("jsonl_rows", "SELECT doc_id, lang, source, sha256(text) AS text_sha256 FROM documents")
def _(s, d):
    path = _folder(s, "lines")
    _lines(s, d).select("value").write.text(path)
    return files.read_jsonl(s, path, _schema(s)).select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"))


@query("jsonl_corrupt_lines", "SELECT count(*) AS good, count(*) FILTER (doc_id % 7 = 0) AS bad FROM documents")
def _(s, d):
    """Of every seventh document there is a second line that breaks off."""
    path = _folder(s, "lines")
    cut = F.when(F.col("doc_id") % 7 == 0, F.expr("substring(value, 1, length(value) - 1)"))
    _lines(s, d).select(F.explode(F.array_compact(F.array("value", cut))).alias("value")).write.text(path)
    return files.corrupt_report(s, path, _schema(s)).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


@query("jsonl_appended", "SELECT source, 2 * count(*) AS n, 2 * sum(len(text))::BIGINT AS n_chars FROM documents GROUP BY source")
def _(s, d):
    path = _folder(s, "lines")
    docs = D.table(s, d, "documents").select("doc_id", "lang", "source", "text")
    files.append_jsonl(docs, path)
    files.append_jsonl(docs, path)
    return files.read_jsonl(s, path, _schema(s)).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("json_map", "SELECT n_name AS key, n_regionkey::BIGINT AS value FROM nation")
def _(s, d):
    """nation is a table of fixed size, so it may be one object."""
    path = _folder(s, "map")
    pairs = F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_regionkey").cast("long"))))
    D.table(s, d, "nation").agg(F.to_json(pairs).alias("value")).coalesce(1).write.text(path)
    return files.read_json_map(s, path, "long")


@query("walked_files", "SELECT lang, sum(len(text) + 1)::BIGINT AS n_chars FROM documents WHERE lang <> 'fr' GROUP BY lang")
def _(s, d):
    """Files by language, one language's folder being among those that a walk leaves out."""
    path = _folder(s, "tree")
    D.table(s, d, "documents").select("lang", F.col("text").alias("value")).write.option("maxRecordsPerFile", 500).partitionBy("lang").text(path)
    found = files.walk(s, path, ("txt",), ("lang=fr",))
    return found.groupBy(F.regexp_extract("path", "/lang=([^/]*)/", 1).alias("lang")).agg(F.sum(F.length("content")).alias("n_chars"))


PLACES = ("alpha", "x/beta", "x/y/z/w/gamma", "x/y/z/w/v/delta", "node_modules/epsilon")


@query("discovered_projects", "SELECT ['alpha', 'beta', 'gamma'][doc_id % 3 + 1] AS _project, count(*) AS n, sum(len(text))::BIGINT AS n_chars FROM documents GROUP BY 1")
def _(s, d):
    """Three projects share the documents; one beyond five folders and one under a folder of packages aren't found."""
    root = _folder(s, "projects")
    for i, place in enumerate(PLACES):
        part = _lines(s, d).filter(F.col("doc_id") % 3 == i % 3).select("value")
        part.write.text(f"{root}/{place}/research.jsonl")
    return files.projects(s, root, "research.jsonl", _schema(s)).groupBy("_project").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("versioned_table", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(s, d):
    """The newer of two versions, with the older still there."""
    base = _folder(s, "versions")
    t = D.table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    files.save_version(t.withColumn("n", F.lit(0).cast("long")), base, "langs")
    return s.read.parquet(files.save_version(t, base, "langs"))


@query("changed_documents", "SELECT doc_id, lang FROM documents WHERE doc_id % 5 = 0")
def _(s, d):
    """Documents whose text differs from what is known of every fifth."""
    docs = D.table(s, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), "doc_id", "lang")
    known = docs.select("path", files.file_hash(F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).alias("hash"))
    return files.changed_files(docs, known).select("doc_id", "lang")


@query("resolved_imports", "SELECT 'src/' || item_id || '.js' AS file_path, CASE WHEN item_id > (SELECT min(item_id) FROM benchmark) AND item_id - 1 IN (SELECT item_id FROM benchmark) THEN 'src/' || (item_id - 1) || '.js' ELSE './' || (item_id - 1) END AS target FROM benchmark")
def _(s, d):
    """A file per benchmark item that imports the item before it."""
    item = F.col("item_id").cast("string")
    f = D.table(s, d, "benchmark").select(F.concat(F.lit("src/"), item, F.lit(".js")).alias("path"), F.concat(F.lit("import x from './"), (F.col("item_id") - 1).cast("string"), F.lit("';\n")).alias("content"))
    return code.resolve_imports(code.code_graph(f)[1], f).select("file_path", F.col("target_qualified").alias("target"))


@query("self_calls", f"WITH {D.HISTORY} SELECT event_id, event_type = 'signup' OR k % 4 = 0 AS own FROM history")
def _(s, d):
    h = D.history(s, d)
    saves = F.when(F.col("k") % 4 == 0, F.concat(F.lit("node save-decision "), "command")).when(F.col("event_type") == "signup", F.concat("command", F.lit(" && check-memory"))).otherwise(F.col("command"))
    return h.select("event_id", X.is_self_call(saves).alias("own"))


@query("matched_steps", f"WITH {D.HISTORY}, c AS (SELECT *, 'tool ' || event_type AS sk FROM history), s AS (SELECT sk, min(event_id) AS script_id FROM c WHERE event_type <> 'error' GROUP BY sk) SELECT event_id AS id, script_id, CASE WHEN script_id IS NULL THEN 'Step ' || event_id % 3 ELSE 'script ' || script_id END AS name FROM c LEFT JOIN s USING (sk)")
def _(s, d):
    """Every event is a step; events but errors are scripts too."""
    h = D.history(s, d)
    template = F.concat(F.lit("tool   "), "event_type", F.lit("  "))
    steps = h.select(F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("ord"), "command", F.lit("").alias("description"), template.alias("template"))
    scripts = h.filter("event_type <> 'error'").select(F.col("event_id").alias("id"), F.concat(F.lit("script "), F.col("event_id").cast("string")).alias("name"), template.alias("template"))
    return M.matched_steps(steps, scripts).select("id", "script_id", "name")


@query("cached_adjacency", f"WITH {D.TRIPLES} SELECT s AS entity, p AS predicate, o AS target, src, 'out' AS direction FROM triples WHERE s IN ('cust_7', 'nation_3') UNION ALL SELECT o, p, s, src, 'in' FROM triples WHERE o IN ('cust_7', 'nation_3')")
def _(s, d):
    """Written once, read twice; the second version of the triples has no part in the first."""
    path, wanted = _folder(s, "adjacency"), ["cust_7", "nation_3"]
    G.cached_adjacency(D.triples(s, d), path, "v1")
    kept = G.cached_adjacency(D.triples(s, d).limit(0), path, "v1")
    buckets = F.array(*(G.bucket_of(F.lit(w)) for w in wanted))
    return kept.filter(F.array_contains(buckets, F.col("bucket")) & F.col("entity").isin(wanted)).drop("bucket")


RESPONSES = [
    ("anthropic", '{"type":"message","model":"m","content":[{"type":"text","text":"%s"}],"stop_reason":"max_tokens","usage":{"input_tokens":3,"output_tokens":2}}'),
    ("openai", '{"model":"m","choices":[{"message":{"content":"%s"},"finish_reason":"length"}],"usage":{"prompt_tokens":3,"completion_tokens":2}}'),
    ("ollama", '{"model":"m","message":{"content":"%s","tool_calls":[{"function":{"name":"f","arguments":{"x":1}}}]},"done_reason":"stop","prompt_eval_count":3,"eval_count":2}'),
]


@query("common_responses", "SELECT conv_id, turn, f.format AS format, text AS content, CASE WHEN f.format = 'ollama' THEN 1 ELSE 0 END::INTEGER AS n_tools, CASE WHEN f.format = 'ollama' THEN 'tool_use' ELSE 'max_tokens' END AS stop_reason, 3::BIGINT AS input_tokens, 2::BIGINT AS output_tokens FROM conversations, (VALUES ('anthropic'), ('openai'), ('ollama')) f(format)")
def _(s, d):
    """Every turn of the conversations as the answer of each provider."""
    quoted = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":"(.*)"\}$', 1)
    forms = F.array(*(F.struct(F.lit(f).alias("format"), F.concat(F.lit(b.split("%s")[0]), quoted, F.lit(b.split("%s")[1])).alias("body")) for f, b in RESPONSES))
    t = D.table(s, d, "conversations").select("conv_id", "turn", F.inline(forms))
    return t.select("conv_id", "turn", "format", C.common_response(F.col("body"), F.col("format")).alias("r")).select("conv_id", "turn", "format", "r.content", "r.n_tools", "r.stop_reason", "r.input_tokens", "r.output_tokens")


# tools

FI = D.FINDINGS


@query("memory_save", f"WITH {FI}, t AS (SELECT id, lower(trim(topic)) AS t, tags, staleness FROM findings), dup AS (SELECT n.id FROM t s JOIN t n ON s.tags = n.tags AND s.t <> '' AND n.t <> '' AND (contains(s.t, n.t) OR contains(n.t, s.t)) AND n.staleness = 'volatile' AND s.staleness <> 'volatile') SELECT id, staleness FROM findings WHERE id NOT IN (SELECT id FROM dup)")
def _(s, d):
    f = D.findings(s, d)
    return tools.memory_save(tools.Store(f.filter("staleness <> 'volatile'"), f), f.filter("staleness = 'volatile'")).select("id", "staleness")


@query("code_impact", GQ.SQL["impact_radius"])
def _(s, d):
    return tools.code_impact(_store(s, d), "part.5")


@query("code_structure", "SELECT 'src/3.py' AS asked, qualified_name AS found FROM (" + GQ.SQL["file_structure"] + ") UNION ALL SELECT 'lib/', file_path || ':' || coalesce(class_name, '') FROM (" + GQ.SQL["module_hierarchy"] + ")")
def _(s, d):
    """A file's members, and a folder's files and classes."""
    inside = tools.code_structure(_store(s, d), "src/3.py").select(F.lit("src/3.py").alias("asked"), F.col("qualified_name").alias("found"))
    under = tools.code_structure(_store(s, d), "lib/")
    return inside.unionByName(under.select(F.lit("lib/").alias("asked"), F.concat("file_path", F.lit(":"), X.blank(F.col("class_name"))).alias("found")))


@query("list_skills", f"WITH {D.HISTORY} SELECT CASE WHEN success THEN 'approved' ELSE 'pending' END AS status, count(*) AS n FROM history GROUP BY 1")
def _(s, d):
    c = D.history(s, d).select(F.col("command").alias("fingerprint"), F.lit(1).alias("occurrences"), F.when(F.col("success"), "approved").otherwise("pending").alias("status"))
    return tools.list_skills(tools.Store(None, None, candidates=c))


NOW = 1_712_000_000


@query("run_maintenance", f"""WITH {FI}, {D.TRIPLES}, k AS (SELECT id, lower(trim(topic)) AS k FROM findings WHERE trim(topic) <> ''), g AS (SELECT k, count(*) AS n FROM k GROUP BY k HAVING count(*) > 1)
SELECT 'stale' AS task, count(*) AS n FROM findings WHERE ({NOW} - epoch) / 86400.0::DOUBLE > CASE staleness WHEN 'volatile' THEN 14 WHEN 'versioned' THEN 60 END
UNION ALL SELECT 'duplicates', count(*) FROM k JOIN g USING (k) UNION ALL SELECT 'missing_vectors', count(*) FROM findings WHERE id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'orphan_vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT id FROM findings)
UNION ALL SELECT 'similar', count(*) FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) > 0.3
UNION ALL SELECT 'kept_triples', count(*) FROM triples WHERE (s IN (SELECT 'cust_' || id FROM findings)) OR (o IN (SELECT 'cust_' || id FROM findings))""")
def _(s, d):
    """How much each task would touch."""
    f = D.findings(s, d).withColumn("entities", F.array(F.concat(F.lit("cust_"), F.col("id").cast("string"))))
    store = tools.Store(f, f, vectors=D.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), triples=D.triples(s, d))
    out = None
    for task, rows in tools.run_maintenance(store, NOW, 0.3).items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(task).alias("task"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_FOUND = "SELECT id, round(score, 6) AS score, (row_number() OVER (ORDER BY round(score, 6) DESC, id) - 1)::INTEGER AS rank FROM bm ORDER BY rank LIMIT 5"
_WORDS = {0: "the of that"}


@query("script_search_tool", f"WITH {_bm25_sql(_WORDS, '(SELECT doc_id AS id, source || chr(32) || lang || chr(32) || source || chr(32) || text || chr(32) || lang AS text FROM documents)', 'id')} {_FOUND}")
def _(s, d):
    t = D.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("description"), F.array("lang").alias("tags"))
    return tools.script_search(tools.Store(None, None, scripts=t), "the of that").select("id", F.round("score", 6).alias("score"), "rank")


@query("exploration_search_tool", f"WITH {_bm25_sql(_WORDS, '(SELECT doc_id AS id, text || chr(32) || lang || chr(32) || text || chr(32) || source || chr(32) || source || chr(32) || lang || chr(32) || source AS text FROM documents)', 'id')} {_FOUND}")
def _(s, d):
    t = D.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("query"), F.array("lang").alias("tags"), F.array("source").alias("files"), F.array("source").alias("entities"))
    return tools.exploration_search(tools.Store(None, None, explorations=t), "the of that").select("id", F.round("score", 6).alias("score"), "rank")


# keyed streams

MS = "(epoch_us(ts) // 1000)"


def _events(s, d):
    return S.stream_table(s, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "props")


@query("stream_rolling_last", "SELECT user_id, event_id, first_value(event_id) OVER w AS oldest_kept, least(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id), 20) AS kept FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING)")
def _(s, d):
    return S.run_append(S.rolling_last(_events(s, d).select("user_id", "event_id", "ts"), 20))


TASKS = f"""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS made, CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END AS done FROM events),
r AS (SELECT *, sum(made) OVER w AS m, sum(done) OVER w AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, m - least(0, min(m) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS created FROM r)
SELECT user_id::VARCHAR AS session, event_id AS seq, greatest(0, created - c)::BIGINT AS open FROM l"""


@query("stream_task_tracker", TASKS)
def _(s, d):
    action = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "delete").otherwise("none")
    return S.run_append(S.task_trackers(_events(s, d).select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), action.alias("action"))))


REMIND = f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS session, event_id AS seq, {MS} AS ts_ms, event_type = 'purchase' AS saved, row_number() OVER (PARTITION BY user_id ORDER BY {MS}, event_id) AS rn FROM events),
m AS (SELECT session, 0::BIGINT AS rn, 0::BIGINT AS seq, NULL::BIGINT AS last, 0::BIGINT AS n, false AS made FROM e GROUP BY session
 UNION ALL SELECT e.session, e.rn, e.seq, CASE WHEN e.saved THEN NULL WHEN m.last IS NULL OR e.ts_ms - m.last >= 180000000 THEN e.ts_ms ELSE m.last END,
  CASE WHEN e.saved THEN 0 WHEN m.last IS NULL OR e.ts_ms - m.last >= 180000000 THEN m.n + 1 ELSE m.n END, NOT e.saved AND (m.last IS NULL OR e.ts_ms - m.last >= 180000000) FROM m JOIN e ON e.session = m.session AND e.rn = m.rn + 1)
SELECT session, seq, n AS reminders, n > 2 AS blocked FROM m WHERE made"""


@query("stream_reminders", REMIND)
def _(s, d):
    e = _events(s, d).select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.unix_millis("ts").alias("ts_ms"), (F.col("event_type") == "purchase").alias("saved"))
    return S.run_append(S.reminders(e, 180_000_000))


@query("stream_latest", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def _(s, d):
    """What a debounced reprocessing gets: with each batch the last event of a user; of several batches the last counts."""
    path = _folder(s, "latest")
    S.latest_per_key(_events(s, d).withColumn("at", F.struct("ts", "event_id")), lambda b: b.select("user_id", "at", "event_id", "event_type").write.mode("append").parquet(path), "user_id", "at")
    last = s.read.parquet(path).groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "at").alias("s"))
    return last.select("user_id", "s.*")


@query("stream_embed_build", "SELECT doc_id AS id, len(text)::BIGINT AS embedded FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)")
def _(s, d):
    """A debounced build: each batch's entries without a vector get one, here their length; those that have one are left alone."""
    path = _folder(s, "built")
    have = D.table(s, d, "embeddings").filter("vec_id % 2 = 0").select(F.col("vec_id").alias("id"))
    build = lambda b: M.missing(b, have).select("id", F.length("text").cast("long").alias("embedded")).write.mode("append").parquet(path)
    S.latest_per_key(S.stream_table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(0).alias("at")), build, "id", "at")
    return s.read.parquet(path)


@query("inactive_owners", "SELECT user_id, max(epoch_us(ts) // 1000000) AS last FROM events GROUP BY user_id HAVING (SELECT max(epoch_us(ts) // 1000000) FROM events) - max(epoch_us(ts) // 1000000) > 7200")
def _(s, d):
    e = D.table(s, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"))
    return S.inactive(e, e.agg(F.max("epoch")).first()[0] or 0)


@query("expired_entries", f"WITH {FI} SELECT id FROM findings WHERE 1708000000 - epoch > 30 * 86400")
def _(s, d):
    return S.expired(D.findings(s, d), 1_708_000_000).select("id")


# six translations between three formats, over the answers of the conversations

CHUNKS = {
    "anthropic": ('{"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"', '"}}', '{"type":"message_delta","delta":{"stop_reason":"max_tokens"},"usage":{"input_tokens":3,"output_tokens":2}}'),
    "openai": ('{"choices":[{"delta":{"content":"', '"}}]}', '{"choices":[{"delta":{},"finish_reason":"length"}],"usage":{"prompt_tokens":3,"completion_tokens":2}}'),
    "ollama": ('{"message":{"role":"assistant","content":"', '"},"done":false}', '{"done":true,"done_reason":"length","prompt_eval_count":3,"eval_count":2}'),
}


@query(
    "stream_translate_all",
    "WITH f(fmt) AS (VALUES ('anthropic'), ('openai'), ('ollama')) SELECT a.fmt AS src, b.fmt AS dst, conv_id::VARCHAR AS stream_id, string_agg(text, '' ORDER BY turn) AS text, CASE b.fmt WHEN 'anthropic' THEN 'max_tokens' ELSE 'length' END AS reason FROM conversations, f a, f b WHERE a.fmt <> b.fmt AND text <> '' GROUP BY ALL",
)
def _(s, d):
    """Each conversation as a stream of its turns' texts in one format, translated into another and put together from that."""
    t = D.table(s, d, "conversations").filter("text <> ''")
    quoted = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":"(.*)"\}$', 1)
    out = None
    for src in TR.FORMATS:
        head, foot, end = CHUNKS[src]
        said = t.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").cast("long").alias("n"), F.concat(F.lit(head), quoted, F.lit(foot)).alias("data"))
        frames = said.unionByName(said.groupBy("stream_id").agg((F.max("n") + 1).alias("n")).withColumn("data", F.lit(end)))
        for dst in TR.FORMATS:
            if src != dst:
                c = TR.common(TR.translate(frames, src, dst), dst)
                text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("n", "text")))), lambda x: x["text"]), "")
                one = c.groupBy("stream_id").agg(text.alias("text"), F.max("reason").alias("reason"))
                one = one.select(F.lit(src).alias("src"), F.lit(dst).alias("dst"), "stream_id", "text", "reason")
                out = one if out is None else out.unionByName(one)
    return out
