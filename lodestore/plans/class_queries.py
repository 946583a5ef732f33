"""Classification, routing and response-rule queries over conversations and inline fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.operators import classify as C
from lodestore.operators import sessions as S
from lodestore.plans import data as D

Q, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


FENCE = "```"
FIXTURES = [
    (-1, "fix the typo", 2, 900, 0, 0.0, False, ""),
    (-2, f"explain {FENCE}js\n{'x = 1; ' * 800}\n{FENCE}", 0, 0, 0, 0.0, False, ""),
    (-3, "apply this\n--- a/x.py\n+++ b/x.py", 0, 0, 0, 0.0, False, ""),
    (-4, "compare src/a.js lib/b.js lib/c/d.ts test/e.py please", 0, 0, 0, 0.0, False, ""),
    (-5, "refactor and design the module, think step by step and respond in json, see https://x.org/a", 1, 4000, 6000, 0.9, True, ""),
    (-6, "implement it", 1, 100, 0, 0.0, False, ""),
    (-7, "reason about the chain of thought, analyze it", 0, 0, 9000, 1.5, False, ""),
]
FX_SCHEMA = "id long, user_text string, n_tools int, tools_bytes int, max_tokens int, temperature double, has_stop boolean, model string"
FX = D.sql_values(FIXTURES, FX_SCHEMA, "fx")
REQ = f"""{FX}, conv AS (SELECT conv_id AS id, coalesce(max_by(text, turn) FILTER (role = 'user'), '') AS user_text, coalesce(max_by(text, turn) FILTER (role = 'assistant'), '') AS assistant_text,
   string_agg(text, chr(10) ORDER BY turn) AS full_text, count(*) AS turns FROM conversations GROUP BY conv_id),
req AS (SELECT id, user_text, assistant_text, full_text, turns, 0 AS n_tools, 0 AS tools_bytes, 0 AS max_tokens, 0.0::DOUBLE AS temperature, false AS has_stop FROM conv
   UNION ALL SELECT id, user_text, '', user_text, 1, n_tools, tools_bytes, max_tokens, temperature, has_stop FROM fx)"""


def _requests(s, d):
    c = D.table(s, d, "conversations")
    g = c.groupBy("conv_id").agg(
        F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("user_text"),
        F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn"))).alias("assistant_text"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("full_text"),
        F.count("*").cast("int").alias("turns"),
    ).withColumnRenamed("conv_id", "id")
    fx = D.values(s, FIXTURES, FX_SCHEMA).withColumn("full_text", F.col("user_text")).withColumn("turns", F.lit(1))
    return g.unionByName(fx, allowMissingColumns=True)


def _n(pattern: str, flags: str = "") -> str:
    p = pattern.replace("'", "''")
    return f"len(regexp_extract_all(t, '{flags}{p}'))"


SIGNALS = f"""m AS (SELECT *, full_text || chr(10) AS t FROM req),
sg AS (SELECT *, ceil(len(t) / 4.0::DOUBLE) AS tok, floor({_n(FENCE)} / 2.0::DOUBLE) AS blocks,
  coalesce(list_max(list_transform(regexp_extract_all(t, '(?s){FENCE}[\\w-]*\\n?(.*?){FENCE}', 1), lambda x: len(x))), 0) AS big,
  regexp_matches(user_text, '(?i)\\b(?:respond|reply|return|output)\\s+(?:in|as|with)\\s+(?:json|yaml|xml)\\b') AS fmt,
  {_n(chr(92) + 'b(?:' + C.VERBS + ')' + chr(92) + 'b', '(?i)')} AS verbs,
  {_n(chr(92) + 'b[' + chr(92) + 'w-]+(?:/[' + chr(92) + 'w.-]+)+' + chr(92) + '.[a-z0-9]+' + chr(92) + 'b', '(?i)')} + {_n('[A-Za-z]:' + chr(92) * 2 + '[' + chr(92) + 'w.' + chr(92) * 2 + '-]+')} AS files,
  regexp_matches(t, '(?:^|\\n)(?:diff --git|@@ |\\+\\+\\+ |--- )') AS diff,
  {' + '.join(_n(p, '(?i)') for p in ('think' + chr(92) + 's+step' + chr(92) + 's+by' + chr(92) + 's+step', 'reason' + chr(92) + 's+about', chr(92) + 'banalyz[e|ing]' + chr(92) + 'b', 'walk' + chr(92) + 's+me' + chr(92) + 's+through', 'explain' + chr(92) + 's+in' + chr(92) + 's+detail', 'chain' + chr(92) + 's+of' + chr(92) + 's+thought'))} AS reasons,
  {_n('https?://' + chr(92) + 'S+')} AS urls FROM m),
w AS (SELECT *, n_tools > 1 OR big > 5000 OR diff OR files > 3 AS forced,
  2.0::DOUBLE * least(tok / 4000, 1) + 1.0::DOUBLE * least(turns / 10.0::DOUBLE, 1) + 2.5::DOUBLE * least(n_tools / 2.0::DOUBLE, 1) + 1.0::DOUBLE * least(CASE WHEN n_tools > 0 THEN tools_bytes ELSE 0 END / 8000.0::DOUBLE, 1)
  + 1.5::DOUBLE * least(blocks / 3, 1) + 1.5::DOUBLE * least(big / 2000.0::DOUBLE, 1) + 1.5::DOUBLE * CASE WHEN fmt THEN 1 ELSE 0 END + 2.0::DOUBLE * CASE WHEN verbs > 0 THEN 1 ELSE 0 END
  + 2.0::DOUBLE * least(files / 3.0::DOUBLE, 1) + 2.5::DOUBLE * diff::INTEGER + 1.5::DOUBLE * least(reasons / 2.0::DOUBLE, 1) + 0.5::DOUBLE * least(urls / 3.0::DOUBLE, 1) + 0.5::DOUBLE * least(len(assistant_text) / 2000.0::DOUBLE, 1)
  + 1.0::DOUBLE * least(greatest((max_tokens - 2048) / 6144.0::DOUBLE, 0), 1) + 0.5::DOUBLE * least(greatest((temperature - 0.7::DOUBLE) / (1.0::DOUBLE - 0.7::DOUBLE), 0), 1) + 0.3::DOUBLE * has_stop::INTEGER AS total FROM sg),
sc AS (SELECT *, CASE WHEN forced THEN 1.0::DOUBLE ELSE round(1 - exp(-total / 3.5::DOUBLE), 4) END AS score FROM w),
bl AS (SELECT *, NOT forced AND score BETWEEN 0.4::DOUBLE AND 0.7::DOUBLE AS borderline FROM sc)"""


@query("complexity_score", f"WITH {REQ}, {SIGNALS} SELECT id, score, forced, borderline FROM bl")
def _(s, d):
    return C.complexity(_requests(s, d)).select("id", "score", "forced", "borderline")


@query("complexity_signals", f"""WITH {REQ}, {SIGNALS} SELECT id, round(2.0::DOUBLE * least(tok / 4000, 1), 3) AS "c_promptTokens", round(least(turns / 10.0::DOUBLE, 1), 3) AS "c_conversationDepth", round(2.5::DOUBLE * least(n_tools / 2.0::DOUBLE, 1), 3) AS "c_toolCount",
 round(least(CASE WHEN n_tools > 0 THEN tools_bytes ELSE 0 END / 8000.0::DOUBLE, 1), 3) AS "c_toolByteSize", round(1.5::DOUBLE * least(blocks / 3, 1), 3) AS "c_codeBlocks", round(1.5::DOUBLE * least(big / 2000.0::DOUBLE, 1), 3) AS "c_largestCodeBlock",
 CASE WHEN fmt THEN 1.5::DOUBLE ELSE 0 END AS "c_structuredOutput", CASE WHEN verbs > 0 THEN 2.0::DOUBLE ELSE 0 END AS "c_imperativeVerbs", round(2.0::DOUBLE * least(files / 3.0::DOUBLE, 1), 3) AS "c_multiFileRefs", 2.5::DOUBLE * diff::INTEGER AS "c_diffMarkers",
 round(1.5::DOUBLE * least(reasons / 2.0::DOUBLE, 1), 3) AS "c_reasoningRequest", round(0.5::DOUBLE * least(urls / 3.0::DOUBLE, 1), 3) AS "c_urlCount", round(0.5::DOUBLE * least(len(assistant_text) / 2000.0::DOUBLE, 1), 3) AS "c_recentAssistantLen",
 round(least(greatest((max_tokens - 2048) / 6144.0::DOUBLE, 0), 1), 3) AS "c_outputBudget", round(0.5::DOUBLE * least(greatest((temperature - 0.7::DOUBLE) / (1.0::DOUBLE - 0.7::DOUBLE), 0), 1), 3) AS "c_temperature", 0.3::DOUBLE * has_stop::INTEGER AS "c_stopConstraints" FROM bl""")
def _(s, d):
    return C.complexity(_requests(s, d)).select("id", *(f"c_{k}" for k in C.WEIGHTS))


BANKS = "comp AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL), bank AS (SELECT CASE WHEN label % 2 = 0 THEN 'simple' ELSE 'complex' END AS category, list(m ORDER BY pos) AS vec FROM comp GROUP BY label)"
NEAR = f"""{BANKS}, near AS (SELECT vec_id AS id, (max(list_cosine_similarity(embedding::DOUBLE[], vec)) FILTER (category = 'simple') + 1) / 2 AS simple, (max(list_cosine_similarity(embedding::DOUBLE[], vec)) FILTER (category = 'complex') + 1) / 2 AS complex FROM embeddings, bank GROUP BY vec_id)"""


def _near(s, d):
    e = D.table(s, d, "embeddings")
    mean = e.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"))
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("vec"))
    bank = mean.select(F.when(F.col("label") % 2 == 0, "simple").otherwise("complex").alias("category"), "vec")
    return C.nearest_reference(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), bank)


@query("nearest_reference_classify", f"WITH {NEAR} SELECT id, round(simple, 6) AS simple, round(complex, 6) AS complex, CASE WHEN simple > complex THEN 'simple' ELSE 'complex' END AS category, round(least(1, abs(simple - complex) * 4), 6) AS confidence FROM near")
def _(s, d):
    return _near(s, d).select("id", F.round("simple", 6).alias("simple"), F.round("complex", 6).alias("complex"), "category", F.round("confidence", 6).alias("confidence"))


HYBRID = f"""{REQ}, {SIGNALS}, {NEAR}, hy AS (SELECT bl.id, n_tools, forced, score, CASE WHEN borderline THEN (score + near.complex) / 2 END AS blended FROM bl LEFT JOIN near ON near.id = bl.id AND borderline),
cl AS (SELECT id, blended, n_tools, CASE WHEN forced OR n_tools > 1 THEN 'complex' WHEN score < 0.4::DOUBLE THEN 'simple' WHEN score > 0.7::DOUBLE THEN 'complex' WHEN blended IS NULL THEN CASE WHEN score >= 0.5 THEN 'complex' ELSE 'medium' END WHEN blended < 0.45::DOUBLE THEN 'simple' WHEN blended > 0.65::DOUBLE THEN 'complex' ELSE 'medium' END AS complexity,
  round(CASE WHEN forced OR n_tools > 1 THEN 1.0::DOUBLE WHEN score < 0.4::DOUBLE THEN 1 - score / 0.4::DOUBLE WHEN score > 0.7::DOUBLE THEN (score - 0.7::DOUBLE) / (1 - 0.7::DOUBLE) WHEN blended IS NULL THEN 0.3::DOUBLE ELSE least(1, abs(blended - 0.55::DOUBLE) * 4) END, 6) AS confidence FROM hy)"""


@query("hybrid_classify", f"WITH {HYBRID} SELECT id, complexity, confidence FROM cl")
def _(s, d):
    return C.hybrid_classes(C.complexity(_requests(s, d)), _near(s, d)).select("id", "complexity", "confidence")


MODELS = [
    (1, "claude-3-opus"), (2, "gpt-4o"), (3, "llama3.2:3b"), (4, "mine@vllm"), (5, "x@nowhere"), (6, "qwen"), (7, ""), (8, None), (9, "o1"), (10, "phi@OpenAI"), (11, "some/other"), (12, " text-embedding-3 "),
]
PROVIDERS = ["anthropic", "openai", "ollama", "openai-local", None, "ollama", None, None, "openai", "openai", None, "openai"]
CLEAN = ["claude-3-opus", "gpt-4o", "llama3.2:3b", "mine", "x@nowhere", "qwen", "", None, "o1", "phi", "some/other", "text-embedding-3"]
_v = lambda x: "NULL" if x is None else f"'{x}'"


@query("provider_detect", "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_v(p)}, {_v(c)})" for (i, _), p, c in zip(MODELS, PROVIDERS, CLEAN, strict=True)) + ") v(id, provider, clean)")
def _(s, d):
    m = D.values(s, MODELS, "id long, model string")
    return m.select("id", C.provider_of(F.col("model"), ["llama3.2:3b", "qwen:latest"]).alias("provider"), C.clean_model(F.col("model")).alias("clean"))


CALLS = [("GET", "/metrics", "ops"), ("POST", "/v1/messages", "routed"), ("GET", "/v1/messages", None), ("POST", "/v1/messages/batches/7/results", "passthrough"), ("GET", "/v1/messages/batches", "passthrough"), ("GET", "/v1/models", "passthrough"), ("POST", "/v1/models", None), ("DELETE", "/v1/files/abc", "passthrough"), ("GET", "/nope", None), ("POST", "/v1/responses", "routed"), ("GET", "/v1/responses/1", "passthrough")]


@query("route_match", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{p}', {_v(c)})" for m, p, c in CALLS) + ") v(method, path, category)")
def _(s, d):
    c = D.values(s, [(m, p) for m, p, _ in CALLS], "method string, path string")
    cats = F.array(*(F.lit(r[2]) for r in C.ROUTES))
    return c.select("method", "path", F.get(cats, C.route_of(F.col("method"), F.col("path"))).alias("category"))


@query("route_coverage", "SELECT * FROM (VALUES ('ops', 5::BIGINT), ('routed', 5), ('passthrough', 22)) v(category, n)")
def _(s, d):
    return D.values(s, C.ROUTES, "path string, method string, category string, format string").groupBy("category").agg(F.count("*").alias("n"))


DECIDE = """d AS (SELECT c.id, c.complexity, c.n_tools, CASE WHEN c.id % 2 = 0 THEN 'anthropic' ELSE 'openai' END AS format, CASE WHEN c.id % 7 = 0 THEN 'gpt-4o' WHEN c.id % 7 = 1 THEN 'tiny@local' ELSE '' END AS model FROM cl c)"""
CLOUD = "CASE WHEN format = 'anthropic' THEN 'anthropic' ELSE 'openai' END"


@query("route_decision", f"WITH {HYBRID}, {DECIDE}, x AS (SELECT *, CASE WHEN model = 'gpt-4o' THEN 'openai' WHEN model = 'tiny@local' THEN 'openai-local' WHEN complexity = 'simple' THEN 'ollama' ELSE {CLOUD} END AS provider FROM d) SELECT id, provider, CASE WHEN model = 'gpt-4o' THEN 'gpt-4o' WHEN model = 'tiny@local' THEN 'tiny' WHEN provider = 'ollama' THEN 'llama3.2:3b' END AS model, CASE WHEN model <> '' THEN 'client' ELSE 'balanced' END AS rule, CASE WHEN provider IN ('ollama', 'openai-local') THEN {CLOUD} END AS fallback FROM x")
def _(s, d):
    return C.decide(_decidable(s, d))


def _decidable(s, d):
    scored = C.complexity(_requests(s, d))
    c = C.hybrid_classes(scored, _near(s, d)).join(scored.select("id", "n_tools"), "id")
    return c.select("id", "complexity", "n_tools", F.when(F.col("id") % 2 == 0, "anthropic").otherwise("openai").alias("format"), F.when(F.col("id") % 7 == 0, "gpt-4o").when(F.col("id") % 7 == 1, "tiny@local").otherwise("").alias("model"), F.lit("chat").alias("kind"), F.lit(False).alias("code_heavy"))


@query("route_decision_private", f"WITH {HYBRID}, {DECIDE} SELECT id, CASE WHEN complexity IN ('simple', 'medium') THEN 'ollama' ELSE 'blocked' END AS provider, CASE WHEN complexity IN ('simple', 'medium') THEN 'llama3.2:3b' END AS model, 'aggressive' AS rule, NULL::VARCHAR AS fallback FROM d")
def _(s, d):
    return C.decide(_decidable(s, d), C.RouterConfig(mode="aggressive", privacy=True, respect_client_model=False))


@query("replayed_dispatch", f"""WITH {HYBRID}, {DECIDE}, x AS (SELECT id, CASE WHEN model = 'gpt-4o' THEN 'openai' WHEN model = 'tiny@local' THEN 'openai-local' WHEN complexity = 'simple' THEN 'ollama' ELSE {CLOUD} END AS provider, {CLOUD} AS cloud, id % 3 <> 0 AS local_ok, id % 5 <> 0 AS cloud_ok, CASE WHEN id % 4 = 0 THEN 'exact' END AS hit FROM d),
y AS (SELECT *, provider IN ('ollama', 'openai-local') AND NOT local_ok AS moved FROM x)
SELECT id, CASE WHEN hit IS NOT NULL THEN 'cache' WHEN moved THEN cloud ELSE provider END AS provider, (hit IS NULL AND moved)::INTEGER AS fallback, hit AS cache_hit,
CASE WHEN hit IS NOT NULL THEN NULL WHEN moved OR provider NOT IN ('ollama', 'openai-local') THEN CASE WHEN NOT cloud_ok THEN 'upstream failed' WHEN moved THEN 'note: fell back' END END AS error FROM y""")
def _(s, d):
    r = C.decide(_decidable(s, d))
    out = r.select("id", (F.col("id") % 3 != 0).alias("local_ok"), (F.col("id") % 5 != 0).alias("cloud_ok"))
    return C.dispatch(r, out, r.filter("id % 4 = 0").select("id", F.lit("exact").alias("hit")))


ANSWERS = [
    (1, "", 0, "stop", 0, 0), (2, "Short answer that stops.", 0, "length", 20, 0), (3, "I cannot do that.", 0, "stop", 60, 0), (4, "So sorry, the tool is unable to run here.", 0, "stop", 60, 1),
    (5, "This breaks off in the", 0, "stop", 60, 0), (6, "go on " + "again " * 12 + "done.", 0, "stop", 90, 0), (7, "A fine and complete answer.", 0, "stop", 90, 0), (8, "", 1, "tool_calls", 5, 1), (9, "calling it now", 1, "stop", 5, 1),
]
REASONS = ["1", "2", "3", "4", "5", "6", "", "", ""]


@query("response_confidence", "SELECT * FROM (VALUES " + ", ".join(f"({a[0]}::BIGINT, '{r}')" for a, r in zip(ANSWERS, REASONS, strict=True)) + ") v(id, reasons)")
def _(s, d):
    a = D.values(s, ANSWERS, "id long, content string, n_tool_calls int, stop_reason string, completion_tokens int, n_tools int")
    loops = S.trigram_runs(a, "id", "content").select("id", F.lit(True).alias("loop"))
    a = a.join(loops, "id", "left")
    r = C.response_reasons(F.col("content"), F.col("n_tool_calls"), F.col("stop_reason"), F.col("completion_tokens"), F.col("n_tools"), F.coalesce("loop", F.lit(False)))
    return a.select("id", F.array_join(F.transform(r, lambda x: x.cast("string")), ",").alias("reasons"))


@query("answer_confidence", "SELECT conv_id, turn, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) = '' AS empty, regexp_matches(trim(text), '(?i)^\\s*(?:I (?:cannot|can''?t|am unable|don''?t have access|do not have)|Sorry,?\\s*I)') AS refusal FROM conversations WHERE role = 'assistant'")
def _(s, d):
    c = D.table(s, d, "conversations").filter("role = 'assistant'")
    r = C.response_reasons(F.col("text"), F.lit(0), F.lit("stop"), F.lit(100), F.lit(0), F.lit(False))
    return c.select("conv_id", "turn", F.array_contains(r, 1).alias("empty"), F.array_contains(r, 3).alias("refusal"))


BODIES = [
    (1, "/v1/messages", '{"model":"m","system":"be brief","messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}],"tools":[{"x":1}],"max_tokens":9}'),
    (2, "/v1/chat/completions", '{"model":"g","messages":[{"role":"system","content":"s1"},{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}],"temperature":0.5}'),
    (3, "/v1/responses", '{"model":"r","input":"do it"}'),
    (4, "/v1/embeddings", "not json"),
]


@query("normalized_requests", "SELECT * FROM (VALUES (1::BIGINT, 'anthropic', 'm', 'be brief', 'user:a/b', 1), (2, 'openai', 'g', 's1', 'user:hi|assistant:yo', 0), (3, 'responses', 'r', '', 'user:do it', 0), (4, 'openai', NULL, '', '', 0)) v(id, format, model, system, said, n_tools)")
def _(s, d):
    b = D.values(s, BODIES, "id long, path string, body string")
    fmt = C.request_format(F.col("path"), F.create_map().cast("map<string,string>"), F.col("body"))
    r = b.select("id", C.common_request(F.col("body"), fmt).alias("r"))
    said = F.array_join(F.transform("r.messages", lambda m: F.concat(m["role"], F.lit(":"), F.replace(m["content"], F.lit("\n"), F.lit("/")))), "|")
    return r.select("id", "r.format", "r.model", "r.system", said.alias("said"), "r.n_tools")


RENDERED = [
    ("anthropic", '{"type":"message","content":[{"type":"text","text":"hello"}],"stop_reason":"max_tokens","usage":{"input_tokens":3,"output_tokens":4}}'),
    ("openai", '{"object":"chat.completion","choices":[{"message":{"role":"assistant","content":"hello"},"finish_reason":"length"}],"usage":{"prompt_tokens":3,"completion_tokens":4}}'),
    ("responses", '{"object":"response","output_text":"hello","usage":{"input_tokens":3,"output_tokens":4}}'),
]


@query("rendered_responses", D.sql_rows(RENDERED, "fmt string, body string"))
def _(s, d):
    f = D.values(s, [("anthropic",), ("openai",), ("responses",)], "fmt string")
    return f.select("fmt", C.rendered_response(F.lit("hello"), F.lit("length"), F.lit(3), F.lit(4), F.col("fmt")).alias("body"))


ENDPOINTS = ("/v1/embeddings", "/v1/responses", "/v1/completions", "/v1/messages", "/v1/chat/completions", "/v1/messages/batches", "/v1/responses/", "/v1/files")
_ENDPOINT = "[" + ", ".join(f"'{p}'" for p in ENDPOINTS) + "]"


@query("endpoint_kinds", f"WITH {D.HISTORY}, p AS (SELECT event_id AS id, {_ENDPOINT}[event_id % {len(ENDPOINTS)} + 1] AS e, CASE WHEN e LIKE '%/' THEN e || k ELSE e END AS path FROM history) SELECT id, path, CASE WHEN path = '/v1/embeddings' THEN 'embedding' WHEN path = '/v1/responses' OR starts_with(path, '/v1/responses/') THEN 'responses' WHEN path = '/v1/completions' THEN 'completion' ELSE 'chat' END AS kind FROM p")
def _(s, d):
    """Each event as a request to one of eight endpoints."""
    e = F.element_at(F.array(*map(F.lit, ENDPOINTS)), (F.col("event_id") % len(ENDPOINTS) + 1).cast("int"))
    path = F.when(F.endswith(e, F.lit("/")), F.concat(e, F.col("k").cast("string"))).otherwise(e)
    p = D.history(s, d).select(F.col("event_id").alias("id"), path.alias("path"))
    fmt = C.request_format(F.col("path"), F.create_map().cast("map<string,string>"), F.lit(None).cast("string"))
    return p.select("id", "path", C.endpoint_kind(fmt, F.col("path")).alias("kind"))


@query("next_tool_hints", "SELECT * FROM (VALUES ('code_search', 'code_impact'), ('memory_search', 'code_search,script_search'), ('other', '')) v(tool, next)")
def _(s, d):
    t = D.values(s, [("code_search",), ("memory_search",), ("other",)], "tool string")
    return t.select("tool", F.array_join(C.hints(F.col("tool"), F.array(F.lit("code_context"))), ",").alias("next"))


@query("since_windows", "SELECT * FROM (VALUES ('7d', 604800::BIGINT), ('24h', 86400), ('30m', 1800), ('x', NULL)) v(since, seconds)")
def _(s, d):
    from lodestore.functions.text import parse_since

    return D.values(s, [("7d",), ("24h",), ("30m",), ("x",)], "since string").select("since", parse_since(F.col("since")).alias("seconds"))
