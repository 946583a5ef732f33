"""Request-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.functions import text as X
from lodestore.operators import requests as R
from lodestore.plans import data as D

Q, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


L = "provider IN ('ollama', 'openai-local')"
SAVED = f"(cache_hit IS NOT NULL OR {L})"
ERR = "(error IS NOT NULL AND NOT starts_with(error, 'note:'))"
pct = lambda c: f"CASE WHEN count(*) = 0 THEN 0 ELSE round(count(*) FILTER ({c})::DOUBLE / count(*) * 1000) / 10 END"
MEASURES = f"""count(*) AS total, {pct(L)} AS local_pct, {pct(f"NOT {L} AND provider <> 'cache'")} AS cloud_pct, {pct("fallback <> 0")} AS fallback_pct,
 {pct("cache_hit IS NOT NULL")} AS cache_hit_pct, {pct(ERR)} AS error_pct,
 (coalesce(sum(prompt_tokens) FILTER ({SAVED}), 0) + coalesce(sum(completion_tokens) FILTER ({SAVED}), 0))::BIGINT AS est_tokens_saved,
 round((coalesce(sum(prompt_tokens) FILTER ({SAVED}), 0) * 3.0::DOUBLE + coalesce(sum(completion_tokens) FILTER ({SAVED}), 0) * 15.0::DOUBLE) / 1000000, 4) AS est_cost_saved_usd"""


@query("request_dashboard", f"WITH {D.REQUESTS} SELECT {MEASURES} FROM requests")
def _(s, d):
    return R.dashboard(D.requests(s, d))


@query("daily_rollup", f"WITH {D.REQUESTS} SELECT strftime(ts, '%Y-%m-%d') AS date, {MEASURES} FROM requests GROUP BY 1")
def _(s, d):
    return R.daily_rollup(D.requests(s, d)).withColumn("date", F.col("date").cast("string"))


@query("endpoint_breakdown", f"WITH {D.REQUESTS} SELECT endpoint, count(*) AS count, count(*) FILTER ({L}) AS local, count(*) FILTER (NOT {L} AND provider <> 'cache') AS cloud, count(cache_hit) AS cache FROM requests GROUP BY endpoint")
def _(s, d):
    return R.endpoint_breakdown(D.requests(s, d))


def _p(by=""):
    idx = lambda p: f"v[(floor(len(v) * {p}::DOUBLE))::BIGINT + 1]"
    return f"WITH {D.REQUESTS}, l AS (SELECT {by}list(latency_ms ORDER BY latency_ms) AS v FROM requests WHERE latency_ms IS NOT NULL {'GROUP BY ' + by.rstrip(', ') if by else ''}) SELECT {by}{idx(0.5)} AS p50, {idx(0.95)} AS p95, {idx(0.99)} AS p99 FROM l"


@query("latency_percentiles", _p())
def _(s, d):
    return R.percentiles(D.requests(s, d))


@query("latency_percentiles_by_endpoint", _p("endpoint, "))
def _(s, d):
    return R.percentiles(D.requests(s, d), by=("endpoint",))


@query("latency_histogram", f"WITH {D.REQUESTS}, b AS (SELECT unnest([10, 50, 100, 250, 500, 1000, 2500, 5000, 10000]) AS b) SELECT b::VARCHAR AS le, (SELECT count(*) FROM requests WHERE latency_ms <= b) AS n FROM b UNION ALL SELECT '+Inf', count(latency_ms) FROM requests")
def _(s, d):
    return R.histogram(D.requests(s, d)).select("le", "n")


@query("provider_model_counts", f"WITH {D.REQUESTS} SELECT provider, model, count(*) FILTER (NOT {ERR}) AS ok, count(*) FILTER ({ERR}) AS err, count(*) AS total FROM requests GROUP BY ALL".replace("FILTER (NOT (error IS NOT NULL AND NOT", "FILTER (error IS NULL OR NOT (error IS NOT NULL AND NOT"))
def _(s, d):
    return R.provider_model_counts(D.requests(s, d))


@query("cache_fallback_ratios", f"WITH {D.REQUESTS} SELECT round(avg((cache_hit IS NOT NULL)::INTEGER), 4) AS cache_hit_ratio, round(avg((fallback <> 0)::INTEGER), 4) AS fallback_ratio FROM requests")
def _(s, d):
    return R.ratios(D.requests(s, d))


@query("metrics_export", f"""WITH {D.REQUESTS}, c AS (SELECT provider, model, count(*) FILTER (coalesce(starts_with(error, 'note:'), true)) AS ok, count(*) AS total FROM requests GROUP BY ALL), b AS (SELECT unnest([10, 50, 100, 250, 500, 1000, 2500, 5000, 10000]) AS b)
SELECT 'router_requests_total{{provider="' || provider || '",model="' || model || '",status="ok"}} ' || ok AS line FROM c UNION ALL SELECT 'router_requests_total{{provider="' || provider || '",model="' || model || '",status="error"}} ' || (total - ok) FROM c
UNION ALL SELECT 'router_cache_hit_ratio ' || printf('%.4f', avg((cache_hit IS NOT NULL)::INTEGER)) FROM requests UNION ALL SELECT 'router_fallback_ratio ' || printf('%.4f', avg((fallback <> 0)::INTEGER)) FROM requests
UNION ALL SELECT 'router_request_latency_ms_bucket{{le="' || b || '"}} ' || (SELECT count(*) FROM requests WHERE latency_ms <= b) FROM b UNION ALL SELECT 'router_request_latency_ms_bucket{{le="+Inf"}} ' || count(latency_ms) FROM requests
UNION ALL SELECT 'router_request_latency_ms_sum ' || sum(latency_ms) FROM requests UNION ALL SELECT 'router_request_latency_ms_count ' || count(latency_ms) FROM requests""")
def _(s, d):
    return R.metrics_text(D.requests(s, d)).select("line")


KINDS = "['session_load_decision', 'session_load_research', 'research_search_hit', 'memory_check_hit', 'duplicate_save_avoided', 'other'][event_id % 6 + 1]"
RATES = D.sql_values(list(R.SAVINGS), "kind string, tokens long, seconds long", "rates")


@query("savings_accounting", f"WITH {D.HISTORY}, {RATES}, e AS (SELECT {KINDS} AS kind FROM history) SELECT sum(tokens)::BIGINT AS tokens_saved, sum(seconds)::BIGINT AS seconds_saved, count(*) AS hits, round(sum(tokens) / 1000.0::DOUBLE * 0.012::DOUBLE, 4) AS cost_saved FROM e JOIN rates USING (kind)")
def _(s, d):
    kinds = F.array(*(F.lit(k) for k, _, _ in R.SAVINGS), F.lit("other"))
    e = D.history(s, d).select(F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")).alias("kind"))
    return R.savings(e, D.values(s, list(R.SAVINGS), "kind string, tokens long, seconds long"))


@query("savings_recomputed", f"WITH {D.HISTORY}, n AS (SELECT greatest((SELECT count(DISTINCT strftime(ts, '%Y-%m-%d %H')) FROM history WHERE event_type = 'view'), (SELECT count(*) FROM history WHERE event_type = 'signup'), 1) AS n) SELECT n AS sessions, n * 2 AS checks, round(n * 2 * 0.3::DOUBLE)::BIGINT AS hits FROM n")
def _(s, d):
    h = D.history(s, d)
    return R.recomputed_sessions(h.filter("event_type = 'view'"), h.filter("event_type = 'signup'"))


CACHE = "cache AS (SELECT 'h' || event_id AS hash, k % 5 AS hits, (epoch_us(ts) // 1000) AS ts FROM history)"


def _cache(s, d):
    return D.history(s, d).select(F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("hash"), (F.col("k") % 5).alias("hits"), F.unix_millis("ts").alias("ts"))


@query("lru_prune", f"WITH {D.HISTORY}, {CACHE} SELECT * FROM cache ORDER BY hits DESC, ts DESC, hash LIMIT 300")
def _(s, d):
    return R.lru_prune(_cache(s, d), 300)


@query("cache_upsert", f"WITH {D.HISTORY}, {CACHE}, new AS (SELECT hash, ts + 1 AS ts FROM cache WHERE ts % 3 = 0 UNION ALL SELECT 'x' || hash, ts FROM cache WHERE ts % 7 = 0) SELECT hash, hits, ts FROM cache WHERE hash NOT IN (SELECT hash FROM new) UNION ALL SELECT n.hash, coalesce(c.hits, 0), n.ts FROM new n LEFT JOIN cache c USING (hash)")
def _(s, d):
    c = _cache(s, d)
    new = c.filter("ts % 3 = 0").select("hash", (F.col("ts") + 1).alias("ts"), F.lit(9).alias("hits")).unionByName(c.filter("ts % 7 = 0").select(F.concat(F.lit("x"), "hash").alias("hash"), "ts", F.lit(9).alias("hits")))
    return R.upsert_cache(c, new).select("hash", "hits", "ts")


@query("cache_summary", f"WITH {D.HISTORY}, {CACHE} SELECT count(*) AS entries, sum(hits)::BIGINT AS hits, min(ts) AS oldest, max(ts) AS newest FROM cache")
def _(s, d):
    return R.cache_summary(_cache(s, d))


@query("request_log_rows", f"WITH {D.REQUESTS} SELECT id, provider, substring(error, 1, 500) AS error FROM requests")
def _(s, d):
    return R.log_rows(D.requests(s, d), ("id", "provider", "error"))


HEADERS = [(1, "Authorization", "x"), (1, "Accept", "y"), (2, "x-api-key", "k"), (2, "Host", "h"), (3, "Cookie", "c")]


@query("header_redaction", f"WITH {D.sql_values(HEADERS, 'id long, k string, v string', 'h')} SELECT id, coalesce(string_agg(k || '=' || v, ',' ORDER BY k) FILTER (k IN ('Accept', 'Host')), '') AS kept FROM h GROUP BY id")
def _(s, d):
    h = D.values(s, HEADERS, "id long, k string, v string").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    kept = F.transform(F.array_sort(F.map_entries(R.redact_headers(F.col("m")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return h.select("id", F.array_join(kept, ",").alias("kept"))


@query("cached_answers", f"""WITH {D.HISTORY}, r AS (SELECT event_id AS id, event_type || user_id || '/' || (k % 4) AS hash, user_id AS tenant, (epoch_us(ts) // 1000) AS ts_ms, [(k % 17)::DOUBLE, (k % 5)::DOUBLE, 1.0::DOUBLE] AS vec FROM history),
e AS (SELECT a.id, 'exact' AS hit, max_by(b.id, (b.ts_ms, b.id)) AS by FROM r a JOIN r b ON a.hash = b.hash AND b.ts_ms < a.ts_ms AND a.ts_ms - b.ts_ms <= 86400000 GROUP BY a.id),
s AS (SELECT a.id, 'semantic' AS hit, max_by(b.id, (b.ts_ms, b.id)) AS by FROM r a JOIN r b ON a.tenant = b.tenant AND b.ts_ms < a.ts_ms AND a.ts_ms - b.ts_ms <= 86400000 AND list_cosine_similarity(a.vec, b.vec) >= 0.92 WHERE a.id NOT IN (SELECT id FROM e) GROUP BY a.id)
SELECT * FROM e UNION ALL SELECT * FROM s""")
def _(s, d):
    h = D.history(s, d)
    r = h.select(F.col("event_id").alias("id"), F.concat("event_type", F.col("user_id").cast("string"), F.lit("/"), (F.col("k") % 4).cast("string")).alias("hash"), F.col("user_id").alias("tenant"), F.unix_millis("ts").alias("ts_ms"), F.array((F.col("k") % 17).cast("double"), (F.col("k") % 5).cast("double"), F.lit(1.0)).alias("vec"))
    return R.cached_answers(r, 86_400_000)


BREAKER = f"""WITH RECURSIVE {D.HISTORY}, c AS (SELECT event_type AS provider, event_id AS seq, (epoch_us(ts) // 1000) AS ts, k % 3 = 0 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000), event_id) AS rn FROM history),
m AS (SELECT provider, 0::BIGINT AS rn, 0::BIGINT AS seq, 'CLOSED' AS state, 0 AS failures, 0::BIGINT AS opened, true AS allowed FROM c GROUP BY provider
 UNION ALL
 SELECT c.provider, c.rn, c.seq,
  CASE WHEN NOT a THEN 'OPEN' WHEN c.ok THEN 'CLOSED' WHEN m.state = 'OPEN' OR m.failures + 1 >= 5 THEN 'OPEN' ELSE 'CLOSED' END,
  CASE WHEN NOT a THEN m.failures WHEN c.ok THEN 0 ELSE m.failures + 1 END,
  CASE WHEN a AND NOT c.ok AND (m.state = 'OPEN' OR m.failures + 1 >= 5) THEN c.ts ELSE m.opened END, a
 FROM (SELECT m.*, c2.ts AS nts, (m.state <> 'OPEN' OR c2.ts - m.opened >= 30000000) AS a FROM m JOIN c c2 ON c2.provider = m.provider AND c2.rn = m.rn + 1) m JOIN c ON c.provider = m.provider AND c.rn = m.rn + 1)
SELECT provider, seq, state, allowed FROM m WHERE rn > 0"""


@query("breaker_states", BREAKER)
def _(s, d):
    h = D.history(s, d)
    return R.breaker_states(h.select(F.col("event_type").alias("provider"), F.col("event_id").alias("seq"), F.unix_millis("ts").alias("ts_ms"), (F.col("k") % 3 == 0).alias("ok")), rest_ms=30_000_000)


@query("request_keys", "SELECT conv_id, turn, sha256('noauth' || chr(10) || '{\"messages\":' || to_json(text) || ',\"model\":\"m\"}') AS key FROM conversations")
def _(s, d):
    c = D.table(s, d, "conversations")
    return c.select("conv_id", "turn", R.request_hash(F.lit("m"), F.col("text")).alias("key"))


#: in whole numbers, halves up
FIGURES = """WITH v AS (SELECT event_id AS id, event_id * event_id * 37 % 4000000 AS n, CAST(round(value * 100) AS BIGINT) * (event_id % 97) AS hundredths FROM events),
f AS (SELECT *, (n + 50) // 100 AS k, (n + 50000) // 100000 AS m, (hundredths + 18000) // 36000 AS h, (n + 5) // 10 AS c FROM v)
SELECT id, CASE WHEN n >= 1000000 THEN (m // 10) || '.' || (m % 10) || 'M' WHEN n >= 1000 THEN (k // 10) || '.' || (k % 10) || 'K' ELSE n::VARCHAR END AS n,
  CASE WHEN hundredths < 6000 THEN ((hundredths + 50) // 100) || ' sec' WHEN hundredths < 360000 THEN ((hundredths + 3000) // 6000) || ' min' ELSE (h // 10) || '.' || (h % 10) || ' hrs' END AS d,
  '$' || (c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS c FROM f"""


@query("formatted_figures", FIGURES)
def _(s, d):
    """A number, a duration and a cost of each event."""
    n = F.col("event_id") * F.col("event_id") * 37 % 4_000_000
    secs = F.round(F.col("value") * 100).cast("long") * (F.col("event_id") % 97) / 100
    v = D.table(s, d, "events").select(F.col("event_id").alias("id"), n.alias("n"), secs.alias("secs"))
    return v.select("id", X.format_number(F.col("n")).alias("n"), X.format_duration(F.col("secs")).alias("d"), X.format_cost(F.col("n") / 1000).alias("c"))
