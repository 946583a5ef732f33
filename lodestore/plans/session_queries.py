"""Session, history and chain queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.functions import text as X
from lodestore.operators import sessions as S
from lodestore.plans import data as D
from lodestore.plans.search_queries import TOK

Q, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


H = D.HISTORY
TRIVIAL = r"(len(trim(command)) < 30 OR regexp_matches(trim(command), '(?i)^\s*(ls|dir|cat|head|tail|echo|cd|pwd|whoami|date|clear|cls|type|set|env|which|where)\b') OR (regexp_matches(trim(command), '(?i)^\s*(ls|find|dir|tree)\s') AND NOT regexp_matches(trim(command), '(?i)\|\s*(node|python|grep)')))"
ORDER = "PARTITION BY user_id ORDER BY ts, event_id"


@query("gap_sessions", f"WITH {H}, g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER ({ORDER}) <= 90000000 THEN 0 ELSE 1 END AS cut, event_id FROM history), r AS (SELECT *, sum(cut) OVER ({ORDER}) AS run FROM g) SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n FROM r GROUP BY user_id, run")
def _(s, d):
    return S.gap_sessions(D.history(s, d)).select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n")


@query("rolling_last", f"WITH {H}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM history) SELECT user_id, event_id, age::INTEGER AS age FROM r WHERE age <= 50")
def _(s, d):
    return S.rolling_last(D.history(s, d)).select("user_id", "event_id", "age")


@query("retry_success", f"WITH {H}, t AS (SELECT *, {TOK.replace('text', 'lower(trim(command))')} AS toks, row_number() OVER ({ORDER}) AS rn FROM history) SELECT DISTINCT c.event_id, c.user_id FROM t c JOIN t f ON c.user_id = f.user_id AND f.rn BETWEEN c.rn - 10 AND c.rn - 1 WHERE c.success AND NOT f.success AND f.toks[1] = c.toks[1] AND len(list_filter(c.toks, lambda x: list_contains(f.toks, x))) / greatest(len(f.toks), len(c.toks))::DOUBLE > 0.3")
def _(s, d):
    return S.retry_success(D.history(s, d)).select("event_id", "user_id")


@query("exploration_success", f"WITH {H}, e AS (SELECT *, sum(exploratory::INTEGER) OVER ({ORDER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS explored FROM history) SELECT event_id, user_id, explored::BIGINT AS explored FROM e WHERE exploratory AND success AND explored >= 3")
def _(s, d):
    return S.exploration_success(D.history(s, d)).select("event_id", "user_id", "explored")


CHAINS = f"""f AS (SELECT *, sum((NOT success)::INTEGER) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS fails FROM history),
n AS (SELECT * FROM f WHERE success AND NOT {TRIVIAL}),
c AS (SELECT *, CASE WHEN lag(fails) OVER ({ORDER}) = fails AND epoch_us(ts) - lag(epoch_us(ts)) OVER ({ORDER}) <= 90000000::BIGINT * {{mult}} THEN 0 ELSE 1 END AS cut FROM n),
r AS (SELECT *, sum(cut) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS run FROM c),
k AS (SELECT user_id, event_id, least(9, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id)) AS length FROM r)"""


@query("workflow_chains", f"WITH {H}, {CHAINS.format(mult=200)} SELECT user_id, event_id, length::BIGINT AS length FROM k WHERE length >= 2")
def _(s, d):
    return S.chains(D.history(s, d), gap_seconds=18000).select("user_id", "event_id", "length")


OVERLAP = f"""WITH {H}, n AS (SELECT *, (row_number() OVER ({ORDER}) - 1) // 4 AS block FROM history),
c AS (SELECT block % 2 AS side, min(event_id) AS id, list(event_type ORDER BY ts, event_id) AS steps FROM n GROUP BY user_id, block),
k AS (SELECT side, steps, min(id) AS id, count(*) AS chains FROM c GROUP BY side, steps),
w AS (SELECT side, id, chains, len(steps) AS n, unnest(steps) AS step, generate_subscripts(steps, 1) AS i FROM k),
m AS (SELECT a.id AS a_id, b.id AS b_id, count(DISTINCT CASE WHEN a.n <= b.n THEN a.i ELSE b.i END) / max(greatest(a.n, b.n))::DOUBLE AS overlap, max(a.chains) AS a_chains, max(b.chains) AS b_chains
  FROM w a JOIN w b ON a.side = 0 AND b.side = 1 AND a.step = b.step AND abs(a.i - b.i) <= 1 GROUP BY a.id, b.id)
SELECT * FROM m WHERE overlap >= 0.7"""


@query("chain_overlap", OVERLAP)
def _(s, d):
    """Every other four events of a user against the four between: kinds of chains (equal steps) by their first, with the number of chains of each kind."""
    h = D.history(s, d).select("user_id", "ts", "event_id", "event_type")
    h = h.withColumn("block", F.floor((F.row_number().over(S._by("user_id", "ts", "event_id")) - 1) / 4))
    c = h.groupBy("user_id", "block").agg(F.min("event_id").alias("id"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    kinds = c.groupBy((F.col("block") % 2).alias("side"), F.col("e.event_type").alias("steps")).agg(F.min("id").alias("id"), F.count("*").alias("chains"))
    a, b = (kinds.filter(F.col("side") == i) for i in (0, 1))
    of = lambda k, name: k.select(F.col("id").alias(f"{name}_id"), F.col("chains").alias(f"{name}_chains"))
    return S.chain_overlap(a.select("id", "steps"), b.select("id", "steps")).join(of(a, "a"), "a_id").join(of(b, "b"), "b_id").select("a_id", "b_id", "overlap", "a_chains", "b_chains")


@query("session_asof", f"WITH {H}, st AS (SELECT user_id, ts, event_id AS session_seq FROM history WHERE event_type = 'signup'), en AS (SELECT user_id, ts, event_id FROM history WHERE event_type = 'purchase') SELECT en.event_id, en.user_id, (SELECT max_by(session_seq, (st.ts, st.session_seq)) FROM st WHERE st.user_id = en.user_id AND st.ts <= en.ts) AS session_seq FROM en")
def _(s, d):
    h = D.history(s, d).select("user_id", "ts", "event_id", "event_type")
    return S.session_asof(h.filter("event_type = 'purchase'"), h.filter("event_type = 'signup'")).select("event_id", "user_id", "session_seq")


@query("next_session_bound", f"WITH {H} SELECT event_id, epoch_us(lead(ts) OVER ({ORDER})) AS until FROM history WHERE event_type = 'signup'")
def _(s, d):
    return S.next_bound(D.history(s, d).filter("event_type = 'signup'")).select("event_id", F.unix_micros("until").alias("until"))


@query("checkpoint_every_40", f"WITH {H}, c AS (SELECT user_id, event_id, row_number() OVER ({ORDER}) AS calls FROM history) SELECT * FROM c WHERE calls % 40 = 0")
def _(s, d):
    return S.checkpoints(D.history(s, d)).select("user_id", "event_id", "calls")


BUDGET = f"""WITH {D.FINDINGS}, u AS (SELECT id, tags[2] AS grp, epoch, len(topic) AS size, coalesce(sum(len(topic) + 1) OVER w, 0) AS used FROM findings WINDOW w AS (PARTITION BY tags[2] ORDER BY epoch DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, max((used + size > 600)::INTEGER) OVER (PARTITION BY grp ORDER BY epoch DESC, id ROWS UNBOUNDED PRECEDING) AS past FROM u) SELECT id, grp FROM o WHERE past = 0"""


@query("budgeted_index", BUDGET)
def _(s, d):
    f = D.findings(s, d).select("id", F.get("tags", F.lit(1)).alias("grp"), "epoch", F.length("topic").alias("size"))
    return S.budgeted(f, "size", 600, "grp", F.desc("epoch"), "id").select("id", "grp")


LOOPS = """WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: len(x) > 0) AS toks FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(toks) - 1)) AS i, toks FROM t WHERE len(text) >= 30 AND len(toks) >= 8),
x AS (SELECT doc_id, i, toks[i] || ' ' || toks[i + 1] || ' ' || toks[i + 2] AS tri FROM g),
k AS (SELECT doc_id, i, tri, i - row_number() OVER (PARTITION BY doc_id, tri ORDER BY i) AS island FROM x),
r AS (SELECT doc_id, tri, island, count(*) AS n FROM k GROUP BY ALL)
SELECT doc_id AS id, max(n) AS run FROM r GROUP BY doc_id HAVING max(n) > 5"""


@query("trigram_loops", LOOPS)
def _(s, d):
    return S.trigram_runs(D.table(s, d, "documents"), "doc_id", "text")


@query("last_messages", "SELECT conv_id, max_by(text, turn) FILTER (role = 'user') AS last_user, max_by(text, turn) FILTER (role = 'assistant') AS last_assistant FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0")
def _(s, d):
    c = D.table(s, d, "conversations")
    u = S.last_of_role(c, "user").withColumnRenamed("text", "last_user")
    return u.join(S.last_of_role(c, "assistant").withColumnRenamed("text", "last_assistant"), "conv_id", "left")


@query("workflow_candidates", f"WITH {H} SELECT event_type || '/' || (k % 5) AS fingerprint, count(*) AS occurrences, CASE WHEN event_type || '/' || (k % 5) = 'view/0' THEN 'created' WHEN count(*) >= 2 THEN 'suggested' ELSE 'candidate' END AS status FROM history GROUP BY 1")
def _(s, d):
    h = D.history(s, d).select(F.concat_ws("/", "event_type", (F.col("k") % 5).cast("string")).alias("fingerprint"))
    return S.candidates(h, created=D.values(s, [("view/0",)], "fingerprint string"))


PARAMS = [(1, "id", 1, "first", "a"), (1, "id", 2, "second", "b"), (1, "path", 2, "p", "c"), (2, "id", 9, "x", "d"), (2, "id", 3, "y", "e")]
PARAM_SCHEMA = "wf long, name string, ordinal long, description string, dflt string"


@query("merge_workflow_params", f"WITH {D.sql_values(PARAMS, PARAM_SCHEMA, 'p')} SELECT wf, name, min(ordinal) AS ordinal, min_by(description, ordinal) AS description, min_by(dflt, ordinal) AS dflt FROM p GROUP BY wf, name")
def _(s, d):
    return S.first_definitions(D.values(s, PARAMS, PARAM_SCHEMA), "wf")


@query("intent_detect", "SELECT event_id, false AS exploratory FROM events")
def _(s, d):
    h = D.history(s, d)
    return h.select("event_id", X.is_exploratory(F.col("command"), F.lit(None).cast("string")).alias("exploratory"))
