"""The driver tables as stores of findings, histories, logs and graphs: frames and the SQL for the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.session import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return read_table(spark, path) if name == "documents" else spark.read.parquet(path)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as research findings."""
    d = table(spark, sf_dir, "documents")
    stale = F.element_at(F.array(F.lit("stable"), F.lit("versioned"), F.lit("volatile")), (F.col("doc_id") % 3 + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.substring("text", 1, 60).alias("topic"),
        F.array("lang", "source").alias("tags"),
        F.col("text").alias("finding"),
        stale.alias("staleness"),
        F.round(F.col("doc_id") % 10 / 10.0, 1).alias("confidence"),
        (F.lit(1704067200) + F.col("doc_id") * 3600).alias("epoch"),
    )


FINDINGS = """findings AS (
  SELECT doc_id AS id, substring(text, 1, 60) AS topic, [lang, source] AS tags, text AS finding,
         ['stable', 'versioned', 'volatile'][doc_id % 3 + 1] AS staleness, round(doc_id % 10 / 10.0::DOUBLE, 1) AS confidence,
         1704067200 + doc_id * 3600 AS epoch FROM documents)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tool calls; a command is made of each event's type and payload."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", k.alias("k"),
        F.concat(F.lit("tool "), "event_type", F.lit(" --key "), k.cast("string"), F.lit(" --target item-"), (F.col("event_id") % 7).cast("string"), F.lit(" --mode batch")).alias("command"),
        (F.col("event_type") != "error").alias("success"),
        F.col("event_type").isin("view", "click").alias("exploratory"),
    )


HISTORY = """history AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         'tool ' || event_type || ' --key ' || json_extract_string(props, '$.k') || ' --target item-' || (event_id % 7) || ' --mode batch' AS command,
         event_type <> 'error' AS success, event_type IN ('view', 'click') AS exploratory FROM events)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the request log."""
    h = history(spark, sf_dir)
    pick = lambda values, i: F.element_at(F.array(*(F.lit(v) for v in values)), (i % len(values) + 1).cast("int"))
    provider = pick(["ollama", "openai-local", "anthropic", "openai"], F.col("user_id"))
    return h.select(
        F.col("event_id").alias("id"), "ts", (F.unix_millis("ts")).alias("ts_ms"), F.col("event_type").alias("endpoint"),
        pick(["simple", "medium", "complex"], F.col("event_id")).alias("classification"),
        provider.alias("provider"), F.concat(provider, F.lit("-m"), (F.col("k") % 3).cast("string")).alias("model"),
        (F.col("k") * 7 % 2000).alias("prompt_tokens"), (F.col("event_id") * 13 % 700).alias("completion_tokens"),
        F.round(F.col("value") * 10).cast("long").alias("latency_ms"),
        (F.col("event_id") % 11 == 0).cast("int").alias("fallback"),
        F.when(F.col("k") % 10 == 0, "exact").when(F.col("k") % 10 == 1, "semantic").alias("cache_hit"),
        F.when(F.col("event_type") == "error", "upstream failed").when(F.col("event_id") % 11 == 0, "note: fell back").alias("error"),
    )


REQUESTS = (
    HISTORY
    + """, requests AS (
  SELECT event_id AS id, ts, (epoch_us(ts) // 1000) AS ts_ms, event_type AS endpoint, ['simple', 'medium', 'complex'][event_id % 3 + 1] AS classification,
         ['ollama', 'openai-local', 'anthropic', 'openai'][user_id % 4 + 1] AS provider,
         ['ollama', 'openai-local', 'anthropic', 'openai'][user_id % 4 + 1] || '-m' || (k % 3) AS model,
         k * 7 % 2000 AS prompt_tokens, event_id * 13 % 700 AS completion_tokens, CAST(round(value * 10) AS BIGINT) AS latency_ms,
         CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS fallback,
         CASE WHEN k % 10 = 0 THEN 'exact' WHEN k % 10 = 1 THEN 'semantic' END AS cache_hit,
         CASE WHEN event_type = 'error' THEN 'upstream failed' WHEN event_id % 11 = 0 THEN 'note: fell back' END AS error
  FROM history)"""
)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, nations, regions and suppliers as (s, p, o, src)."""
    c, n, s = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))
    key = lambda kind, col: F.concat(F.lit(f"{kind}_"), F.col(col).cast("string"))
    return (
        c.select(key("cust", "c_custkey").alias("s"), F.lit("lives_in").alias("p"), key("nation", "c_nationkey").alias("o"), F.col("c_custkey").alias("src"))
        .unionByName(s.select(key("supp", "s_suppkey").alias("s"), F.lit("uses").alias("p"), key("nation", "s_nationkey").alias("o"), (F.col("s_suppkey") + 1000000).alias("src")))
        .unionByName(n.select(key("nation", "n_nationkey").alias("s"), F.lit("depends_on").alias("p"), key("region", "n_regionkey").alias("o"), (F.col("n_nationkey") + 2000000).cast("long").alias("src")))
        .unionByName(c.select(key("cust", "c_custkey").alias("s"), F.lit("mentions").alias("p"), F.concat(F.lit("cust_"), (F.col("c_custkey") % 50 + 1).cast("string")).alias("o"), (F.col("c_custkey") + 3000000).alias("src")))
    )


TRIPLES = """triples AS (
  SELECT 'cust_' || c_custkey AS s, 'lives_in' AS p, 'nation_' || c_nationkey AS o, c_custkey AS src FROM customer
  UNION ALL SELECT 'supp_' || s_suppkey, 'uses', 'nation_' || s_nationkey, s_suppkey + 1000000 FROM supplier
  UNION ALL SELECT 'nation_' || n_nationkey, 'depends_on', 'region_' || n_regionkey, n_nationkey + 2000000 FROM nation
  UNION ALL SELECT 'cust_' || c_custkey, 'mentions', 'cust_' || (c_custkey % 50 + 1), c_custkey + 3000000 FROM customer)"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as notes about code (id, text): a file and its classes, an address and calls, a plain remark, no text."""
    adj, noun = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    a, n, key, size = F.initcap(adj), F.initcap(noun), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    kind = F.col("p_partkey") % 5
    text = (
        F.when(kind == 0, say(n, a, ".cs uses X", n, "Document. The Find", a, n, "s() method returns ", a, n, " objects."))
        .when(kind == 1, say(n, a, " and Make", n, "Async are in ", a, ".", n, "! ", n, a, " extends X", n, "Document"))
        .when(kind == 2, say("See https://dev", size, ".example.com/", noun, "/_apis/build/", key, "/logs and run npm; Get", n, "Async calls parse", a, "()"))
        .when(kind == 3, say(F.col("p_name"), " is nothing new"))
    )
    return read_table(spark, f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), text.alias("text"))


NOTES = """words AS (
  SELECT *, string_split(p_name, ' ')[1] AS adj, string_split(p_name, ' ')[2] AS noun, upper(p_name[1]) || adj[2:] AS a, upper(noun[1]) || noun[2:] AS n FROM part),
notes AS (
  SELECT p_partkey AS id, CASE p_partkey % 5
    WHEN 0 THEN n || a || '.cs uses X' || n || 'Document. The Find' || a || n || 's() method returns ' || a || n || ' objects.'
    WHEN 1 THEN n || a || ' and Make' || n || 'Async are in ' || a || '.' || n || '! ' || n || a || ' extends X' || n || 'Document'
    WHEN 2 THEN 'See https://dev' || p_size || '.example.com/' || noun || '/_apis/build/' || p_partkey || '/logs and run npm; Get' || n || 'Async calls parse' || a || '()'
    WHEN 3 THEN p_name || ' is nothing new' END AS text FROM words)"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as shell commands of eight kinds (id, command), the last without text."""
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    key, kind, k, user = F.col("event_id").cast("string"), F.col("event_type"), F.get_json_object("props", "$.k"), F.col("user_id").cast("string")
    uuid = F.regexp_replace(F.md5(key), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    shapes = [
        say('curl -X POST "https://api.example.com/projects/', uuid, "/builds/", k, "\" -d '{\"title\": \"a long title of ", kind, " for user ", user, "\"}'"),
        say("grep -rn ", kind, " src | head -", k), say("node scripts/", kind, ".js --env production -o out/", user, ".Json"), say('cat "/tmp/some/longer/path/', kind, "-", key, '.txt" | python -c "import sys" && echo done'),
        say("git log  --oneline -n ", k), say("npm install ", kind, "-pad"), say("make ", kind, ".md check.", k), F.lit(None).cast("string"),
    ]
    command = F.coalesce(*(F.when(F.col("event_id") % 8 == i, c) for i, c in enumerate(shapes)))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), command.alias("command"))


COMMANDS = """keyed AS (SELECT *, md5(event_id::VARCHAR) AS h, props ->> '$.k' AS k FROM events),
commands AS (
  SELECT event_id AS id, CASE event_id % 8
    WHEN 0 THEN 'curl -X POST "https://api.example.com/projects/' || h[:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:] || '/builds/' || k || '" -d ''{"title": "a long title of ' || event_type || ' for user ' || user_id || '"}' || chr(39)
    WHEN 1 THEN 'grep -rn ' || event_type || ' src | head -' || k
    WHEN 2 THEN 'node scripts/' || event_type || '.js --env production -o out/' || user_id || '.Json'
    WHEN 3 THEN 'cat "/tmp/some/longer/path/' || event_type || '-' || event_id || '.txt" | python -c "import sys" && echo done'
    WHEN 4 THEN 'git log  --oneline -n ' || k
    WHEN 5 THEN 'npm install ' || event_type || '-pad'
    WHEN 6 THEN 'make ' || event_type || '.md check.' || k END AS command FROM keyed)"""


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small inline table."""
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], schema: str, name: str) -> str:
    """The same as a CTE."""
    kind = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    cols = [c.strip().rsplit(" ", 1) for c in schema.split(", ")]

    def lit(v) -> str:
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    casts = ", ".join(f"CAST({c} AS {kind.get(t, t)}) AS {c}" for c, t in cols)
    return f"{name} AS (SELECT {casts} FROM (VALUES {body}) AS v({', '.join(c for c, _ in cols)}))"


def sql_rows(rows: list[tuple], schema: str) -> str:
    """SQL that gives exactly these rows."""
    return f"WITH {sql_values(rows, schema, 'expected')} SELECT * FROM expected"
