"""Streams with timers, and answers translated while they stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.plans import data as D
from lodestore.session import own_dir
from lodestore.streaming import streams as X
from lodestore.streaming import timers, wire

Q, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _bursts_sql(quiet_ms: int) -> str:
    """Bursts that are over: a later event of the user shows it, or the watermark (ten minutes behind the last event of all) has passed the quiet period."""
    return f"""WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events),
g AS (SELECT *, sum(CASE WHEN ms - before > {quiet_ms} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS burst FROM (SELECT *, lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS before FROM e)),
b AS (SELECT user_id, burst, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n FROM g GROUP BY ALL)
SELECT user_id, first_ms, last_ms, n FROM b QUALIFY burst < max(burst) OVER (PARTITION BY user_id) OR last_ms + {quiet_ms} < (SELECT max(ms) FROM e) - 600000"""


@query("stream_debounced", _bursts_sql(1_800_000))
def _(s, d):
    """One reprocessing for each burst of a user's events, half an hour after the last."""
    return X.run_append(timers.bursts(X.stream_table(s, d, "events"), "user_id", 1800))


@query("stream_inactive", _bursts_sql(7_200_000))
def _(s, d):
    """A notice for each time that a user was inactive for two hours."""
    return X.run_append(timers.bursts(X.stream_table(s, d, "events"), "user_id", 7200))


#: characters of thinking that this query passes on
THINKING = 300
#: how a text, a tool call's parts and the end are sent in each format; {} stands for JSON
FRAMES = {
    "anthropic": ('event: content_block_delta\ndata: {"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":{}}}\n\n', "event: x\n", "\n\n"),
    "openai": ('data: {"model":"m","choices":[{"delta":{"content":{}}}]}\n\n', "", "\n\n"),
    "ollama": ('{"model":"m","message":{"role":"assistant","content":{}},"done":false}\n', "", "\n"),
}


def _chunks(s, d):
    """Each conversation as an answer in each format, for each other format: texts, a call with its arguments in two parts for every third, the end; cut in the middle of each frame."""
    t = D.table(s, d, "conversations").filter("text <> ''").select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.get_json_object(F.to_json(F.struct("text")), "$.text").alias("text"))
    t = t.withColumn("js", F.regexp_extract(F.to_json(F.struct("text")), r"(?s)^\{\"text\":(.*)\}$", 1))
    one = t.groupBy("conv_id").agg(F.count("*").cast("string").alias("turns"))
    cut = F.col("conv_id") % 2 == 1
    tool = F.col("conv_id") % 3 == 0
    c = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    rows = []
    for src, (text, _, _) in FRAMES.items():
        head, tail = text.split("{}", 1) if src != "anthropic" else text.split('"text":{}', 1)
        head = head + ('"text":' if src == "anthropic" else "")
        rows.append(t.select("conv_id", F.lit(src).alias("src"), (F.col("turn") + 1_000_000).alias("at"), c(head, F.col("js"), tail).alias("frame")))
        if src == "ollama":
            rows.append(t.select("conv_id", F.lit(src).alias("src"), F.col("turn").alias("at"), c('{"model":"m","message":{"thinking":', F.col("js"), '},"done":false}\n').alias("frame")))
            call = c('{"model":"m","message":{"tool_calls":[{"function":{"name":"look","arguments":{"turns":', F.col("turns"), "}}}]}}\n")
            end = c('{"model":"m","done":true,"done_reason":"', F.when(cut, "length").otherwise("stop"), '","prompt_eval_count":3,"eval_count":', F.col("turns"), "}\n")
            calls = [call]
        elif src == "openai":
            piece = lambda args, more="": c('data: {"choices":[{"delta":{"tool_calls":[{"index":0,' + more + '"function":{' + ('"name":"look",' if more else "") + '"arguments":"', args, '"}}]}}]}\n\n')
            calls = [piece('{\\"turns\\":', '"id":"c1",'), piece(c(F.col("turns"), "}"))]
            end = c('data: {"choices":[{"delta":{},"finish_reason":"', F.when(cut, "length").otherwise("stop"), '"}],"usage":{"prompt_tokens":3,"completion_tokens":', F.col("turns"), "}}\n\ndata: [DONE]\n\n")
        else:
            piece = lambda args: c('data: {"type":"content_block_delta","index":1,"delta":{"type":"input_json_delta","partial_json":"', args, '"}}\n\n')
            calls = [c('data: {"type":"content_block_start","index":1,"content_block":{"type":"tool_use","id":"c1","name":"look"}}\n\n', piece('{\\"turns\\":')), piece(c(F.col("turns"), "}"))]
            end = c('data: {"type":"message_delta","delta":{"stop_reason":"', F.when(cut, "max_tokens").otherwise("end_turn"), '"},"usage":{"output_tokens":', F.col("turns"), '}}\n\ndata: {"type":"message_stop"}\n\n')
            rows.append(one.select("conv_id", F.lit(src).alias("src"), F.lit(-1).cast("long").alias("at"), F.lit('event: message_start\ndata: {"type":"message_start","message":{"model":"m","usage":{"input_tokens":3}}}\n\n').alias("frame")))
        rows += [one.filter(tool).select("conv_id", F.lit(src).alias("src"), F.lit(2_000_000 + i).cast("long").alias("at"), x.alias("frame")) for i, x in enumerate(calls)]
        rows.append(one.select("conv_id", F.lit(src).alias("src"), F.lit(3_000_000).cast("long").alias("at"), end.alias("frame")))
    frames = rows[0]
    for r in rows[1:]:
        frames = frames.unionByName(r)
    half = F.floor(F.length("frame") / 2).cast("int")
    w = W.partitionBy("src", "conv_id").orderBy("at")
    head, tail = F.substring("frame", 1, 1 << 30).substr(F.lit(1), half), F.col("frame").substr(half + 1, F.length("frame"))
    frames = frames.withColumn("chunk", F.concat(F.coalesce(F.lag(tail).over(w), F.lit("")), head, F.when(F.col("at") == 3_000_000, tail).otherwise("")))
    dst = F.explode(F.array_remove(F.array(*map(F.lit, wire.FORMATS)), F.col("src")))
    frames = frames.select("src", dst.alias("dst"), F.col("conv_id").cast("string").alias("stream_id"), F.col("at").alias("seq"), "chunk")
    return frames.select(F.concat_ws(">", "src", "dst", "stream_id").alias("key"), "*")


@query(
    "stream_translate_wire",
    f"""WITH f(fmt) AS (VALUES ('anthropic'), ('openai'), ('ollama')),
t AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, count(*) AS turns FROM conversations WHERE text <> '' GROUP BY conv_id)
SELECT a.fmt AS src, b.fmt AS dst, conv_id::VARCHAR AS stream_id, md5(text) AS text,
       CASE WHEN a.fmt = 'ollama' AND b.fmt = 'anthropic' THEN substr(text, 1, {THINKING}) ELSE '' END AS thinking,
       CASE WHEN conv_id % 3 = 0 THEN '{{"turns":' || turns || '}}' ELSE '' END AS arguments,
       CASE WHEN conv_id % 2 = 1 THEN CASE b.fmt WHEN 'anthropic' THEN 'max_tokens' ELSE 'length' END ELSE CASE b.fmt WHEN 'anthropic' THEN 'end_turn' ELSE 'stop' END END AS reason,
       CASE WHEN b.fmt = 'openai' THEN NULL ELSE turns END::INTEGER AS produced,
       CASE WHEN b.fmt <> 'anthropic' THEN 0 ELSE 1 + CASE WHEN a.fmt = 'ollama' THEN 1 ELSE 0 END + CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END END::BIGINT AS blocks
FROM t, f a, f b WHERE a.fmt <> b.fmt""",
)
def _(s, d):
    """What the translated frames say, put together: texts, thinking, arguments, end reason, figures, opened blocks."""
    base = f"{own_dir(s)}/wire-{uuid.uuid4().hex}"
    chunks = _chunks(s, d)
    chunks.write.parquet(base)
    got = X.run_append(wire.translated(s.readStream.schema(chunks.schema).parquet(base), THINKING))
    js = F.when(F.col("dst") == "ollama", F.col("frame")).otherwise(F.regexp_replace("frame", "^(?:event: [a-z_]+\n)?data: ", ""))
    g = got.withColumn("js", js)
    get = lambda *paths: F.coalesce(*(F.get_json_object("js", p) for p in paths))
    g = g.select(
        "src", "dst", "stream_id", "n", F.when(F.col("dst") == "ollama", get("$.message.content")).otherwise(get("$.delta.text", "$.choices[0].delta.content")).alias("text"), get("$.delta.thinking").alias("thinking"),
        get("$.delta.partial_json", "$.choices[0].delta.tool_calls[0].function.arguments", "$.message.tool_calls[0].function.arguments").alias("arguments"),
        get("$.delta.stop_reason", "$.choices[0].finish_reason", "$.done_reason").alias("reason"), get("$.usage.output_tokens", "$.eval_count").cast("int").alias("produced"),
        (get("$.type") == "content_block_start").cast("long").alias("block"),
    )
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("n", c)))), lambda x: x[c]), "")
    return g.groupBy("src", "dst", "stream_id").agg(
        F.md5(joined("text")).alias("text"), joined("thinking").alias("thinking"), joined("arguments").alias("arguments"), F.max("reason").alias("reason"), F.max("produced").alias("produced"), F.coalesce(F.sum("block"), F.lit(0)).alias("blocks"),
    )
