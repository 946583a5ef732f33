"""Stream translation between three event formats, frame by frame, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("anthropic", "openai", "ollama")
#: end reasons: of each format, in one order
ENDS = {"anthropic": ("end_turn", "max_tokens", "tool_use"), "openai": ("stop", "length", "tool_calls"), "ollama": ("stop", "length", "tool_calls")}


def _end(reason: Column, src: str, dst: str) -> Column:
    table = F.create_map(*(F.lit(x) for a, b in dict(zip(ENDS[src], ENDS[dst], strict=True)).items() for x in (a, b)))
    return F.when(reason.isNotNull(), F.coalesce(F.element_at(table, reason), F.lit(ENDS[dst][0])))


def common(frames: DataFrame, src: str) -> DataFrame:
    """(stream_id, n, text, reason, tokens_in, tokens_out) of frames (stream_id, n, data)."""
    g = lambda p: F.get_json_object("data", p)
    text = {"anthropic": g("$.delta.text"), "openai": g("$.choices[0].delta.content"), "ollama": g("$.message.content")}[src]
    reason = {"anthropic": g("$.delta.stop_reason"), "openai": g("$.choices[0].finish_reason"), "ollama": g("$.done_reason")}[src]
    tokens = {"anthropic": ("$.usage.input_tokens", "$.usage.output_tokens"), "openai": ("$.usage.prompt_tokens", "$.usage.completion_tokens"), "ollama": ("$.prompt_eval_count", "$.eval_count")}[src]
    return frames.select("stream_id", "n", text.alias("text"), reason.alias("reason"), g(tokens[0]).cast("int").alias("tokens_in"), g(tokens[1]).cast("int").alias("tokens_out"))


def translate(frames: DataFrame, src: str, dst: str) -> DataFrame:
    """(stream_id, n, part, data): frames in another format. Parts order the frames that one gives; start and stop frames are added at a stream's ends."""
    if src == dst:
        return frames.select("stream_id", "n", F.lit(0).alias("part"), "data")
    c = common(frames, src).filter("text IS NOT NULL OR reason IS NOT NULL")
    js = lambda *cols: F.to_json(F.struct(*cols))
    lit = lambda v, k: F.lit(v).alias(k)
    reason = _end(F.col("reason"), src, dst)
    if dst == "anthropic":
        body = F.when(F.col("text").isNotNull(), js(lit("content_block_delta", "type"), lit(0, "index"), F.struct(lit("text_delta", "type"), F.col("text")).alias("delta")))
        stop = F.when(reason.isNotNull(), js(lit("message_delta", "type"), F.struct(reason.alias("stop_reason")).alias("delta"), F.struct(F.col("tokens_out").alias("output_tokens")).alias("usage")))
        head, foot = [js(lit("message_start", "type")), js(lit("content_block_start", "type"), lit(0, "index"))], [js(lit("content_block_stop", "type"), lit(0, "index")), js(lit("message_stop", "type"))]
    elif dst == "openai":
        body = F.when(F.col("text").isNotNull(), js(lit("chat.completion.chunk", "object"), F.array(F.struct(lit(0, "index"), F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
        stop = F.when(reason.isNotNull(), js(lit("chat.completion.chunk", "object"), F.array(F.struct(lit(0, "index"), reason.alias("finish_reason"))).alias("choices")))
        head, foot = [js(lit("chat.completion.chunk", "object"), F.array(F.struct(lit(0, "index"), F.struct(lit("assistant", "role")).alias("delta"))).alias("choices"))], [F.lit("[DONE]")]
    else:
        body = F.when(F.col("text").isNotNull(), js(F.struct(lit("assistant", "role"), F.col("text").alias("content")).alias("message"), lit(False, "done")))
        stop = F.when(reason.isNotNull(), js(lit(True, "done"), reason.alias("done_reason"), F.col("tokens_in").alias("prompt_eval_count"), F.col("tokens_out").alias("eval_count")))
        head, foot = [], []
    inner = c.select("stream_id", "n", F.posexplode(F.array_compact(F.array(body, stop))).alias("part", "data"))
    ends = c.groupBy("stream_id").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    outer = ends.select("stream_id", F.inline(F.array(*(F.struct(F.col("a").alias("n"), F.lit(i - len(head)).alias("part"), h.alias("data")) for i, h in enumerate(head)), *(F.struct(F.col("b").alias("n"), F.lit(10 + i).alias("part"), h.alias("data")) for i, h in enumerate(foot))))) if head or foot else None
    return inner if outer is None else inner.unionByName(outer)


def usage(frames: DataFrame, src: str) -> DataFrame:
    """(stream_id, tokens_in, tokens_out): the last figures that a stream gives."""
    c = common(frames, src)
    last = lambda col: F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col("n"))).alias(col)
    return c.groupBy("stream_id").agg(last("tokens_in"), last("tokens_out"))
