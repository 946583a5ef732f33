"""Timers and translation: whatever the cuts and batches, the same; expiry by event time and by the clock."""

import datetime
import json
import random
import time

import pytest

from lodestore.session import own_dir
from lodestore.streaming import streams as X
from lodestore.streaming import timers, wire


def fresh():
    return json.loads(json.dumps(wire.START))


def sse(*frames):
    return "".join(f"data: {f if isinstance(f, str) else json.dumps(f)}\n\n" for f in frames)


def lines(*frames):
    return "".join(json.dumps(f) + "\n" for f in frames)


SOURCES = {
    "anthropic": sse(
        {"type": "message_start", "message": {"model": "m1", "usage": {"input_tokens": 11}}}, {"type": "content_block_start", "index": 0, "content_block": {"type": "text", "text": ""}},
        *({"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": t}} for t in ("Hé", "llo\n\n", "data: x")), {"type": "content_block_stop", "index": 0},
        {"type": "content_block_start", "index": 1, "content_block": {"type": "tool_use", "id": "t1", "name": "look"}}, *({"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": p}} for p in ('{"a":', "1}")),
        {"type": "message_delta", "delta": {"stop_reason": "tool_use"}, "usage": {"output_tokens": 7}}, {"type": "message_stop"},
    ),
    "openai": sse(
        *({"model": "m1", "choices": [{"delta": {"content": t}}]} for t in ("Hé", "llo\n\n", "data: x")),
        {"choices": [{"delta": {"tool_calls": [{"index": 0, "id": "t1", "function": {"name": "look", "arguments": '{"a":'}}]}}]}, {"choices": [{"delta": {"tool_calls": [{"index": 0, "function": {"arguments": "1}"}}]}}]},
        {"choices": [{"delta": {}, "finish_reason": "tool_calls"}], "usage": {"prompt_tokens": 11, "completion_tokens": 7}}, "[DONE]",
    ),
    "ollama": lines(
        {"model": "m1", "message": {"thinking": "hm "}}, {"model": "m1", "message": {"thinking": "so"}}, *({"model": "m1", "message": {"content": t}, "done": False} for t in ("Hé", "llo\n\n", "data: x")),
        {"message": {"tool_calls": [{"function": {"name": "look", "arguments": {"a": 1}}}]}}, {"done": True, "done_reason": "stop", "prompt_eval_count": 11, "eval_count": 7},
    ),
}
PAIRS = [(a, b) for a in wire.FORMATS for b in wire.FORMATS if a != b]


def run(src, dst, chunks, cap=wire.MAX_THINKING):
    state, out = fresh(), []
    for c in chunks:
        state = json.loads(json.dumps(state))  # as between micro-batches
        state, made = wire.translate_chunk(state, c, src, dst, "s", cap)
        out += made
    return out


def cuts(text, rng):
    at = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(1, 30)))
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)]


@pytest.mark.parametrize(("src", "dst"), PAIRS)
def test_cuts_change_nothing(src, dst):
    rng, whole = random.Random(1), run(src, dst, [SOURCES[src]])
    for _ in range(60):
        assert run(src, dst, cuts(SOURCES[src], rng)) == whole
    # and back: what the translation says is what the source says
    back = run(dst, src, ["".join(whole)])
    events = lambda s, fs: [(k, v) for f in wire.whole_frames({"rest": ""}, "".join(fs), s) for k, v in wire.DECODERS[s](f) if k in ("text", "arguments")]
    said = lambda s, fs, kind: "".join(v if kind == "text" else v[1] for k, v in events(s, fs) if k == kind)
    for kind, want in (("text", "Héllo\n\ndata: x"), ("arguments", '{"a":1}')):
        assert said(dst, whole, kind) == said(src, back, kind) == want


def parsed(frames):
    return [json.loads(f.split("data: ", 1)[1]) for f in frames]


def test_blocks_open_and_close_in_turn():
    out = parsed(run("ollama", "anthropic", [SOURCES["ollama"]]))
    kinds = [(d["type"], d.get("index"), (d.get("content_block") or {}).get("type")) for d in out if d["type"] != "content_block_delta"]
    assert kinds == [
        ("message_start", None, None), ("content_block_start", 0, "thinking"), ("content_block_stop", 0, None), ("content_block_start", 1, "text"), ("content_block_stop", 1, None),
        ("content_block_start", 2, "tool_use"), ("content_block_stop", 2, None), ("message_delta", None, None), ("message_stop", None, None),
    ]
    assert out[-2]["usage"] == {"output_tokens": 7}
    empty = [d["type"] for d in parsed(run("ollama", "anthropic", [lines({"done": True})]))]
    assert empty == ["message_start", "content_block_start", "content_block_stop", "message_delta", "message_stop"]


def test_thinking_is_capped():
    source = lines(*({"message": {"thinking": "x" * 100_000}} for _ in range(4)), {"message": {"content": "y"}}, {"done": True})
    out = parsed(run("ollama", "anthropic", [source]))
    assert sum(len(d["delta"]["thinking"]) for d in out if d.get("delta", {}).get("type") == "thinking_delta") == 256 * 1024


def test_parallel_calls_follow_one_another():
    call = lambda i, **f: {"choices": [{"delta": {"tool_calls": [{"index": i, "id": f"c{i}", "function": f}]}}]}
    source = sse(call(0, name="a", arguments="[1"), call(1, name="b", arguments="[2"), call(0, arguments="]"), call(1, arguments="]"), "[DONE]")
    out = parsed(run("openai", "anthropic", [source]))
    blocks = {}
    for d in out:
        if d["type"] == "content_block_delta":
            blocks[d["index"]] = blocks.get(d["index"], "") + d["delta"]["partial_json"]
    assert blocks == {0: "[1]", 1: "[2]"}


def test_broken_frames_are_passed_over():
    assert "".join(run("openai", "ollama", ["data: {oops\n\n: comment\n\ndata: 3\n\n" + SOURCES["openai"], "data: {}\n\n"])) == "".join(run("openai", "ollama", [SOURCES["openai"]]))


EVENT = "user_id long, ts timestamp, k int"


def at(*seconds):
    return [datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s) for s in seconds]


def feed(spark, folder, batches, make):
    """The rows of a stream that goes on from its checkpoint for each batch."""
    for rows in batches:
        spark.createDataFrame(rows, EVENT).write.mode("append").parquet(f"{folder}/in")
        stream = make(spark.readStream.schema(EVENT).parquet(f"{folder}/in"))
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def test_bursts_end_by_event_time(spark):
    folder = f"{own_dir(spark)}/bursts-{random.randrange(1 << 40)}"
    t = at(0, 50, 100, 1000, 1010, 40, 5000, 90_000)
    batches = [
        [(1, t[0], 0), (1, t[1], 0), (2, t[1], 0), (None, t[0], 0), (1, None, 0)],
        [(1, t[2], 0), (1, t[4], 0), (1, t[3], 0), (2, t[5], 0)],  # out of order, within the watermark
        [(3, t[6], 0)], [(4, t[7], 0)],
    ]
    got = feed(spark, folder, batches, lambda e: timers.bursts(e, "user_id", 60, "1 hour"))
    zero = int(at(0)[0].replace(tzinfo=datetime.UTC).timestamp() * 1000)
    found = sorted(((r.user_id, (r.first_ms - zero) // 1000, (r.last_ms - zero) // 1000, r.n) for r in got.collect()), key=str)
    assert found == sorted([(1, 0, 100, 3), (1, 1000, 1010, 2), (2, 40, 50, 2), (None, 0, 0, 1), (3, 5000, 5000, 1)], key=str)


def test_bursts_end_by_the_clock(spark):
    """No later event is needed: the query, which runs on, emits once the quiet period is over."""
    folder = f"{own_dir(spark)}/clock-{random.randrange(1 << 40)}"
    spark.createDataFrame([(1, at(0)[0], 0), (1, at(1)[0], 0)], EVENT).write.parquet(f"{folder}/in")
    out = timers.bursts(spark.readStream.schema(EVENT).parquet(f"{folder}/in"), "user_id", 1.5, by_clock=True)
    running = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(processingTime="1 second").start()
    try:
        found, until = [], time.monotonic() + 90
        while not found and time.monotonic() < until:
            time.sleep(1)
            found = spark.read.schema(out.schema).parquet(f"{folder}/out").collect() if running.lastProgress else []
    finally:
        running.stop()
    assert [(r.user_id, r.n) for r in found] == [(1, 2)]


def test_translation_goes_on_between_batches(spark):
    folder, rng = f"{own_dir(spark)}/wire-{random.randrange(1 << 40)}", random.Random(2)
    schema = "key string, src string, dst string, stream_id string, seq long, chunk string"
    parts = {(a, b): cuts(SOURCES[a], rng) for a, b in PAIRS}
    for batch in range(3):
        rows = [(f"{a}>{b}", a, b, "s", i, c) for (a, b), cs in parts.items() for i, c in enumerate(cs) if i * 3 // len(cs) == batch]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/in")
        out = wire.translated(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in spark.read.schema(out.schema).parquet(f"{folder}/out").orderBy("n").collect():
        got.setdefault((r.src, r.dst), []).append(r.frame)
    assert got == {p: run(*p, [SOURCES[p[0]]]) for p in PAIRS}
    assert X.ROCKSDB
