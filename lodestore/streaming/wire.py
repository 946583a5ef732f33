"""Translation of model answers while they stream, between three wire formats, with tool calls.

A stream's chunks are cut anywhere. Whole frames are decoded into events (start, text, thinking,
tool call, arguments, figures, end), and an encoder writes them in the other format. What must
outlive a chunk is a small JSON state: the unfinished frame, the open content block, the
arguments of tool calls that wait for their turn, and how much thinking was passed on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame

from lodestore.streaming.streams import folded

FORMATS = ("anthropic", "openai", "ollama")
#: fixed value: characters of thinking that are passed on
MAX_THINKING = 256 * 1024
#: fixed values: end reasons of two formats; the third knows length and stop
REASONS = {"stop": "end_turn", "length": "max_tokens", "tool_calls": "tool_use", "content_filter": "end_turn"}
FINISH = {"end_turn": "stop", "max_tokens": "length", "tool_use": "tool_calls", "stop_sequence": "stop"}

Event = tuple[str, Any]


def _json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def whole_frames(state: dict, chunk: str, src: str) -> Iterator[dict | None]:
    """The frames that a chunk completes, parsed; None for the mark of the end. What can't be parsed is passed over."""
    text = state["rest"] + chunk
    *whole, state["rest"] = text.split("\n") if src == "ollama" else text.replace("\r\n", "\n").split("\n\n")
    for frame in whole:
        data = frame if src == "ollama" else "\n".join(x[5:].lstrip(" ") for x in frame.split("\n") if x.startswith("data:"))
        if data.strip() == "[DONE]":
            yield None
        elif data.strip():
            try:
                found = json.loads(data)
            except ValueError:
                continue
            if isinstance(found, dict):
                yield found


def _anthropic(d: dict | None) -> Iterator[Event]:
    kind, delta = (d or {}).get("type"), (d or {}).get("delta") or {}
    if kind == "message_start":
        m = d.get("message") or {}
        yield "start", (m.get("model"), (m.get("usage") or {}).get("input_tokens"))
    elif kind == "content_block_start" and (d.get("content_block") or {}).get("type") == "tool_use":
        yield "tool", (d.get("index", 0), d["content_block"].get("id"), d["content_block"].get("name"))
    elif kind == "content_block_delta":
        if delta.get("text"):
            yield "text", delta["text"]
        if delta.get("partial_json"):
            yield "arguments", (d.get("index", 0), delta["partial_json"])
    elif kind == "message_delta":
        yield "figures", (delta.get("stop_reason"), None, (d.get("usage") or {}).get("output_tokens"))
    elif kind == "message_stop":
        yield "end", None


def _openai(d: dict | None) -> Iterator[Event]:
    if d is None:
        yield "end", None
        return
    usage = d.get("usage") or {}
    yield "start", (d.get("model"), usage.get("prompt_tokens"))
    choice = (d.get("choices") or [{}])[0] or {}
    delta = choice.get("delta") or {}
    if delta.get("content"):
        yield "text", delta["content"]
    for call in delta.get("tool_calls") or []:
        f = call.get("function") or {}
        if f.get("name"):
            yield "tool", (call.get("index", 0), call.get("id"), f["name"])
        if f.get("arguments"):
            yield "arguments", (call.get("index", 0), f["arguments"])
    if choice.get("finish_reason") or usage:
        yield "figures", (REASONS.get(choice.get("finish_reason") or ""), usage.get("prompt_tokens"), usage.get("completion_tokens"))


def _ollama(d: dict | None) -> Iterator[Event]:
    d = d or {}
    m = d.get("message") or {}
    yield "start", (d.get("model"), d.get("prompt_eval_count"))
    if isinstance(m.get("thinking"), str) and m["thinking"]:
        yield "thinking", m["thinking"]
    if isinstance(m.get("content"), str) and m["content"]:
        yield "text", m["content"]
    for i, call in enumerate(m.get("tool_calls") or []):
        f = call.get("function") or {}
        yield "tool", (None, f"call_{i}", f.get("name"))  # each is a call of its own
        yield "arguments", (None, _json(f.get("arguments") or {}))
    if d.get("done"):
        yield "figures", ("max_tokens" if d.get("done_reason") == "length" else None, d.get("prompt_eval_count"), d.get("eval_count"))
        yield "end", None


DECODERS = {"anthropic": _anthropic, "openai": _openai, "ollama": _ollama}


class _Encoder:
    """Writes events in a format; what it has to remember is in ``s``."""

    def __init__(self, s: dict, stream_id: str, max_thinking: int):
        self.s, self.id, self.max_thinking, self.out = s, stream_id, max_thinking, []

    def event(self, kind: str, v: Any) -> None:
        s = self.s
        if s["ended"]:
            return
        if kind == "start":
            s["model"] = v[0] or s["model"]
            s["in"] = v[1] or s["in"]
            if not s["started"]:
                s["started"] = True
                self.start()
        elif kind == "figures":
            s["reason"], s["in"], s["produced"] = v[0] or s["reason"], v[1] or s["in"], v[2] or s["produced"]
        elif kind == "end":
            s["ended"] = True
            self.end()
        elif kind == "tool":
            at = len(s["tools"])
            s["tools"].append({"key": v[0], "id": v[1], "name": v[2], "args": ""})
            self.tool(at)
        elif kind == "arguments":
            at = max((i for i, t in enumerate(s["tools"]) if t["key"] == v[0]), default=None)
            if at is not None:
                self.arguments(at, v[1])
        else:
            getattr(self, kind)(v)

    def start(self) -> None: ...
    def text(self, t: str) -> None: ...
    def thinking(self, t: str) -> None: ...
    def tool(self, at: int) -> None: ...

    def arguments(self, at: int, part: str) -> None:
        self.s["tools"][at]["args"] += part

    def end(self) -> None: ...


class _ToAnthropic(_Encoder):
    def send(self, kind: str, **more: Any) -> None:
        self.out.append(f"event: {kind}\ndata: {_json({'type': kind} | more)}\n\n")

    def start(self) -> None:
        usage = {"input_tokens": self.s["in"], "output_tokens": 0}
        self.send("message_start", message={"id": f"msg_{self.id}", "type": "message", "role": "assistant", "model": self.s["model"], "content": [], "stop_reason": None, "stop_sequence": None, "usage": usage})

    def block(self, kind: str, tool: int | None = None, **content: Any) -> None:
        """Open a block of this kind, after closing another one."""
        s = self.s
        if s["block"] == [kind, tool]:
            return
        self.close()
        s["block"], s["index"] = [kind, tool], s["index"] + 1
        self.send("content_block_start", index=s["index"], content_block={"type": kind} | content)

    def close(self) -> None:
        if self.s["block"]:
            self.send("content_block_stop", index=self.s["index"])
            self.s["block"] = None

    def delta(self, **delta: Any) -> None:
        self.send("content_block_delta", index=self.s["index"], delta=delta)

    def text(self, t: str) -> None:
        self.waiting()
        self.block("text", text="")
        self.delta(type="text_delta", text=t)

    def thinking(self, t: str) -> None:
        t = t[: self.max_thinking - self.s["thought"]]
        if t:
            self.s["thought"] += len(t)
            self.waiting()
            self.block("thinking", thinking="")
            self.delta(type="thinking_delta", thinking=t)

    def tool(self, at: int) -> None:
        if not (self.s["block"] and self.s["block"][0] == "tool_use"):  # else it waits until the open call has ended
            self.open_tool(at)

    def open_tool(self, at: int) -> None:
        t = self.s["tools"][at]
        self.block("tool_use", at, id=t["id"], name=t["name"], input={})
        if t["args"]:
            self.delta(type="input_json_delta", partial_json=t["args"])
            t["args"] = ""
        t["sent"] = True

    def arguments(self, at: int, part: str) -> None:
        if self.s["block"] == ["tool_use", at]:
            self.delta(type="input_json_delta", partial_json=part)
        else:
            super().arguments(at, part)

    def waiting(self) -> None:
        """Calls that came while another was open follow it, each with all its arguments."""
        for at, t in enumerate(self.s["tools"]):
            if not t.get("sent"):
                self.open_tool(at)

    def end(self) -> None:
        self.waiting()
        if self.s["index"] < 0:
            self.block("text", text="")  # a message has a block
        self.close()
        self.send("message_delta", delta={"stop_reason": self.s["reason"] or "end_turn", "stop_sequence": None}, usage={"output_tokens": self.s["produced"]})
        self.send("message_stop")


class _ToOpenai(_Encoder):
    def send(self, delta: dict, reason: str | None = None) -> None:
        frame = {"id": f"chatcmpl-{self.id}", "object": "chat.completion.chunk", "model": self.s["model"], "choices": [{"index": 0, "delta": delta, "finish_reason": reason}]}
        self.out.append(f"data: {_json(frame)}\n\n")

    def start(self) -> None:
        self.send({"role": "assistant", "content": ""})

    def text(self, t: str) -> None:
        self.send({"content": t})

    def tool(self, at: int) -> None:
        t = self.s["tools"][at]
        self.send({"tool_calls": [{"index": at, "id": t["id"], "type": "function", "function": {"name": t["name"], "arguments": ""}}]})

    def arguments(self, at: int, part: str) -> None:
        self.send({"tool_calls": [{"index": at, "function": {"arguments": part}}]})

    def end(self) -> None:
        self.send({}, FINISH.get(self.s["reason"] or "", "stop"))
        self.out.append("data: [DONE]\n\n")


class _ToOllama(_Encoder):
    def send(self, message: dict, **more: Any) -> None:
        self.out.append(_json({"model": self.s["model"], "message": {"role": "assistant", "content": ""} | message, "done": False} | more) + "\n")

    def text(self, t: str) -> None:
        self.send({"content": t})

    def end(self) -> None:
        calls = []
        for t in self.s["tools"]:  # this format has whole calls only
            try:
                args = json.loads(t["args"] or "{}")
            except ValueError:
                args = {"raw": t["args"]}
            calls.append({"function": {"name": t["name"], "arguments": args}})
        if calls:
            self.send({"tool_calls": calls})
        self.send({}, done=True, done_reason="length" if self.s["reason"] == "max_tokens" else "stop", prompt_eval_count=self.s["in"], eval_count=self.s["produced"])


ENCODERS = {"anthropic": _ToAnthropic, "openai": _ToOpenai, "ollama": _ToOllama}
START = {"rest": "", "n": 0, "started": False, "ended": False, "model": "", "in": 0, "produced": 0, "reason": None, "block": None, "index": -1, "thought": 0, "tools": []}


def translate_chunk(state: dict, chunk: str, src: str, dst: str, stream_id: str, max_thinking: int = MAX_THINKING) -> tuple[dict, list[str]]:
    """(state, frames that this chunk gives in the other format)."""
    to = ENCODERS[dst](state, stream_id, max_thinking)
    for frame in whole_frames(state, chunk, src):
        for kind, value in DECODERS[src](frame):
            to.event(kind, value)
    return state, to.out


def _step(max_thinking: int):
    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        state, made = translate_chunk(state, row["chunk"] or "", row["src"], row["dst"], str(row["stream_id"]), max_thinking)
        n, state["n"] = state["n"], state["n"] + len(made)
        return state, [{"src": row["src"], "dst": row["dst"], "stream_id": row["stream_id"], "n": n + i, "frame": f} for i, f in enumerate(made)]

    return step


def translated(chunks: DataFrame, max_thinking: int = MAX_THINKING) -> DataFrame:
    """(key, src, dst, stream_id, n, frame) of a stream of chunks (key, src, dst, stream_id, seq, chunk), each key one stream in one pair of formats, its chunks in the order of ``seq``.

    Frames come as soon as their input frame is whole; between micro-batches only the unfinished one,
    the open block and waiting arguments are kept. Null chunks are empty; a stream that breaks off
    has no end frames, and what follows its end is passed over.
    """
    return folded(chunks, "key", ["seq"], START, _step(max_thinking), "key string, src string, dst string, stream_id string, n long, frame string")
