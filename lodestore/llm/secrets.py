"""Secret scan: fixed patterns, and a token-efficiency test for other random strings.

A tokenizer trained on natural text needs few tokens for words and names but nearly one token
for each two characters of a random string. What a run of key characters leaves beside the spans
that patterns found is divided at segments that read as words; the rest is reported as ``random``
where its ratio of characters to tokens is low, unless it is a digest of a usual length, a UUID or
a number. Short strings need a lower ratio and letters of both cases or digits besides letters.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.vocab import vocabulary_path
from lodestore.session import python_path, read_table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that have 32 characters or more
KINDS = ("assign", "access", "hex", "random")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: hex digits of common digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
#: fewer characters than the first are no secret; fewer than the second need the lower ratio
SHORTEST, LONG_ENOUGH = 16, 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SEGMENT = re.compile(r"[A-Za-z0-9]+")
ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of the fixed patterns, leftmost non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


@lru_cache(2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """Digests, UUIDs and numbers: strings that look random or long but open nothing."""
    return bool(UUID.fullmatch(run)) or bool(ALL_HEX.fullmatch(run) and len(run) in DIGESTS) or not any(c.isalpha() for c in run)


def token_ratio(text: str, vocab: str | None = None) -> float:
    """Characters per token; long strings in slices."""
    encode = _encoding(vocabulary_path("byte_bpe_50k.tiktoken", vocab)).encode_ordinary
    return len(text) / sum(len(encode(text[i : i + 4096])) for i in range(0, len(text), 4096))


def _mixed(run: str) -> bool:
    """Digits besides letters, or capitals not only at the front."""
    letters = "".join(c for c in run if c.isalpha())
    return any(c.isdigit() for c in run) or not (letters.islower() or letters.isupper() or letters[1:].islower())


def random_parts(text: str, start: int, end: int, max_ratio: float, short_ratio: float, vocab: str | None = None) -> Iterator[tuple[int, int]]:
    """Spans of random strings in text[start:end], a run of key characters. Segments that read as words divide it, and beside such short ones belong to them (paths)."""

    def word(s: str) -> bool:
        return s.isalpha() and len(s) > 2 and (len(s) > 3 or s.islower()) and token_ratio(s, vocab) >= max_ratio

    groups: list[list[tuple[int, int]]] = [[]]
    for m in SEGMENT.finditer(text, start, end):
        if word(m[0]):
            groups.append([])
        else:
            groups[-1].append(m.span())
    for g in groups:
        if len(groups) > 1:
            while g and g[0][1] - g[0][0] < 8:
                g.pop(0)
            while g and g[-1][1] - g[-1][0] < 8:
                g.pop()
        if not g or g[-1][1] - g[0][0] < SHORTEST:
            continue
        a, b = g[0][0], g[-1][1]
        run = text[a:b]
        if known(run) or (b - a < LONG_ENOUGH and not _mixed(run)):
            continue
        if token_ratio(run, vocab) < (max_ratio if b - a >= LONG_ENOUGH else short_ratio):
            while b < end and text[b] == "=":
                b += 1  # padding
            yield a, b


def scan(text: str | None, max_ratio: float = 2.2, short_ratio: float = 1.9, vocab: str | None = None) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as in ``KINDS``. Null is an empty text; texts are read whole."""
    if not text:
        return []
    found = base_spans(text)
    base = sorted((a, b) for _, a, b in found)
    more = []
    for m in RUN.finditer(text):
        at, end = m.span()
        if known(m[0]):
            continue
        for a, b in [*base[bisect_left(base, (at, 0)) - 1 if base and base[0][0] < at else 0 :], (end, end)]:
            if a > at and min(a, end) - at >= SHORTEST:
                more += [("random", x, y) for x, y in random_parts(text, at, min(a, end), max_ratio, short_ratio, vocab)]
            if a >= end:
                break
            at = max(at, b)
    return sorted(found + more, key=lambda x: (x[1], KINDS.index(x[0])))


def redact(text: str | None, mark: str = "[SECRET]", max_ratio: float = 2.2, vocab: str | None = None) -> str | None:
    """The text with each secret replaced; of an assignment only the value goes."""
    if not text or not (spans := scan(text, max_ratio, vocab=vocab)):
        return text
    cut = []
    for kind, a, b in spans:
        if kind == "assign":
            a = ASSIGN.match(text, a).start(2)
        if cut and a < cut[-1][1]:
            cut[-1][1] = max(cut[-1][1], b)
        else:
            cut.append([a, b])
    out, at = [], 0
    for a, b in cut:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = 2.2, vocab: str | None = None) -> DataFrame:
    """Per row: id, spans array<struct<kind, start, end>>. Null, empty and clean texts have an empty array; row order and other columns don't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t, max_ratio, vocab=vocab)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["id", "spans"])

    python_path(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, spans array<struct<kind: string, start: int, end: int>>")


def redact_table(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars", max_ratio: float = 2.2, vocab: str | None = None) -> DataFrame:
    """The same rows and columns with secrets replaced in ``text_col`` and the length in ``count_col`` (if there) brought up to date."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([redact(t, max_ratio=max_ratio, vocab=vocab) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), text)

    python_path(docs.sparkSession)
    out = docs.mapInArrow(run, docs.schema)
    if count_col in docs.columns:
        out = out.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType)).select(docs.columns)
    return out


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``secret_spans`` over ``documents``."""
    found = secret_spans(read_table(spark, f"{sf_dir}/documents.parquet"))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = text(F.filter("spans", lambda x: x["kind"] != "random"))
    return found.select(F.col("id").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(base, 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
