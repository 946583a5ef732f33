"""Text compression by learnt pair merges: pair counts, training, lossless coding.

Tokens are words, numbers or single characters. Training counts pairs over the whole table and
then works on what can still be merged, many merges a round; only the best pairs of each step come
to the driver, and the merge table that results is a short list.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.functions.text import blank
from lodestore.session import discard, materialize, python_path

TOKEN = r"[a-zA-Z]+(?:'[a-zA-Z]+)*|\d+(?:\.\d+)?|\S"
_TOKEN = re.compile(TOKEN, re.ASCII)
LEFT, RIGHT = "«", "»"


def gapped(text: Column) -> Column:
    """Tokens, each with the white space before it: a run of characters that no pair may cross starts with another gap than one space."""
    return F.regexp_extract_all(blank(text), F.lit(rf"(\s*)({TOKEN})"), F.lit(0))


def pair_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b, n): adjacent tokens with exactly one space between."""
    t = texts.select(gapped(F.col(text_col)).alias("g")).filter(F.size("g") > 1)
    pairs = F.zip_with(F.slice("g", 1, F.size("g") - 1), F.slice("g", 2, F.size("g") - 1), lambda x, y: F.struct(F.regexp_replace(x, r"^\s+", "").alias("a"), y.alias("y")))
    p = t.select(F.explode(pairs).alias("p")).select("p.a", "p.y").filter(r"y rlike '^ \\S'")
    return p.select("a", F.substr("y", F.lit(2)).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


#: meetings of two tokens are counted by so many hash values
SLOTS = 1 << 20
#: merges that a round tries to foresee
AHEAD = 48
_GAPPED = re.compile(rf"(\s*)({TOKEN})", re.ASCII)


class _Slots:
    """Hash values of neighbouring tokens, the same in every task. Tokens' own hashes are kept, up to a number of them."""

    def __init__(self, slots: int, most: int = 1 << 18):
        self.slots, self.most = slots, most
        self.known: dict[str, int] = {}

    def _hash(self, token: str) -> int:
        if len(self.known) >= self.most:
            self.known.clear()
        h = self.known[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return h

    def of(self, toks: Sequence[str]) -> np.ndarray:
        """Of each token and the next."""
        known = self.known
        h = np.fromiter((known.get(t) or self._hash(t) for t in toks), np.uint64, len(toks))
        return ((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(24)) % np.uint64(self.slots)


def _joined(text: str | None, slots: _Slots) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens; whether there is just one space between each and the next; and the hash value of both."""
    found = _GAPPED.findall(text or "")
    toks = [t for _, t in found]
    if len(toks) < 2:
        return toks, np.zeros(0, bool), np.zeros(0, np.int64)
    return toks, np.fromiter((g == " " for g, _ in found[1:]), bool, len(toks) - 1), slots.of(toks).astype(np.int64)


def slot_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(slot, n): how often tokens with one space between meet, by the hash value of both: no less than the count of any pair that has it."""
    slots = SLOTS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, hashes = np.zeros(slots, np.int64), _Slots(slots)
        for pdf in batches:
            for text in pdf["text"]:
                _, one, slot = _joined(text, hashes)
                np.add.at(n, slot[one], 1)
        at = np.flatnonzero(n)
        if len(at):
            yield pd.DataFrame({"slot": at, "n": n[at]})

    python_path(texts.sparkSession)
    return texts.select(F.col(text_col).cast("string").alias("text")).mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def _slots_with(counts: DataFrame, least: int) -> np.ndarray:
    """Bits, lowest first, of the slots that count ``least`` or more; they come to the driver as bitmaps, an eighth of ``SLOTS`` bytes at most."""
    s = counts.filter(F.col("n") >= least).select((F.col("slot") + 1).alias("s"))
    parts = s.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect()
    size = 4096  # bytes of one bitmap
    out = np.zeros(max(SLOTS // 8, size), np.uint8)
    for r in parts:
        out[(r.b - 1) * size : r.b * size] = np.frombuffer(r.m, np.uint8)
    return out


def _pieces(texts: DataFrame, text_col: str, counts: DataFrame, least: int) -> DataFrame:
    """(toks, n): the runs of tokens with one space between, divided where the two tokens surely meet less than ``least`` times; equal ones are counted together."""
    slots, kept = SLOTS, _slots_with(counts, least)

    def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, hashes = np.unpackbits(kept, bitorder="little").view(bool), _Slots(slots)
        for pdf in batches:
            found: dict[tuple[str, ...], int] = {}
            for text in pdf["text"]:
                toks, one, slot = _joined(text, hashes)
                stays = np.flatnonzero(one & hot[slot])
                if len(stays):
                    first = np.concatenate(([True], np.diff(stays) > 1))
                    starts = stays[first]
                    ends = stays[np.append(np.flatnonzero(first)[1:] - 1, len(stays) - 1)] + 2
                    for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
                        piece = tuple(toks[i:j])
                        found[piece] = found.get(piece, 0) + 1
            if found:
                yield pd.DataFrame({"toks": [list(k) for k in found], "n": list(found.values())})

    t = texts.select(F.col(text_col).cast("string").alias("text"))
    return t.mapInPandas(divide, "toks array<string>, n long").groupBy("toks").agg(F.sum("n").alias("n"))


def _merge(toks: tuple[str, ...], a: str, b: str) -> tuple[str, ...]:
    out, i, n = [], 0, len(toks)
    while i < n:
        if i + 1 < n and toks[i] == a and toks[i + 1] == b:
            out.append(a + " " + b)
            i += 2
        else:
            out.append(toks[i])
            i += 1
    return tuple(out)


def foreseen_counts(pieces: Iterator[tuple[tuple[str, ...], int]], ahead: Sequence[tuple[str, str]]) -> dict[tuple[int, str, str], int]:
    """(step, a, b) -> what is added to the pair's count by the step: at 0 the counts of the pieces, at i the change that merging the i-th pair brings.

    An index from pairs to pieces finds those that a merge changes; only they are counted anew.
    """
    now, sizes = [], []
    where: dict[tuple[str, str], set[int]] = {}
    adds: dict[tuple[int, str, str], int] = {}
    for i, (toks, n) in enumerate(pieces):
        now.append(toks)
        sizes.append(n)
        for p in pairwise(toks):
            where.setdefault(p, set()).add(i)
            adds[0, *p] = adds.get((0, *p), 0) + n
    for step, (a, b) in enumerate(ahead, 1):
        for i in sorted(where.pop((a, b), ())):
            after = _merge(now[i], a, b)
            for p in pairwise(now[i]):
                adds[step, *p] = adds.get((step, *p), 0) - sizes[i]
            for p in pairwise(after):
                adds[step, *p] = adds.get((step, *p), 0) + sizes[i]
                where.setdefault(p, set()).add(i)
            now[i] = after
    return {k: v for k, v in adds.items() if v}


def train(texts: DataFrame, text_col: str = "text", merges: int = 512, min_count: int = 2, ahead: int = AHEAD) -> list[tuple[str, str]]:
    """Ordered merges: each the most frequent pair of the tokens so far (the smallest on ties), which becomes one token.

    The list is the same as by counting all pairs anew for each merge. Counts only fall, so where two
    tokens meet less often than the last merge nothing is ever merged: runs are divided there, by
    hash values' counts that are never too low, and what is left are short pieces, counted by kind. A round foresees many merges, applies them one
    after another to the pieces and counts what each changes; the counts tell up to where the
    foresight was right, and the first merge that it missed.
    """
    counts = materialize(slot_counts(texts, text_col), "slots")
    joined: list[tuple[str, str]] = []
    least = max(min_count, counts.orderBy(F.desc("n")).limit(2 * merges).agg(F.min("n")).first()[0] or 0)
    while len(joined) < merges:
        pieces, done = materialize(_pieces(texts, text_col, counts, least), "pieces"), 0
        guess: list[tuple[str, str]] = []
        while len(joined) < merges:
            if len(joined) - done > 4 * ahead:  # pieces that are one token by now need not be read again
                pieces, done, old = materialize(_merged(pieces, joined[done:]), "pieces"), len(joined), pieces
                discard(old)
            steps, top = _round(pieces, joined[done:], guess, ahead)
            before = len(joined)
            for i, (n, a, b) in enumerate(steps):
                if n < least or len(joined) == merges:
                    break
                joined.append((a, b))
                if i >= len(guess) or guess[i] != (a, b):
                    break  # the first that wasn't foreseen; what follows it is not counted yet
            if len(joined) == before:
                break
            guess = [p for p in top if p != joined[-1]]
        discard(pieces)
        if least <= min_count:
            break
        least = max(min_count, least // 4)  # fewer runs are divided, and what is merged already is merged in them too
    discard(counts)
    return joined[:merges]


def _merged(pieces: DataFrame, merges: Sequence[tuple[str, str]]) -> DataFrame:
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            toks = [list(reduce(lambda t, p: _merge(t, *p), merges, tuple(t))) for t in pdf["toks"]]
            if toks:
                yield pd.DataFrame({"toks": toks, "n": pdf["n"]})

    return pieces.mapInPandas(apply, "toks array<string>, n long").filter(F.size("toks") > 1).groupBy("toks").agg(F.sum("n").alias("n"))


def _round(pieces: DataFrame, merges: Sequence[tuple[str, str]], guess: Sequence[tuple[str, str]], ahead: int) -> tuple[list[tuple[int, str, str]], list[tuple[str, str]]]:
    """The best pair (count, a, b) after each step as far as they are known for sure, and the best pairs after the last step that the guess had right."""
    merges, guess = tuple(merges), tuple(guess)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = ((reduce(lambda t, p: _merge(t, *p), merges, tuple(t)), int(n)) for t, n in zip(pdf["toks"], pdf["n"], strict=True))
            adds = foreseen_counts(rows, guess)
            if adds:
                yield pd.DataFrame([(*k, v) for k, v in adds.items()], columns=["step", "a", "b", "add"])

    adds = pieces.mapInPandas(count, "step int, a string, b string, add long").groupBy("step", "a", "b").agg(F.sum("add").alias("add"))
    # the count of a pair after each step that changed it, and before which step it holds
    w = W.partitionBy("a", "b").orderBy("step")
    held = adds.withColumn("n", F.sum("add").over(w)).withColumn("until", F.coalesce(F.lead("step").over(w), F.lit(len(guess) + 1))).filter("n > 0")
    held = materialize(held.select("step", "until", "a", "b", "n"), "counts")
    high = held.filter("step = 0").orderBy(F.desc("n")).limit(2 * ahead).agg(F.min("n")).first()[0]
    if high is None:
        discard(held)
        return [], []
    # counts only fall: where no pair has so many, no later step has one either, and the steps that are known end
    at = held.filter(F.col("n") >= high).select(F.explode(F.sequence("step", F.col("until") - 1)).alias("at"), "a", "b", "n")
    best = at.groupBy("at").agg(F.min(F.struct(-F.col("n"), "a", "b")).alias("x")).select("at", "x.*").orderBy("at").collect()  # a row for each step
    steps = [(-r[1], r.a, r.b) for r in best]
    right = 0
    while right < min(len(guess), len(steps)) and steps[right][1:] == guess[right]:
        right += 1
    top = held.filter((F.col("step") <= right) & (F.col("until") > right)).orderBy(F.desc("n"), "a", "b").limit(ahead + 1).collect()
    discard(held)
    return steps, [(r.a, r.b) for r in top]


def _split(gaps: list[str]) -> tuple[list[str], list[str]]:
    toks = [g.lstrip() for g in gaps]
    return toks, [g[: len(g) - len(t)] for g, t in zip(gaps, toks, strict=True)]


def _apply(toks: list[str], gaps: list[str], merges) -> tuple[list[str], list[str]]:
    for a, b in merges:
        out, out_gaps, i = [], [], 0
        while i < len(toks):
            if i + 1 < len(toks) and toks[i] == a and toks[i + 1] == b and gaps[i + 1] == " ":
                out.append(a + " " + b)
                out_gaps.append(gaps[i])
                i += 2
            else:
                out.append(toks[i])
                out_gaps.append(gaps[i])
                i += 1
        toks, gaps = out, out_gaps
    return toks, gaps


def compress(text: str, merges: list[tuple[str, str]]) -> str:
    """Merged tokens become their number in marks. A text that has the opening mark already is left as it is."""
    if LEFT in text:
        return text
    names = {a + " " + b: f"{LEFT}{i}{RIGHT}" for i, (a, b) in enumerate(merges)}
    toks, gaps, at = [], [], 0
    for m in _TOKEN.finditer(text):
        gaps.append(text[at : m.start()])
        toks.append(m[0])
        at = m.end()
    toks, gaps = _apply(toks, gaps, merges)
    return "".join(g + names.get(t, t) for g, t in zip(gaps, toks, strict=True)) + text[at:]


def decompress(text: str, merges: list[tuple[str, str]]) -> str:
    return re.sub(f"{LEFT}(\\d+){RIGHT}", lambda m: " ".join(merges[int(m[1])]) if int(m[1]) < len(merges) else m[0], text)


def compressed(texts: DataFrame, merges: list[tuple[str, str]], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, packed, ratio, lossless)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed = [compress(t, merges) for t in pdf["text"]]
            same = [decompress(p, merges) == t or LEFT in t for p, t in zip(packed, pdf["text"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "packed": packed, "ratio": [len(p) / max(1, len(t)) for p, t in zip(packed, pdf["text"], strict=True)], "lossless": same})

    python_path(texts.sparkSession)
    return texts.select(F.col(id_col).cast("long").alias("id"), blank(F.col(text_col)).alias("text")).mapInPandas(run, "id long, packed string, ratio double, lossless boolean")
