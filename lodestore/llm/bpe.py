"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked symbol list.

Each pre-token is a linked list of symbols. The queue holds ranks and positions of adjacent
pairs; an entry whose pair has changed since is stale and is skipped. A merge
joins two list cells and queues the pairs with the new neighbours, so a pre-token of n bytes
costs n log n however long it is. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.vocab import vocabulary_path
from lodestore.session import python_path, read_table

#: Fixed: the pre-tokenizer pattern of byte-level BPE.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WIDE_SPACE = regex.compile(r"[^\S\x20\x0a]")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _odd_space(text: str) -> bool:
    """Whether a space lies beside other white space or at the end, or there is any but spaces and newlines: there a space isn't simply the head of the next word."""
    if "  " in text or " \n" in text or "\n " in text or text[-1:] == " ":
        return True
    if text.isascii():
        return any(c in text for c in "\t\r\v\f\x1c\x1d\x1e\x1f")
    return WIDE_SPACE.search(text) is not None


class ByteBPE:
    """Encoder and decoder of one vocabulary file; caches are bounded and only save time."""

    def __init__(self, path: str, cache: int = 200_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.byte_id = [0] * 256
        for char, byte in alphabet.items():
            self.byte_id[byte] = vocab[char]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.strings[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.merges, self.made = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        pairs = ((a, b, self.merges.get(x << 20 | y)) for a, x in enumerate(self.byte_id) for b, y in enumerate(self.byte_id))
        self.first = {(a, b): r for a, b, r in pairs if r is not None}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.size, self.words, self.pieces = cache, {}, {}
        self.old_words, self.old_pieces = {}, {}  # the generation before: what is in use moves on, the rest goes

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token. A queue entry holds a rank and a position; it is stale unless it is the one that lives at its position."""
        n = len(data)
        ids = list(map(self.byte_id.__getitem__, data))
        bits = n.bit_length()
        live = [-1 if r is None else r << bits | i for i, r in enumerate(map(self.first.get, zip(data, data[1:], strict=False)))]
        queue = [e for e in live if e >= 0]
        if not queue:
            return ids
        live.append(-1)
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        mask, get, made = (1 << bits) - 1, self.merges.get, self.made
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            e = pop(queue)
            i = e & mask
            if live[i] != e:
                continue  # stale
            new = made[e >> bits]
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j] = new, -1
            live[i] = live[j] = -1
            if k < n:
                before[k] = i
                if (r := get(new << 20 | ids[k])) is not None:
                    live[i] = e = r << bits | i
                    push(queue, e)
            h = before[i]
            if h >= 0:
                if (r := get(ids[h] << 20 | new)) is not None:
                    live[h] = e = r << bits | h
                    push(queue, e)
                else:
                    live[h] = -1
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        if (got := self.words.get(word)) is None:
            if (got := self.old_words.get(word)) is None:
                got = array("I", self.merge(word.encode("utf-8"))).tobytes()
            if len(word) <= 32:
                if len(self.words) >= self.size:
                    self.old_words, self.words = self.words, {}
                self.words[word] = got
        return got

    def _piece(self, piece: str) -> bytes:
        """Of a space and what follows it up to the next."""
        if (got := self.old_pieces.get(piece)) is None:
            got = self._word(" " + piece) if piece.isascii() and piece.isalpha() else self._plain(" " + piece)
        if len(piece) <= 32:
            if len(self.pieces) >= self.size:
                self.old_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = got
        return got

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._word, PATTERN.findall(text)))

    def _ordinary(self, text: str) -> bytes:
        if _odd_space(text):
            return self._plain(text)
        # each space is the head of the pre-token that follows it, so what lies between spaces encodes by itself
        head, *rest = text.split(" ")
        out = list(map(self.pieces.get, rest))
        i = out.index(None) if None in out else -1
        while i >= 0:
            out[i] = self.pieces.get(rest[i]) or self._piece(rest[i])
            try:
                i = out.index(None, i + 1)
            except ValueError:
                break
        return self._plain(head) + b"".join(out)

    def encode_bytes(self, text: str) -> bytes:
        """Ids as unsigned 32-bit numbers in native (little-endian) order. Special tokens' strings become their ids."""
        if self.split is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        return b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else self._ordinary(x) for x in self.split.split(text) if x)

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_bytes(text)).tolist()

    def decode(self, ids) -> str:
        """Concatenated vocabulary strings; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, with_ids: bool = True) -> DataFrame:
    """Per row: id, ids (binary: little-endian unsigned 32-bit; null unless ``with_ids``), n_tokens, ids_sha256, decoded_sha256.

    A null text is an empty one: no tokens. Texts are encoded whole, repeated rows each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary_path("byte_bpe_50k.json", vocab))
        for b in batches:
            ids, n, sha, back = [], [], [], []
            for text in b.column(1).to_pylist():
                data = bpe.encode_bytes(text or "")
                ids.append(data if with_ids else None)
                n.append(len(data) // 4)
                sha.append(hashlib.sha256(data).hexdigest())
                back.append(hashlib.sha256(bpe.decode(memoryview(data).cast("I")).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    python_path(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``bpe_encode`` over ``documents``."""
    found = bpe_encode(read_table(spark, f"{sf_dir}/documents.parquet"), with_ids=False)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
