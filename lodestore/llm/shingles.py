"""Documents whose sets of word shingles are alike: min-hash bands find candidates, the exact Jaccard similarity decides.

A set's 192 min-hashes make 32 keys of six each. Sets with a similarity of 0.8 share no key once
in about 17,000 times, those with 0.85 once in 60 million. A candidate whose min-hashes agree in
far fewer places than the similarity asks for (four standard deviations) is dropped before its
sets are compared. Sets of one component aren't compared again: each set is first tried with the
likeliest of a few neighbours under its keys, then all pairs of different components that share
a key are, in parts of bounded bytes. A pair counts only under its first common key. Sets are
kept as 48 bits of each shingle's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.components import connected_components
from lodestore.session import discard, materialize, python_path

BANDS, ROWS = 32, 6
#: sets that follow under a key and are tried as likely partners; bytes of sets on either side of a part
NEXT, PART_BYTES = 16, 8 << 20
#: bytes of a sketch
WIDTH = BANDS * (ROWS + 4)
_R = np.random.default_rng(5)
_TIMES = _R.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _R.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles; words are those of ``simhash.fingerprint``. Fewer words than a shingle make one; none make an empty set."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: max(1, len(found) - words + 1)].tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    ends = ends[min(words, len(found)) - 1 :].tolist()
    return np.unique(np.fromiter((digest(view[a:b]) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, True))
    return both / max(1, len(a) + len(b) - both)


def min_hashes(grams: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(grams), 2048):
        low = np.minimum(low, ((grams[i : i + 2048, None] ^ _XOR) * _TIMES).min(0))
    return low


def sketch(grams: np.ndarray) -> tuple[int, list[int], bytes]:
    """(the set's own number, band keys, a byte of each min-hash and 32 bits of each key); an empty set has no keys."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    if not len(grams):
        return 0, [], b""
    low = min_hashes(grams)
    keys = [signed(xxhash.xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i)) for i in range(BANDS)]
    return signed(xxhash.xxh64_intdigest(grams.tobytes())), keys, low.astype(np.uint8).tobytes() + np.array(keys).astype(np.uint32).tobytes()


def packed(grams: np.ndarray) -> bytes:
    return grams.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def sketches(docs: DataFrame, fingerprint, id_col: str, text_col: str, words: int = 5) -> DataFrame:
    """(id, fp, node, keys, sig, grams) for every row; ``fingerprint`` is a function of the text, ``node`` names the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            sets = [shingle_set(t, words) for t in texts]
            node, keys, sig = zip(*map(sketch, sets), strict=True) if sets else ((), (), ())
            fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            out = [b.column(0).cast(pa.int64()), pa.array(fp), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary()), pa.array(list(map(packed, sets)), pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["id", "fp", "node", "keys", "sig", "grams"])

    python_path(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long, node long, keys array<long>, sig binary, grams binary")


def _partners(placed: DataFrame, least: float) -> DataFrame:
    """(a, fa, b, fb): a likely partner of each set among the next few sets (key, node, fp, sig) of a key, of all its keys the likeliest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 3 + [np.empty((0, WIDTH), np.uint8)]
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, WIDTH)
            cols = [np.concatenate((h, x)) for h, x in zip(held, [*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)), sig], strict=True)]
            key, node, fp, sig = cols
            best, share = np.full(len(key), -1), np.full(len(key), least)
            for shift in range(1, NEXT + 1):
                at = np.flatnonzero(key[shift:] == key[:-shift])
                if not len(at):
                    break
                got = (sig[at, : BANDS * ROWS] == sig[at + shift, : BANDS * ROWS]).mean(1)
                at, got = at[got >= share[at]], got[got >= share[at]]
                best[at], share[at] = at + shift, got
            i = np.flatnonzero(best >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i], fp[i], node[best[i]], fp[best[i]], share[i])], ["a", "fa", "b", "fb", "share"])
            held = [x[-NEXT:] for x in cols]  # the last sets may have a partner in the next batch

    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.select("key", "node", "fp", "sig").repartition(n, "key").sortWithinPartitions("key", "node")
    found = dealt.mapInArrow(run, "a long, fa long, b long, fb long, share double")
    top = F.max_by(F.struct("b", "fb"), F.struct("share", "b")).alias("x")
    return found.groupBy("a", "fa").agg(top).select("a", "fa", F.col("x.b").alias("b"), F.col("x.fb").alias("fb"))


def _group_links(key: int, node: np.ndarray, fp: np.ndarray, comp: np.ndarray, here: np.ndarray, there: np.ndarray, home: np.ndarray, sig: np.ndarray, grams: list[bytes], least: float, similarity: float) -> list[tuple[int, int]]:
    """Links (fp, fp) of sets of one key in different components. Pairs with an earlier key in common are left to it, and of two sets at home the smaller is tried with the larger."""
    marks = np.ascontiguousarray(sig[:, BANDS * ROWS :]).view(np.uint32)
    sig, marks = sig[:, : BANDS * ROWS], marks[:, : int(np.argmax(marks[0] == np.uint32(key & 0xFFFFFFFF)))]
    sets: dict[int, np.ndarray] = {}
    out = []

    def of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = unpacked(grams[i])
        return sets[i]

    others = np.flatnonzero(there)
    for i in np.flatnonzero(here):
        rest = others[(comp[others] != comp[i]) & (~home[others] | (node[others] > node[i]))]
        rest = rest[~(marks[rest] == marks[i]).any(1)]
        rest = rest[(sig[rest] == sig[i]).mean(1) >= least]
        if not len(rest):
            continue
        own, parts = np.sort(of(int(i))), [of(int(j)) for j in rest]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.concatenate(parts)
        both = np.add.reduceat(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat, np.concatenate(([0], np.cumsum(size)[:-1])), dtype=np.int64)
        like = both >= (similarity - 1e-12) * (len(own) + size - both)
        out += [(int(fp[i]), int(fp[j])) for j in rest[like]]
    return out


def _open_links(placed: DataFrame, nodes: DataFrame, grams: DataFrame, least: float, similarity: float) -> DataFrame:
    """Edges (a, b) between fingerprints of all sets (key, node, fp, comp) of different components that share a key and are alike.

    Of a key, sets outside its largest component are at home and are tried with all others; both
    sides are cut into parts of bounded bytes. The sets themselves come to each part once, so
    that candidates are decided in place and no pair is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def work(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            marks = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
            cut = [0, *(np.flatnonzero((np.diff(marks) != 0).any(0)) + 1).tolist(), t.num_rows]
            out: list[tuple[int, int]] = []
            for s, e in zip(cut, cut[1:], strict=False):
                if e - s > 1:
                    g = t.slice(s, e - s)
                    cols = [g.column(c).to_numpy() for c in ("node", "fp", "comp", "here", "there", "home")]
                    sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint8).reshape(-1, WIDTH)
                    out += _group_links(int(marks[0, s]), *cols, sig, g.column("grams").to_pylist(), least, similarity)
            a, b = zip(*out, strict=True) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        mark = np.empty(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            marks = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
            cut = [0, *(np.flatnonzero((np.diff(marks) != 0).any(0)) + 1).tolist(), t.num_rows]
            done = 0
            if held and (marks[:, 0] == mark).all():
                held.append(t.slice(0, cut[1]))
                done = cut[1]
            if done < t.num_rows:
                if held:
                    yield work(pa.concat_tables(held))
                if done < cut[-2]:
                    yield work(t.slice(done, cut[-2] - done))
                held = [t.slice(cut[-2])]  # the last part may go on in the next batch
            mark = marks[:, -1]
        if held:
            yield work(pa.concat_tables(held))

    size = F.length("grams").cast("long") + WIDTH
    full = placed.join(nodes.select("node", "sig"), "node").join(grams, "node").withColumn("bytes", size)
    by = placed.join(grams.select("node", size.alias("bytes")), "node").groupBy("key", "comp").agg(F.sum("bytes").alias("bytes"))
    keys = by.groupBy("key").agg(F.max_by("comp", F.struct("bytes", "comp")).alias("mode"), F.max("bytes").alias("most"), F.sum("bytes").alias("all"), F.count("*").alias("n")).filter("n > 1")
    keys = keys.select("key", "mode", F.ceil((F.col("all") - F.col("most")) / PART_BYTES).cast("int").alias("hs"), F.ceil(F.col("all") / PART_BYTES).cast("int").alias("os"))
    full = full.join(keys, "key").withColumn("home", F.col("comp") != F.col("mode"))
    here, there = F.pmod(F.xxhash64("node"), "hs").cast("int"), F.pmod(F.xxhash64("node"), "os").cast("int")
    as_home = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("os") - 1), lambda j: F.struct(here.alias("i"), j.alias("j")))).otherwise(F.array())
    as_other = F.transform(F.sequence(F.lit(0), F.col("hs") - 1), lambda i: F.struct(i.alias("i"), there.alias("j")))
    full = full.withColumn("hp", here).withColumn("op", there).withColumn("t", F.explode(F.array_union(as_home, as_other)))
    dealt = full.select("key", F.col("t.i").alias("i"), F.col("t.j").alias("j"), "node", "fp", "comp", (F.col("home") & (F.col("hp") == F.col("t.i"))).alias("here"), (F.col("op") == F.col("t.j")).alias("there"), "home", "sig", "grams")
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between fingerprints of the pairs whose sets are as similar as that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = zip(*(b.column(i).to_pylist() for i in (2, 3)), strict=True)
            ok = pa.array([jaccard(unpacked(x), unpacked(y)) >= similarity - 1e-12 for x, y in sets], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    both = pairs.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    return both.select("fa", "fb", "ga", "gb").mapInArrow(run, "a long, b long")


def similar_links(rows: DataFrame, links: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``links`` (a, b) between fingerprints and further ones, so that all documents (``rows``: written ``sketches``, deleted here) that are as similar as that are connected.

    The sets of one fingerprint are linked by definition.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("the bands are made for similarities of 0.8 and more")
    least = similarity - 4.15 * (similarity * (1 - similarity) / (BANDS * ROWS)) ** 0.5
    nodes = materialize(rows.filter(F.size("keys") > 0).groupBy("node").agg(F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "sets")
    same = rows.select("node", F.col("fp").alias("b")).distinct().join(nodes.select("node", F.col("fp").alias("a")), "node").filter("a <> b").select("a", "b")
    bands = nodes.select("node", F.explode("keys").alias("key"))
    shared = materialize(bands.join(bands.groupBy("key").count().filter("count > 1").select("key"), "key"), "bands")
    wanted = materialize(shared.select("node").distinct(), "wanted")  # few: the sets of the others needn't move
    grams = materialize(rows.select("node", "grams").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("grams").alias("grams")), "grams")
    same = materialize(same, "same")
    discard(rows)
    discard(wanted)
    placed = shared.join(nodes.select("node", "fp", "sig"), "node")
    links = links.select("a", "b").unionByName(same)
    first = _verified(materialize(_partners(placed, similarity - 0.05), "partners"), grams, similarity)
    links = materialize(links.unionByName(first), "links")
    comp = connected_components(links).select(F.col("node").alias("fp"), F.col("component").alias("comp"))
    placed = materialize(shared.join(nodes.select("node", "fp").join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "node"), "placed")
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    rest = materialize(placed.join(open_keys, "key"), "open")
    return links.unionByName(_open_links(rest, nodes, grams, least, similarity))
