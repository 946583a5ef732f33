"""SimHash near-dedup: fingerprints joined through Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. If two fingerprints differ
in at most four bits, no two segments can have three errors or more, so at least one pair of
segments has two errors at most in each: there both share a Golay key (see ``golay``), and
the pair of keys (24 bits) is the join key. Of more than ``WIDE_ROWS`` fingerprints too many would
share such a key; then the join key is either the three segments' Golay keys (36 bits), if each
has two errors at most, or else one segment as it is with another's Golay key: with three errors
or more in one segment, one of the other two has none and the other one at most. Every candidate
is verified by its exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import golay, shingles
from lodestore.llm.components import connected_components
from lodestore.session import materialize, python_path, read_table, scratch

#: (lowest bit, bits) of each segment
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: distinct fingerprints from which on the longer keys are used
WIDE_ROWS = 4_000_000


def fingerprint(text: str | None, shingle_words: int = 4, seed: int = 42) -> int:
    """A bit is 1 if set in over half of the XXH64 values of the word shingles, repeats included.

    Only A-Z are lower-cased; words are runs of anything but ASCII white space; fewer words than
    a shingle make one shingle; no words (null text too) make fingerprint zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle_words + 1].tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    total, n, step = np.zeros(64, np.int64), len(starts), 1 << 16
    ends = ends[shingle_words - 1 :].tolist()
    for i in range(0, n, step):
        h = np.fromiter((digest(view[a:b], seed) for a, b in zip(starts[i : i + step], ends[i : i + step], strict=True)), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """(id, fp long) for every row; fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle_words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp)], ["id", "fp"])

    python_path(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def join_keys(fps: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every fuzzy join key of unsigned fingerprints; ``wide``: the longer ones."""
    rows, out = [], []
    parts = [fps >> np.uint64(low) & np.uint64((1 << bits) - 1) for low, bits in SEGMENTS]
    found = [golay.keys(x, bits) for x, (_, bits) in zip(parts, SEGMENTS, strict=True)]
    if wide:
        a, b, c = found[0][:, :, None, None], found[1][:, None, :, None], found[2][:, None, None, :]
        row, x, y, z = np.nonzero((a >= 0) & (b >= 0) & (c >= 0))
        rows.append(row)
        out.append((found[0][row, x].astype(np.int64) << 24 | found[1][row, y] << 12) | found[2][row, z])
        for k, (i, j) in enumerate(permutations(range(len(SEGMENTS)), 2)):
            row, x = np.nonzero(found[j] >= 0)
            rows.append(row)
            out.append((k + 1 << 40) | parts[i][row].astype(np.int64) << 12 | found[j][row, x])
        return np.concatenate(rows), np.concatenate(out)
    for k, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        a, b = found[i][:, :, None], found[j][:, None, :]
        row, x, y = np.nonzero((a >= 0) & (b >= 0))
        rows.append(row)
        out.append((k << 24) | found[i][row, x].astype(np.int64) << 12 | found[j][row, y])
    return np.concatenate(rows), np.concatenate(out)


def _roots(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, the first of its component here) of one run of distinct fingerprints that share a key.

    Breadth first: each fingerprint taken is compared with those not yet reached, which then leave;
    links are exact, and a dense run costs little more than its size.
    """
    rest, a, b = fps, [], []
    while len(rest) > 1:
        root, todo, rest = rest[0], [rest[:1]], rest[1:]
        while todo and len(rest):
            for x in todo.pop():
                near = np.bitwise_count(rest ^ x) <= distance
                if near.any():
                    got, rest = rest[near], rest[~near]
                    todo.append(got)
                    a.append(got)
                    b.append(np.full(len(got), root))
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def link_runs(key: np.ndarray, fp: np.ndarray, distance: int, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints of equal keys; key is sorted. Short runs pair by shifts, long ones breadth first."""
    cut = np.flatnonzero(np.diff(key)) + 1
    start, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
    size = end - start
    a, b = [], []
    short = np.repeat(size <= small, size)
    for shift in range(1, int(size[size <= small].max(initial=1))):
        at = np.flatnonzero(short[shift:] & (key[shift:] == key[:-shift]))
        at = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= distance]
        a.append(fp[at])
        b.append(fp[at + shift])
    for i in np.flatnonzero(size > small):
        x, y = _roots(np.unique(fp[start[i] : end[i]]), distance)
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def fingerprint_links(distinct: DataFrame, distance: int = 4, wide: bool | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose transitive closure is that of all pairs within ``distance`` bits."""
    if not 0 <= distance <= 4:
        raise ValueError("the segments guarantee distances up to 4")
    long_keys = distinct.count() > WIDE_ROWS if wide is None else wide

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_fps = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(all_fps), 2048):
                fps = all_fps[i : i + 2048]
                row, key = join_keys(fps.view(np.uint64), long_keys)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], ["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of one run, which the next batch may go on with
        out: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(out), axis=0).view(np.int64) if out else np.empty((0, 2), np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], ["a", "b"])

        def work(key: np.ndarray, fp: np.ndarray) -> None:
            if len(key):
                a, b = link_runs(key, fp, distance)
                if len(a):
                    out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))

        for batch in batches:
            key, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            if not held or held[0][0][0] != key[-1]:  # the held run ends in this batch
                last = int(np.searchsorted(key, key[-1]))
                keys, fps = zip(*held, (key[:last], fp[:last]), strict=True)
                work(np.concatenate(keys), np.concatenate(fps))
                held, key, fp = [], key[last:], fp[last:]
            held.append((key, fp))
            if sum(map(len, out)) > 500_000:
                yield flush()
        if held:
            keys, fps = zip(*held, strict=True)
            work(np.concatenate(keys), np.concatenate(fps))
        yield flush()

    python_path(distinct.sparkSession)
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.select("fp").mapInArrow(spread, "key long, fp long")
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, distance: int = 4, similarity: float | None = None) -> DataFrame:
    """One row per document: id, fp long, component_id (smallest id reachable over links, itself included), component.

    Documents of one fingerprint are linked by definition and are joined as one node, so copies
    never make pairs. Null ids keep their row; they belong to the component of their fingerprint,
    and a component of null ids alone has component_id null (``component``, its smallest
    fingerprint, tells such ones apart). Empty tables give no rows. With ``similarity``, documents
    whose sets of 5-word shingles have that Jaccard similarity or more are linked too.
    """
    with scratch("fp", "fpcomp"):
        wide = None
        if similarity is None:
            fps = materialize(fingerprints(docs, id_col, text_col, shingle_words), "fp")
        else:
            wide = materialize(shingles.sketches(docs, lambda t: fingerprint(t, shingle_words), id_col, text_col), "sketch")
            fps = materialize(wide.select("id", "fp"), "fp")
        # nodes are the fingerprints themselves; the smallest document id of a component is taken afterwards
        nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("low")), "fpnode")
        links = fingerprint_links(nodes, distance)
        if wide is not None:
            links = shingles.similar_links(wide, links, similarity)
        comp = connected_components(links).select(F.col("node").alias("fp"), "component")
        full = nodes.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        low = full.groupBy("component").agg(F.min("low").alias("component_id"))
        by_fp = materialize(full.join(low, "component").select("fp", "component_id", "component"), "fpcomp")
    return fps.join(by_fp, "fp").select("id", "fp", "component_id", "component")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, distance: int = 4, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs``, unchanged, of which each stands for its component: those with the smallest id.

    Of rows that repeat that id one stays, and a component of null ids alone keeps one row: the
    first by a hash of all its columns, so that reruns agree.
    """
    with scratch("comps"):
        comps = materialize(simhash_components(docs, id_col, text_col, shingle_words, distance, similarity), "comps")
    kept = comps.filter("id = component_id").groupBy(F.col("id").alias("k")).agg(F.count("*").alias("copies"))
    # the row travels as one struct: its columns can't clash with ours
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.struct(*docs.columns).alias("row"), F.xxhash64(*docs.columns).alias("order"))
    out = rows.join(kept.filter("copies = 1"), "k", "left_semi").select("row")
    again = kept.filter("copies > 1").select("k")
    if not again.isEmpty():
        out = out.unionByName(rows.join(again, "k", "left_semi").groupBy("k").agg(F.min_by("row", "order").alias("row")).select("row"))
    bare = comps.filter("id IS NULL AND component_id IS NULL").select("fp", "component").distinct()
    if not bare.isEmpty():
        own = F.pandas_udf(lambda texts: texts.map(lambda t: fingerprint(t, shingle_words)).astype("uint64").astype("int64"), "long")
        null_rows = rows.filter("k IS NULL").withColumn("fp", own(F.col("row")[text_col].cast("string")))
        out = out.unionByName(null_rows.join(bare, "fp").groupBy("component").agg(F.min_by("row", "order").alias("row")).select("row"))
    return out.select("row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``simhash_components`` over ``documents``."""
    found = simhash_components(read_table(spark, f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
