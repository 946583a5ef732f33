"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine c have squared distance 2 - 2c. A fixed random rotation spreads it over
blocks of a few dimensions; a pair within the whole budget lies, in some block, within the
block's share of it. Each block is a range join: a tree of median splits, fitted on a bounded
sample, deals the block's points to tiles; a vector is at home in one and visits those lower
ones that its block's radius reaches. Within a tile the same kind of tree orders the rows, and
leaves whose boxes lie too far apart are never compared. A pair is counted only in the first
block where it qualifies, so pairs aren't made distinct; only those at the very threshold are listed.

Coordinates travel as 16-bit integers, for which distances are exact and differ from the true
ones by a known bound: pairs beyond the bound on either side are decided in place; those within
it are written out, a tile's at a time, and checked on the vectors themselves in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.components import connected_components
from lodestore.session import discard, materialize, python_path

UNIT = 32767
#: bytes of 16-bit coordinates that one task holds on either side of a tile; rows of a leaf within it
TILE_BYTES, LEAF_ROWS = 32 << 20, 512
#: vectors that fit the trees of splits
SAMPLE = 8192


def block_dims(rows: int) -> int:
    """Dimensions of a block. Wide ones have fewer chance pairs, narrow ones are divided better by many tiles; results are the same."""
    return 32 if rows < 1 << 18 else 16 if rows < 1 << 21 else 8


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int, width: int) -> list[slice]:
    return [slice(i, min(i + width, dims)) for i in range(0, dims, width)]


def radii(dims: int, min_cos: float, width: int) -> tuple[np.ndarray, int, int]:
    """In squared units: each block's radius (its share of the budget by dimensions, and rounding); distances surely within, surely beyond."""
    budget = 2 - 2 * min_cos
    size = np.array([b.stop - b.start for b in blocks_of(dims, width)])
    slack = np.sqrt(size) + 2  # each coordinate is off by half a unit at most, in either vector
    block = np.ceil((np.sqrt(budget * size / dims) * UNIT + slack) ** 2).astype(np.int64)
    all_slack = np.sqrt(dims) + 2
    r = np.sqrt(budget) * UNIT
    return block, int(max(0.0, r - all_slack) ** 2), int(np.ceil((r + all_slack) ** 2))


def usable(v: str) -> Column:
    """Neither null nor empty nor zero, no null or non-finite component."""
    x = F.col(v)
    bad = F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda y: y != 0), F.lit(False))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def scaled(v: str) -> Column:
    """The vector divided by its largest component, so that no square leaves the range of doubles."""
    top = F.array_max(F.transform(v, F.abs))
    return F.transform(v, lambda y: y / top)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row of the other side, root row of this side) and (-1 - row of this side, root) that join what a boolean matrix links."""
    out, rows, cols = [], linked.any(1), linked.any(0)
    while rows.any():
        root = int(np.argmax(rows))
        rows[root] = False
        todo = np.array([root])
        while len(todo):
            at = np.flatnonzero(cols)
            got = at[linked[np.ix_(todo, at)].any(0)]
            cols[got] = False
            out += [(int(j), root) for j in got]
            at = np.flatnonzero(rows)
            todo = at[linked[np.ix_(at, got)].any(1)] if len(got) and len(at) else at[:0]
            rows[todo] = False
            out += [(-1 - int(i), root) for i in todo]
    return out


class Splits:
    """A binary tree of median splits over integer points; its leaves, numbered in order, are the tiles. Splits lie between integers."""

    def __init__(self, points: np.ndarray, leaves: int) -> None:
        #: (dimension, value, left, right), or (-1, 0, leaf, leaf)
        self.nodes: list[tuple[int, float, int, int]] = []
        self.leaves = 0
        self.root = self._split(points, leaves)

    def _split(self, points: np.ndarray, leaves: int) -> int:
        spread = points.max(0) - points.min(0) if len(points) > 1 else np.zeros(1)
        at, value = int(spread.argmax()), 0.0
        if leaves > 1 and spread[at] > 0:
            value = float(np.floor(np.median(points[:, at]))) + 0.5
            low = points[:, at] < value
            if low.all():
                value -= 1.0
                low = points[:, at] < value
            left, right = self._split(points[low], leaves // 2), self._split(points[~low], leaves - leaves // 2)
            self.nodes.append((at, value, left, right))
        else:
            self.nodes.append((-1, value, self.leaves, self.leaves))
            self.leaves += 1
        return len(self.nodes) - 1

    def place(self, x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, whether at home there) of all leaves from the first to the row's home whose region is within the squared ``limit``."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def walk(node: int, rows: np.ndarray, gap: np.ndarray, home: np.ndarray) -> None:
            at, value, left, right = self.nodes[node]
            if not len(rows):
                return
            if at < 0:
                out.append((rows, np.full(len(rows), left), home))
                return
            v = x[rows, at]
            below = v < value
            # the left side may be visited from the right one, which is only entered by those at home in it or visiting from higher leaves
            g = gap.copy()
            g[:, at] = np.maximum(g[:, at], v - value)
            near = (g * g).sum(1) <= limit
            walk(left, rows[near], g[near], (home & below)[near])
            g = gap.copy()
            g[:, at] = np.maximum(g[:, at], value - v)
            near = ((g * g).sum(1) <= limit) & ~(home & below)
            walk(right, rows[near], g[near], home[near])

        x = x.astype(np.float64)
        walk(self.root, np.arange(len(x)), np.zeros(x.shape), np.ones(len(x), bool))
        return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.empty(0, int), np.empty(0, int), np.empty(0, bool))


def _leaves(x: np.ndarray) -> list[np.ndarray]:
    """Rows in groups of ``LEAF_ROWS`` at most, by median splits of the widest dimension."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF_ROWS:
            if len(rows):
                out.append(rows)
            continue
        at = int((x[rows].max(0) - x[rows].min(0)).argmax())
        half = len(rows) // 2
        order = rows[np.argpartition(x[rows, at], half)]
        todo += [order[half:], order[:half]]
    return out


def _near_tiles(x: np.ndarray, y: np.ndarray, x_rank: np.ndarray, y_rank: np.ndarray, limit: int, cols: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, boolean matrix) of pairs that may be within ``limit`` in a block; certainly all that are, of those where the row's rank is below the column's.

    One product per matrix: |a|^2 + |b|^2 - 2ab as an inner product of vectors with two more
    coordinates, in single precision with a margin.
    """
    a, b = x.astype(np.float32) / UNIT, y.astype(np.float32) / UNIT
    na, nb = (a * a).sum(1, keepdims=True), (b * b).sum(1, keepdims=True)
    a = np.hstack([a, -na / 2, np.ones_like(na)])
    b = np.hstack([b, np.ones_like(nb), -nb / 2])
    least = np.float32(-limit / UNIT**2 / 2 - 2e-5)
    there = _leaves(y)
    low, high = np.array([y[r].min(0) for r in there], float), np.array([y[r].max(0) for r in there], float)
    last = np.array([y_rank[r].max() for r in there])
    for rows in _leaves(x):
        lo, hi = x[rows].min(0), x[rows].max(0)
        gap = np.maximum(0, np.maximum(low - hi, lo - high))
        use = ((gap * gap).sum(1) <= limit) & (last > x_rank[rows].min())
        if not use.any():
            continue
        all_cols = np.concatenate([there[k] for k in np.flatnonzero(use)])
        for j in range(0, len(all_cols), cols):
            at = all_cols[j : j + cols]
            near = a[rows] @ b[at].T >= least
            hit = near.any(1)
            if hit.any():
                yield rows[hit], at, near[hit]


def join_tile(block: int, width: int, home: np.ndarray, other: np.ndarray, home_id: np.ndarray, other_id: np.ndarray, home_rank: np.ndarray, other_rank: np.ndarray, home_n: np.ndarray, other_n: np.ndarray, min_cos: float):
    """Links of one tile: (counts by id, forest edges, pairs to be checked exactly). A pair counts where the home row's rank is below the other's."""
    dims = home.shape[1]
    limit, sure, beyond = radii(dims, min_cos, width)
    parts = blocks_of(dims, width)
    counts_home, counts_other = np.zeros(len(home), np.int64), np.zeros(len(other), np.int64)
    edges: list[tuple[int, int]] = []
    check: list[tuple[int, int]] = []

    def squared(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:  # integers below 2^53: exact
        x, y = x[:, parts[k]].astype(np.float64), y[:, parts[k]].astype(np.float64)
        return (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)

    for rows, cols, near in _near_tiles(home[:, parts[block]], other[:, parts[block]], home_rank, other_rank, int(limit[block])):
        rank, other_ranks = home_rank[rows], other_rank[cols]
        a, b = np.divmod(np.flatnonzero(near), near.shape[1])
        if len(a) < 0.02 * near.size:
            keep = rank[a] < other_ranks[b]
            a, b = a[keep], b[keep]
            near = np.zeros(near.shape, bool)
            for k in range(0, len(a), 20_000):
                p, q = a[k : k + 20_000], b[k : k + 20_000]
                d = np.add.reduceat((home[rows[p]].astype(np.int64) - other[cols[q]]) ** 2, [s.start for s in parts], axis=1)
                whole = d.sum(1)
                first = (d[:, block] <= limit[block]) & (d[:, :block] > limit[:block]).all(1) & (whole < beyond)
                ok, edge = first & (whole <= sure), first & (whole > sure)
                near[p[ok], q[ok]] = True
                check += zip(home_id[rows[p[edge]]].tolist(), other_id[cols[q[edge]]].tolist(), strict=True)
        else:
            used = np.unique(b)  # in a dense group, only the columns that are near something
            cols, near = cols[used], near[:, used]
            near &= rank[:, None] < other_ranks[used]
            whole = np.zeros(near.shape)
            for k in range(len(parts)):
                d = squared(home[rows], other[cols], k)
                if k <= block:
                    near &= d <= limit[k] if k == block else d > limit[k]
                whole += d
            a, b = np.nonzero(near & (whole > sure) & (whole < beyond))
            check += zip(home_id[rows[a]].tolist(), other_id[cols[b]].tolist(), strict=True)
            near &= whole <= sure
        if near.any():
            counts_home[rows] += near @ other_n[cols]
            counts_other[cols] += home_n[rows] @ near
            edges += [(int(other_id[cols[v]]) if v >= 0 else int(home_id[rows[-1 - v]]), int(home_id[rows[r]])) for v, r in _forest(near)]
    counts: dict[int, int] = {}
    for ids, n in ((home_id, counts_home), (other_id, counts_other)):
        for k in np.flatnonzero(n):
            counts[int(ids[k])] = counts.get(int(ids[k]), 0) + int(n[k])
    return counts, edges, check


def quantized(flat: np.ndarray, dims: int, turn: dict[int, np.ndarray]) -> np.ndarray:
    """Rows of unit vectors, rotated, as 16-bit integers."""
    x = flat.reshape(-1, dims).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dims not in turn:
        turn[dims] = rotation(dims)
    return np.rint(x @ turn[dims] * UNIT).astype(np.int16)


def _placed(classes: DataFrame, rows: int, min_cos: float, tile_rows: int | None) -> tuple[DataFrame, int]:
    """(cid, n, dims, q, places array<(block, tile, home)>) of each class, and the width of blocks."""
    width = block_dims(rows)
    sizes = {r.dims: r.n for r in classes.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(64).collect()}  # others have one tile a block
    trees: dict[int, list[Splits]] = {}
    for dims, n in sizes.items():
        tiles = -(-n // (tile_rows or max(1, TILE_BYTES // (2 * dims))))
        if tiles > 1:
            sample = classes.filter(F.size("x") == dims).orderBy(F.xxhash64("cid")).limit(SAMPLE).select("x").collect()
            q = quantized(np.array([r.x for r in sample]).ravel(), dims, {}).astype(np.int64)
            trees[dims] = [Splits(q[:, b], tiles) for b in blocks_of(dims, width)]
    kind = pa.list_(pa.struct([("block", pa.int32()), ("tile", pa.int32()), ("home", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[int, np.ndarray] = {}
        for batch in batches:
            cid, n, vec = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            size = np.asarray(vec.value_lengths())
            flat = vec.flatten().to_numpy(zero_copy_only=False)
            start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
            for dims in np.unique(size).tolist():
                rows = np.flatnonzero(size == dims)
                q = quantized(flat[start[rows][:, None] + np.arange(dims)], dims, turn)
                limit, _, _ = radii(dims, min_cos, width)
                got = []
                for k, part in enumerate(blocks_of(dims, width)):
                    if dims in trees:
                        row, tile, home = trees[dims][k].place(q[:, part], float(limit[k]))
                    else:
                        row, tile, home = np.arange(len(q)), np.zeros(len(q), int), np.ones(len(q), bool)
                    got.append((row, np.full(len(row), k), tile, home))
                row, block, tile, home = map(np.concatenate, zip(*got, strict=True))
                order = np.argsort(row, kind="stable")
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(q)))))
                values = pa.StructArray.from_arrays([pa.array(block[order], pa.int32()), pa.array(tile[order], pa.int32()), pa.array(home[order])], fields=list(kind.value_type))
                places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                raw = np.ascontiguousarray(q).view(np.uint8).reshape(len(q), -1)
                yield pa.RecordBatch.from_arrays([pa.array(cid[rows]), pa.array(n[rows]), pa.array(np.full(len(q), dims, np.int32)), pa.array([r.tobytes() for r in raw], pa.binary()), places.cast(kind)], ["cid", "n", "dims", "q", "places"])

    python_path(classes.sparkSession)
    out = classes.select("cid", "n", "x").mapInArrow(run, "cid long, n long, dims int, q binary, places array<struct<block: int, tile: int, home: boolean>>")
    return out, width


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", min_cos: float = 0.95, tile_rows: int | None = None) -> DataFrame:
    """One row per vector: id, n_links (other vectors with cosine >= min_cos), component_id, kept (it is the smallest of its component).

    Equal vectors are one class, so copies make no pairs among themselves. Vectors of different
    length never link. Unusable vectors (see ``usable``) and rows with a null id stand alone;
    a null id's component is null and it is kept. Rows that repeat an id and vector are copies.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    x = F.col(vec_col) if kind in ("float", "double") else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    rows = rows.withColumn("ok", usable("x") & F.col("id").isNotNull())
    good = rows.filter("ok").select("id", "x", F.struct(F.xxhash64("x").alias("a"), F.xxhash64(F.lit(1), "x").alias("b")).alias("h"))
    classes = good.groupBy("h", "x").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    spread, width = _placed(classes, classes.count(), min_cos, tile_rows)
    spread = materialize(spread, "places")
    at = spread.select("dims", F.explode("places").alias("p")).select("dims", "p.*")
    size = at.groupBy("dims", "block", "tile").agg(F.count_if("home").alias("homes"), F.count("*").alias("all"))
    most = F.lit(tile_rows) if tile_rows else F.greatest(F.lit(1), F.expr(f"{TILE_BYTES} div (2 * dims)"))
    # sampled splits leave tiles of about that size; larger ones are cut by hash, home and other rows apart
    cut = size.filter("homes > 0").select("dims", "block", "tile", F.ceil(F.col("homes") / most / 1.5).cast("int").alias("hs"), F.ceil(F.col("all") / most / 3).cast("int").alias("os"))
    placed = spread.select("cid", "n", "dims", "q", F.explode("places").alias("p")).select("cid", "n", "dims", "q", "p.*").join(cut, ["dims", "block", "tile"])
    part = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    here, there = part(F.col("hs")), part(F.col("os"))
    as_home = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("os") - 1), lambda j: F.struct(here.alias("i"), j.alias("j")))).otherwise(F.array())
    as_other = F.transform(F.sequence(F.lit(0), F.col("hs") - 1), lambda i: F.struct(i.alias("i"), there.alias("j")))
    dealt = placed.select("dims", "block", "tile", "cid", "n", "q", "home", here.alias("hp"), there.alias("op"), F.explode(F.array_union(as_home, as_other)).alias("t"))
    dealt = dealt.select("dims", "block", "tile", F.col("t.i").alias("i"), F.col("t.j").alias("j"), (F.col("home") & (F.col("hp") == F.col("t.i"))).alias("here"), (F.col("op") == F.col("t.j")).alias("there"), "home", "cid", "n", "q")

    def tile(key: tuple, t: pa.Table) -> pa.Table:
        dims, block = key[0].as_py(), key[1].as_py()
        here, there, home = (t.column(c).to_numpy() for c in ("here", "there", "home"))
        q = np.frombuffer(b"".join(t.column("q").to_pylist()), np.int16).reshape(-1, dims)
        cid, n = t.column("cid").to_numpy(), t.column("n").to_numpy()
        # among rows at home each pair counts once; a visitor is met by rows at home only
        rank = np.full(len(cid), len(cid))
        if there.all() and (here == home).all():  # the whole tile: in order of its leaves, most of which then meet once
            rank[home] = np.argsort(np.concatenate(_leaves(q[home][:, blocks_of(dims, width)[block]])))
        else:
            rank[home] = np.unique(cid[home], return_inverse=True)[1]
        counts, edges, check = join_tile(block, width, q[here], q[there], cid[here], cid[there], rank[here], rank[there], n[here], n[there], min_cos)
        out = [(0, a, 0, m) for a, m in counts.items()] + [(1, a, b, 0) for a, b in edges] + [(2, a, b, 0) for a, b in check]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({"kind": pa.array(cols[0], pa.int32()), "a": pa.array(cols[1], pa.int64()), "b": pa.array(cols[2], pa.int64()), "n": pa.array(cols[3], pa.int64())})

    found = dealt.groupBy("dims", "block", "tile", "i", "j").applyInArrow(tile, "kind int, a long, b long, n long")
    found = materialize(found, "links")
    discard(spread)
    unit = classes.select("cid", "n", F.col("x").cast("array<double>").alias("x"))
    exact = (
        found.filter("kind = 2").select("a", "b").distinct()
        .join(unit.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("x").alias("xa")), "a")
        .join(unit.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("x").alias("xb")), "b")
        .select("a", "b", "na", "nb", scaled("xa").alias("xa"), scaled("xb").alias("xb"))
        .filter(dot("xa", "xb") / (F.sqrt(dot("xa", "xa")) * F.sqrt(dot("xb", "xb"))) >= min_cos)
        .select("a", "b", "na", "nb")
    )
    exact = materialize(exact, "exact")
    counts = found.filter("kind = 0").select(F.col("a").alias("cid"), F.col("n").alias("m")).unionByName(exact.select(F.col("a").alias("cid"), F.col("nb").alias("m"))).unionByName(exact.select(F.col("b").alias("cid"), F.col("na").alias("m")))
    counts = counts.groupBy("cid").agg(F.sum("m").alias("m"))
    comp = connected_components(found.filter("kind = 1").select("a", "b").unionByName(exact.select("a", "b"))).select(F.col("node").alias("cid"), "component")
    full = classes.select("cid", "h", "n", "low").join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    low = full.groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = full.join(low, "component").join(counts, "cid", "left").select("h", (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    # 128 bits of hash name a class: whole vectors aren't shuffled again
    linked = good.select("id", "h").join(by_class, "h").select("id", "n_links", "component_id")
    alone = rows.filter("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's links and components of all ``embeddings``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
      WHERE a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.vec_id, (SELECT count(*) FROM e WHERE e.a = d.vec_id)::BIGINT AS n_links, c.component_id, d.vec_id = c.component_id AS kept
FROM embeddings d JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.vec_id
"""
