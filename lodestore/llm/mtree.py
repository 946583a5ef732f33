"""Exact top-k by inner product with M-trees.

Inner products aren't a metric, so a vector x is given one more coordinate, sqrt(M - |x|^2), M
being its tree's largest squared norm: then all have norm sqrt(M), and the larger a query's product
with x, the nearer x is. Vectors are dealt to the nearest of a bounded set of routing objects,
whose covering radii leave out queries that can't find anything there. Each share is bulk-loaded
into an M-tree of paged nodes that hold, per entry, the pivot, its distance to the parent and the
covering radius. A search takes nodes best-first and leaves out entries whose stored distances
show, by the triangle inequality, that they can't beat the k-th result so far, before any distance
to them is computed.

Only the pruning uses floating point, on vectors scaled to components of 1 at most and with a
margin, so ties and near ties are always scored. Scores are exact integers of any size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.session import materialize, python_path

PAGE = 256
FANOUT = 32
#: routing objects, drawn from a sample of at most so many vectors
ROUTES, SAMPLE = 256, 2048
#: bytes of one tree's vectors as doubles; at least so many vectors a tree; queries searched against it in one task
TREE_BYTES, TREE_ROWS, QUERY_ROWS = 32 << 20, 4096, 65_536
#: relative to the largest distance; rounding stays far below it
MARGIN = 1e-6
LONG = (1 << 63) - 1


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): whole doubles, or Python integers where a double can't hold the product."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    if np.isfinite(y).all():
        return y
    return np.array([[int(v) * scale if abs(v) > 1 << 53 else math.floor(v * scale) for v in row] for row in x.tolist()], object).reshape(x.shape)


def unit(x: np.ndarray, top: float | None = None) -> tuple[np.ndarray, float]:
    """Finite vectors divided by their largest component (or ``top``), and that component as a double."""
    big = x.dtype == object
    shift = max((abs(v).bit_length() for v in x.ravel()), default=0) if big else 0
    f = np.array([[float(v >> max(0, shift - 1000)) for v in row] for row in x], float).reshape(x.shape) if big else x
    s = (float(np.abs(f).max(initial=0.0)) or 1.0) if top is None else top
    return f / s, s


def products(x: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray | list[int]:
    """Exact integer inner products of integer rows with q. ``bound``: at least the sum of the products' sizes."""
    if bound < 2.0**53:
        return (x @ q).astype(np.int64)
    if bound < 2.0**62 and x.dtype != object and q.dtype != object and max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) < 2.0**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    whole = [int(v) for v in q]
    return [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x]


class MTree:
    """M-tree over integer vectors (as ``integers`` gives them), bulk-loaded. ``keys`` tell rows of one id apart."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, keys: np.ndarray | None = None, page: int = PAGE, seed: int = 5) -> None:
        self.x, self.ids, self.keys = x, ids, ids if keys is None else keys
        f, self.scale = unit(x)
        square = np.einsum("ij,ij->i", f, f) if len(f) else np.zeros(0)
        self.norm = float(square.max(initial=0.0))
        self.f = np.column_stack([f, np.sqrt(np.maximum(0.0, self.norm - square))])
        self.size = float(np.abs(x).max()) if x.size and x.dtype != object else math.inf
        self.page, self.rng = page, np.random.default_rng(seed)
        #: node: (rows, distances to its pivot) of a page, or (children, distances to its pivot, their radii, pivots)
        self.nodes: list[tuple] = []
        self.root = self._load(np.lexsort((self.keys, ids)), 0) if len(x) else None
        self.computed = 0

    def _distance(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 * self.norm - 2 * (self.f[rows] @ self.f[pivot])))

    def _load(self, rows: np.ndarray, pivot: int) -> int:
        away = self._distance(rows, pivot)
        if len(rows) <= self.page:
            self.nodes.append((rows, away, None, None))
            return len(self.nodes) - 1
        k = min(FANOUT, -(-len(rows) // self.page) + 1)
        pivots = rows[np.sort(self.rng.choice(len(rows), k, replace=False))]
        near = (self.f[rows] @ self.f[pivots].T).argmax(1)  # all have one norm: the nearest
        groups = [rows[near == j] for j in range(k)]
        if max(map(len, groups)) == len(rows):  # all alike: no pivot divides them
            groups = np.array_split(rows, k)
            pivots = np.array([g[0] for g in groups])
        kept = [(g, int(p)) for g, p in zip(groups, pivots, strict=True) if len(g)]
        children = np.array([self._load(g, p) for g, p in kept])
        radius = np.array([self._distance(g, p).max() for g, p in kept])
        pivots = np.array([p for _, p in kept])
        self.nodes.append((children, self._distance(pivots, pivot), radius, pivots))
        return len(self.nodes) - 1

    def search(self, q: np.ndarray, k: int, floor: float = -np.inf, without: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id. ``floor``: a score, of ``unit`` vectors of this tree and the query, that k vectors are known to reach; ``without``: a key left out."""
        if self.root is None:
            return []
        p, q_scale = unit(q[None, :])
        p = p[0]
        reach = float(p @ p) + self.norm
        margin = MARGIN * math.sqrt(reach)
        bound = len(q) * self.size * q_scale if q.dtype != object else math.inf
        best: list[tuple[int, int, int]] = []  # heap of (score, -id, -key), the worst first
        limit = math.sqrt(min(max(0.0, reach - 2 * floor), 4 * reach)) + margin

        def away(f: np.ndarray) -> np.ndarray:
            self.computed += len(f)
            return np.sqrt(np.maximum(0.0, reach - 2 * (f[:, :-1] @ p)))

        queue = [(0.0, self.root, float("nan"))]
        while queue:
            least, node, parent = heapq.heappop(queue)
            if least > limit + margin:
                break
            entries, stored, radius, pivots = self.nodes[node]
            if parent == parent:  # known: the distance from the query to this node's pivot
                use = np.abs(stored - parent) - (0 if radius is None else radius) <= limit + margin
                if not use.all():
                    entries = entries[use]
                    if radius is not None:
                        radius, pivots = radius[use], pivots[use]
            if not len(entries):
                continue
            if radius is not None:
                d = away(self.f[pivots])
                lower = np.maximum(least, d - radius)
                for at in np.flatnonzero(lower <= limit + margin).tolist():
                    heapq.heappush(queue, (float(lower[at]), int(entries[at]), float(d[at])))
                continue
            rows = entries[away(self.f[entries]) <= limit + margin]
            if not len(rows):
                continue
            found = zip(map(int, products(self.x[rows], q, bound)), (-self.ids[rows]).tolist(), (-self.keys[rows]).tolist(), strict=True)
            for x in sorted(found, reverse=True):
                if without is not None and -x[2] == without:
                    continue
                if len(best) < k:
                    heapq.heappush(best, x)
                elif x > best[0]:
                    heapq.heapreplace(best, x)
                else:
                    break
            if len(best) == k:
                limit = min(limit, math.sqrt(max(0.0, reach - 2 * _ratio(best[0][0], self.scale, q_scale, self.x, q))))
        return [(s, -i) for s, i, _ in sorted(best, reverse=True)]


def _ratio(score: int, scale: float, q_scale: float, x: np.ndarray, q: np.ndarray) -> float:
    """An exact score in terms of ``unit`` vectors."""
    if x.dtype != object and q.dtype != object and scale * q_scale < 1e300:
        return score / (scale * q_scale)
    top = lambda y: max((abs(int(v)) for v in y.ravel()), default=0) or 1
    size = top(x) * top(q)
    drop = max(0, size.bit_length() - 900)
    return float(score >> drop) / float(size >> drop)


def order_text(score: int) -> str:
    """Text that orders scores which ``score`` as long (the nearest one) doesn't tell apart."""
    if -LONG - 1 <= score <= LONG:
        return "5"
    digits = str(abs(score))
    text = f"{len(digits):04d}{digits}"
    return "6" + text if score > 0 else "4" + "".join(str(9 - int(c)) for c in text)


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.float64) if len(col) else np.zeros((0, 0))


def usable_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, key, dims, x) of the rows that take part: no null id, no null or empty vector, no null or non-finite component. ``key`` numbers the rows."""
    x = F.col(vec_col)
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    x = x if kind in ("float", "double") else x.cast("array<double>")
    bad = F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("key"), x.alias("x"), bad.alias("bad"))
    return rows.filter("id IS NOT NULL AND NOT bad AND size(x) > 0").select("id", "key", F.size("x").alias("dims"), "x")


def top_products(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with the other rows.

    Queries are the rows whose id is divisible by ``every``; rows that repeat such an id are
    queries of their own, each with its ranks, and each is a candidate for the others. Vectors of
    another length than the query's have no product with it. Products are ranked as whole numbers
    of any size; one that long can't hold is given as the nearest long. Fewer than k candidates
    give fewer rows; empty tables none.
    """
    spark = vectors.sparkSession
    rows = materialize(usable_rows(vectors, id_col, vec_col), "int")
    kind = rows.schema["x"].dataType.simpleString()
    stats = rows.agg(F.count("*"), F.max(F.array_max(F.transform("x", lambda y: F.abs(y).cast("double"))))).first()
    total, top = stats[0], float(stats[1] or 1.0)
    sample = [(r.dims, r.key, r.x) for r in rows.orderBy(F.xxhash64("id", "key")).limit(SAMPLE).collect()]
    by_dims: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dims in sorted({d for d, _, _ in sample}):
        own = [(i, x) for d, i, x in sample if d == dims]
        by_dims[dims] = np.array([i for i, _ in own]), _scaled(np.array([x for _, x in own], float), scale, top)
    routes = {d: x[: max(1, min(ROUTES, total // TREE_ROWS))] for d, (_, x) in by_dims.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The route of each row, and how far it is from the routing object."""
        for b in batches:
            dims = b.column(2).to_numpy()
            route, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d in routes:
                    x, p = _scaled(_matrix(b.column(3).take(pa.array(at))), scale, top), routes[d]
                    route[at] = (x @ p.T - (p * p).sum(1) / 2).argmax(1)
                    away[at] = np.sqrt(((x - p[route[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(route), pa.array(away)], ["id", "key", "dims", "x", "route", "away"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A score (of scaled vectors) that k sampled candidates reach, and the routes that may hold one as good."""
        for b in batches:
            low, where = [], []
            for key, d, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                keys, m = by_dims.get(d, (np.empty(0), np.zeros((0, d))))
                q = unit(integers(np.array([x], float), scale))[0][0]
                s = (m @ q)[keys != key]
                low.append(float(np.partition(s, -k)[-k]) if len(s) >= k else None)
                best = routes[d] @ q + math.sqrt(q @ q) * radius[d] if d in routes else np.zeros(1)
                at = np.arange(len(best)) if low[-1] is None else np.flatnonzero(best >= low[-1] - MARGIN * d)
                where.append(at.astype(np.int32).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(low, pa.float64()), pa.array(where, pa.list_(pa.int32()))], ["id", "key", "dims", "x", "low", "routes"])

    python_path(spark)
    dealt = materialize(rows.mapInArrow(deal, f"id long, key long, dims int, x {kind}, route int, away double"), "dealt")
    most = F.greatest(F.lit(TREE_ROWS), F.least(F.lit(total // (2 * spark.sparkContext.defaultParallelism)), F.lit(TREE_BYTES / 8) / F.col("dims")))
    shares = dealt.groupBy("dims", "route").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    shares = materialize(shares.withColumn("trees", F.ceil(F.col("n") / most).cast("int")).drop("n"), "shares")
    radius = {d: np.full(len(p), -np.inf) for d, p in routes.items()}
    for r in shares.filter(F.col("dims").isin([*routes])).collect():  # one row for each routing object
        radius[r.dims][r.route] = r.radius * (1 + 1e-9)
    queries = materialize(rows.filter(F.col("id") % every == 0).mapInArrow(bound, f"id long, key long, dims int, x {kind}, low double, routes array<int>"), "queries")
    parts = max(1, -(-queries.count() // QUERY_ROWS))
    # each tree meets the queries that may find something in it, in blocks
    left = dealt.join(shares, ["dims", "route"]).select("dims", "route", F.pmod(F.xxhash64("id", "key"), F.col("trees")).cast("int").alias("tree"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "key", "x")
    left = left.select(*(F.col(c).alias(c) for c in left.columns))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("id", "key"), F.lit(parts)).cast("int")).withColumn("route", F.explode("routes"))
    right = asked.join(shares, ["dims", "route"]).select(F.col("dims").alias("dims"), F.col("route").alias("route"), F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"), "part", "id", "key", "x", "low")

    def search(key: tuple, vs: pa.Table, qs: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int, str]] = []
        if len(vs) and len(qs):
            tree = MTree(integers(_matrix(vs.column("x")), scale), vs.column("id").to_numpy(), vs.column("key").to_numpy())
            back = top * scale / tree.scale if tree.x.dtype != object else 0.0
            for i, own, q, low in zip(qs.column("id").to_pylist(), qs.column("key").to_pylist(), _matrix(qs.column("x")), qs.column("low").to_pylist(), strict=True):
                floor = -np.inf if low is None or not 0 < back < 1e300 else low * back - MARGIN
                out += [(i, own, v, max(-LONG - 1, min(LONG, s)), order_text(s)) for s, v in tree.search(integers(q[None, :], scale)[0], k, floor, own)]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "query_key", "vec_id", "score", "more"), cols, types, strict=True)})

    keys = ["dims", "route", "tree", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, query_key long, vec_id long, score long, more string")
    rank = F.row_number().over(W.partitionBy("query_key").orderBy(F.desc("score"), F.desc("more"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scaled(x: np.ndarray, scale: int, top: float) -> np.ndarray:
    """The integers of ``x`` in units of ``scale`` times ``top``, the table's largest component; doubles, for bounds only."""
    small = np.abs(x) < 1 << 53
    return np.where(small, np.floor(np.where(small, x, 0.0) * scale) / scale, x) / top


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's ten best of each query over all ``embeddings``."""
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda y: floor(1024 * y)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
