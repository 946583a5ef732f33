"""Vector quantization: seeded rotation, b-bit levels, a sign bit for the residual, packed bytes.

Per vector numpy work on Arrow batches; the rotation is a d x d matrix made from its seed on
each worker, so nothing is broadcast. Inner products of quantized vectors are taken in rotated
coordinates: a rotation changes no inner product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.session import python_path

#: what a residual sign bit adds
RESIDUAL = 0.05


@lru_cache(8)
def rotation(dim: int, seed: int | None = 42) -> np.ndarray:
    """Orthogonal matrix of a seed (None: the identity): normal deviates of a linear congruential generator, made orthonormal column by column.

    The generator's product is taken in double precision, as its published parameters are meant here.
    """
    if seed is None:
        return np.eye(dim)
    state = float(seed)

    def uniform() -> float:
        nonlocal state
        state = float(int(state * 1103515245.0 + 12345.0) & 0x7FFFFFFF)
        return state / 0x7FFFFFFF

    normal = np.empty(dim * dim, np.float32)
    for i in range(dim * dim):
        radius = math.sqrt(-2 * math.log(max(1e-6, uniform())))
        normal[i] = radius * math.cos(2 * math.pi * uniform())
    columns = normal.reshape(dim, dim).astype(np.float64)
    out = np.zeros((dim, dim))
    for j in range(dim):
        c = columns[:, j].copy()
        for k in range(j):
            c -= (c @ out[:, k]) * out[:, k]
        out[:, j] = c / math.sqrt(max(c @ c, 1e-10))
    return out


def levels(x: np.ndarray, bits: int) -> np.ndarray:
    top = (1 << bits) - 1
    return np.floor(np.clip((x + 1) / 2, 0, 1) * top + 0.5).astype(np.uint8)


def values(q: np.ndarray, bits: int) -> np.ndarray:
    return q / ((1 << bits) - 1) * 2 - 1


def pack(q: np.ndarray, bits: int) -> np.ndarray:
    """Rows of levels as bytes, most significant bit first."""
    planes = (q[..., None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(planes.reshape(len(q), -1), axis=1)


def unpack(raw: np.ndarray, bits: int, dim: int) -> np.ndarray:
    planes = np.unpackbits(raw, axis=1, count=dim * bits).reshape(len(raw), dim, bits)
    return (planes << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)


def encode(v: np.ndarray, bits: int, seed: int | None = 42, residual: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(packed levels, packed residual signs, least significant bit first) of unit vectors as rows."""
    x = v @ rotation(v.shape[1], seed).T
    q = levels(x, bits)
    signs = np.packbits(x >= values(q, bits), axis=1, bitorder="little") if residual else None
    return pack(q, bits), signs


def decode_rotated(raw: np.ndarray, signs: np.ndarray | None, bits: int, dim: int) -> np.ndarray:
    x = values(unpack(raw, bits, dim), bits)
    if signs is not None:
        x = x + np.where(np.unpackbits(signs, axis=1, count=dim, bitorder="little") == 1, RESIDUAL, -RESIDUAL)
    return x


def decode(raw: np.ndarray, signs: np.ndarray | None, bits: int, dim: int, seed: int | None = 42) -> np.ndarray:
    return decode_rotated(raw, signs, bits, dim) @ rotation(dim, seed)


def _check(bits: int) -> None:
    if bits not in range(2, 9):
        raise ValueError("bits: 2 to 8")


def quantize_vectors(vectors: DataFrame, bits: int = 3, seed: int | None = 42, residual: bool = True, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id, dim, bits, quantized, signs): packed vectors. Vectors of one dimension each; nulls are left out."""
    _check(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["vec"].map(len)):
                raw, signs = encode(np.stack(part["vec"].to_numpy()).astype(np.float64), bits, seed, residual)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "dim": dim, "bits": bits, "quantized": [r.tobytes() for r in raw], "signs": [s.tobytes() for s in signs] if residual else None})

    python_path(vectors.sparkSession)
    rows = vectors.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.mapInPandas(run, "id long, dim int, bits int, quantized binary, signs binary")


def _decoded(pdf: pd.DataFrame, bits: int, dim: int) -> np.ndarray:
    raw = np.stack([np.frombuffer(b, np.uint8) for b in pdf["quantized"]])
    signs = None if pdf["signs"].iloc[0] is None else np.stack([np.frombuffer(b, np.uint8) for b in pdf["signs"]])
    return decode_rotated(raw, signs, bits, dim)


def dequantize_vectors(packed: DataFrame, bits: int = 3, seed: int | None = 42) -> DataFrame:
    """(id, vec) again, approximately."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vec": list(_decoded(part, bits, dim) @ rotation(dim, seed))})

    python_path(packed.sparkSession)
    return packed.mapInPandas(run, "id long, vec array<double>")


#: rows of the table and queries that meet in one task
TABLE_ROWS, QUERY_ROWS = 16_384, 4096


def _best(table: DataFrame, queries: DataFrame, k: int, matrix, columns: list[str]) -> DataFrame:
    """(query_id, id, score, rank): the k best of the table for each query, itself left out; blocks of queries meet blocks of rows."""
    parts, asked = max(1, -(-table.count() // TABLE_ROWS)), max(1, -(-queries.count() // QUERY_ROWS))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = table.select(block(parts).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("j"), "id", *columns)
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i"), block(asked).alias("j"), F.col("id").alias("id"), *(F.col(c).alias(c) for c in columns))

    def meet(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "id": [], "score": []})]
        for dim in set(rows["dim"]) & set(asks["dim"]):
            r, q = rows[rows["dim"] == dim], asks[asks["dim"] == dim]
            ids, scores = r["id"].to_numpy(), np.round(matrix(q, dim) @ matrix(r, dim).T, 6)
            for qid, s in zip(q["id"], scores, strict=True):
                s = np.where(ids == qid, -np.inf, s)
                best = np.lexsort((ids, -s))[:k]
                best = best[np.isfinite(s[best])]
                out.append(pd.DataFrame({"query_id": qid, "id": ids[best], "score": s[best]}))
        return pd.concat(out).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    python_path(table.sparkSession)
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(meet, "query_id long, id long, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def similar_to(packed: DataFrame, queries: DataFrame, bits: int = 3, k: int = 10) -> DataFrame:
    """(query_id, rank, id, score): more like these (packed rows), by inner products of quantized vectors."""
    return _best(packed, queries, k, lambda pdf, dim: _decoded(pdf, bits, dim), ["dim", "quantized", "signs"])


def best_matches(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The same by the full vectors (id, vec)."""
    full = lambda df: df.select("id", F.size("vec").alias("dim"), F.col("vec").cast("array<double>").alias("vec"))
    return _best(full(vectors), full(queries), k, lambda pdf, dim: np.stack(pdf["vec"].to_numpy()), ["dim", "vec"])


def quality(full: DataFrame, approx: DataFrame, k: int = 3) -> DataFrame:
    """One row (n, recall): the share of each query's true best ``k`` (query_id, id, rank) that the approximate ones have."""
    a = full.filter(F.col("rank") <= k).select("query_id", "id")
    b = approx.filter(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit"))
    return a.join(b, ["query_id", "id"], "left").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))


def cache_stats(packed: DataFrame) -> DataFrame:
    """One row: vectors, bytes packed and full (32-bit), share saved."""
    p = packed.select((F.length("quantized") + F.coalesce(F.length("signs"), F.lit(0))).alias("b"), (F.col("dim") * 4).alias("f"))
    return p.agg(F.count("*").alias("vectors"), F.sum("b").alias("bytes"), F.sum("f").alias("full_bytes")).withColumn("saved_pct", F.round((1 - F.col("bytes") / F.col("full_bytes")) * 100, 1))


def similarity_correlation(vectors: DataFrame, bits: int = 3) -> DataFrame:
    """One row (pairs, pearson): full against quantized inner products of all pairs of vectors of one length.

    No pair is made: the sums over pairs of x, y, x², y² and xy are sums over vectors. With f and a
    the full and the quantized vectors, the sum of (f_i·f_j)(a_i·a_j) over all i, j is the sum of the
    squares of the matrix that adds up f_i a_i', and likewise for the others.
    """
    back = dequantize_vectors(quantize_vectors(vectors, bits), bits).withColumnRenamed("vec", "approx")
    v = vectors.select("id", F.col("vec").cast("array<double>").alias("full")).join(back, "id").select("full", "approx")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                f, a = np.array(pdf["full"].tolist(), float), np.array(pdf["approx"].tolist(), float)
                ff, aa = (f * f).sum(1), (a * a).sum(1)
                fa = (f * a).sum(1)
                own = np.array([len(f), ff.sum(), aa.sum(), (ff * ff).sum(), (aa * aa).sum(), (ff * aa).sum(), fa.sum()])
                one = np.concatenate([own, f.sum(0), a.sum(0), (f.T @ f).ravel(), (a.T @ a).ravel(), (f.T @ a).ravel()])
                total = one if total is None else total + one
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "x": total})

    parts = v.mapInPandas(sums, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").toPandas()["x"].to_numpy()
    if not len(parts) or parts[0] < 2:
        return vectors.sparkSession.createDataFrame([(0, None)], "pairs long, pearson double")
    n, ff, aa, ffff, aaaa, ffaa, _ = parts[:7]
    dim = (-2 + int(round((4 + 12 * (len(parts) - 7)) ** 0.5))) // 6  # 2 d + 3 d² numbers
    sf, sa = parts[7 : 7 + dim], parts[7 + dim : 7 + 2 * dim]
    gf, ga, gx = (parts[7 + 2 * dim + k * dim * dim :][: dim * dim] for k in range(3))
    pairs = n * (n - 1) / 2
    x, y = ((sf @ sf) - ff) / 2, ((sa @ sa) - aa) / 2
    xx, yy, xy = ((gf @ gf) - ffff) / 2, ((ga @ ga) - aaaa) / 2, ((gx @ gx) - ffaa) / 2
    bottom = (pairs * xx - x * x) * (pairs * yy - y * y)
    pearson = round(float((pairs * xy - x * y) / bottom**0.5), 4) if bottom > 0 else None
    return vectors.sparkSession.createDataFrame([(int(pairs), pearson)], "pairs long, pearson double")


def as_text(packed: DataFrame) -> DataFrame:
    """The bytes in base 64."""
    return packed.withColumn("quantized", F.base64("quantized")).withColumn("signs", F.base64("signs"))


def from_text(packed: DataFrame) -> DataFrame:
    return packed.withColumn("quantized", F.unbase64("quantized")).withColumn("signs", F.unbase64("signs"))
