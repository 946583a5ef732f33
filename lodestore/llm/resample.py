"""Importance resampling towards a target: hashed word runs weigh documents, noise keyed by the id draws them.

Each run of 1 to n words falls into one of ``buckets`` buckets. A bucket's gain says how much more
frequent it is in the target than in all documents; a document's weight is the mean gain of its
runs, and adding Gumbel noise to it and keeping the highest scores draws without replacement.

Texts of up to ``long_chars`` characters are weighed where they are read. Longer ones are cut at
word boundaries into chunks that are dealt to all tasks: a chunk owns ``chunk_words`` starting
positions and carries the n-1 words after them, so no run is lost or counted twice. Counts and
gains of chunks are summed by document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestore.llm.words import SQL_WORDS, words
from lodestore.session import materialize, read_table

CHUNK_WORDS, LONG_CHARS = 4_096, 1 << 16
#: scores of one band share a step of the ranking
BAND = 256


def runs(ws: Column, n: int, own: int | None = None) -> Column:
    """All runs of 1 to n words that start at the first ``own`` words (None: at any)."""
    size = F.size(ws)

    def of(k: int) -> Column:
        last = size - (k - 1) if own is None else F.least(size - (k - 1), F.lit(own))
        if k == 1:
            return ws if own is None else F.slice(ws, 1, own)
        at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(ws, i, k), " "))

    return of(1) if n == 1 else F.flatten(F.array(*(of(k) for k in range(1, n + 1))))


def _is_long(text: str, long_chars: int) -> Column:
    return F.coalesce(F.length(text) > long_chars, F.lit(False))


def short_texts(docs: DataFrame, text: str, long_chars: int, n: int) -> DataFrame:
    """The columns of ``docs`` with ``_words`` and ``_runs`` for texts that need no cutting, null and empty ones too."""
    return docs.filter(~_is_long(text, long_chars)).withColumn("_words", words(text)).drop(text).withColumn("_runs", runs(F.col("_words"), n))


def long_chunks(docs: DataFrame, text: str, long_chars: int, n: int, chunk_words: int) -> DataFrame:
    """One row per chunk of a long text, dealt to all tasks; rows of one text share ``_a`` and ``_b``, hashes of it."""
    long = docs.filter(_is_long(text, long_chars)).withColumn("_a", F.xxhash64(text)).withColumn("_b", F.hash(F.reverse(text)))
    long = long.withColumn("_words", words(text)).drop(text)
    last = F.greatest(F.ceil(F.size("_words") / chunk_words).cast("int"), F.lit(1)) - 1
    cut = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice("_words", c * chunk_words + 1, chunk_words + n - 1))
    keep = [c for c in long.columns if c != "_words"]
    return long.select(*keep, F.posexplode(cut).alias("_chunk", "_words")).repartition(*keep, "_chunk").withColumn("_runs", runs(F.col("_words"), n, chunk_words))


def bucket(run: Column, buckets: int) -> Column:
    return F.crc32(run) % buckets


def bucket_counts(docs: DataFrame, text: str, n: int, buckets: int, chunk_words: int, long_chars: int) -> DataFrame:
    """(bucket, n): runs of all texts by bucket, counted before the shuffle."""
    d = docs.select(text)
    all_runs = short_texts(d, text, long_chars, n).select("_runs").unionByName(long_chunks(d, text, long_chars, n, chunk_words).select("_runs"))
    return all_runs.select(F.explode("_runs").alias("run")).groupBy(bucket(F.col("run"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str, target_text: str, n: int, buckets: int, chunk_words: int, long_chars: int) -> list[int]:
    """Each bucket's gain. One number for each of ``buckets`` comes to the driver, whatever the corpus."""
    source = {r["bucket"]: r["n"] for r in bucket_counts(docs, text, n, buckets, chunk_words, long_chars).collect()}
    aim = {r["bucket"]: r["n"] for r in bucket_counts(target, target_text, n, buckets, chunk_words, long_chars).collect()}
    s_all, t_all = sum(source.values()), sum(aim.values())
    return [math.floor(1000 * math.log((aim.get(b, 0) + 1) * (s_all + buckets) / ((source.get(b, 0) + 1) * (t_all + buckets)))) for b in range(buckets)]


def weights(docs: DataFrame, gains: list[int], id_col: str, text: str, n: int, chunk_words: int, long_chars: int) -> DataFrame:
    """(id, n_words, n_features, weight) of every row; equal rows are each a row."""
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # folded to a constant of len(gains) numbers
    total = F.aggregate("_runs", F.lit(0).cast("long"), lambda acc, x: acc + F.get(table, bucket(x, len(gains)).cast("int")))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    sums = lambda df, own: df.select("*", F.size(own).cast("long").alias("n_words"), F.size("_runs").cast("long").alias("n_features"), total.alias("gain"))
    short = sums(short_texts(d, "text", long_chars, n), F.col("_words")).select("id", "n_words", "n_features", "gain")
    chunks = sums(long_chunks(d, "text", long_chars, n, chunk_words), F.slice("_words", 1, chunk_words))
    copies = F.count_if(F.col("_chunk") == 0)
    long = chunks.groupBy("id", "_a", "_b").agg(copies.alias("copies"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")))
    long = long.select("id", *(F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "gain")), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0))
    return short.unionByName(long).select("id", "n_words", "n_features", weight.cast("long").alias("weight"))


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise of a row's id in thousandths; a null id is written as an empty string."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def draw(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``rank`` for the floor(percent N / 100) highest scores of the N rows with ``min_words`` words or more, ties to smaller ids, null ids last; others have none.

    Ranks are counted without ordering all rows in one task: scores are counted by value, values are
    summed within bands and bands over each other (the span of scores bounds their number), and rows
    are numbered within their value.
    """
    fit = F.col("n_words") >= min_words
    n = scored.filter(fit).count() * percent // 100
    none = F.lit(None).cast("long")
    if n == 0:
        return scored.withColumn("rank", none)
    values = scored.filter(fit).groupBy("score").agg(F.count(F.lit(1)).alias("here")).withColumn("band", F.floor(F.col("score") / BAND))
    bands = values.groupBy("band").agg(F.sum("here").alias("in_band"))
    above = lambda col, w: F.coalesce(F.sum(col).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bands = bands.select("band", above("in_band", W.partitionBy(F.lit(0)).orderBy(F.desc("band"))).alias("bands_above"))
    before = values.join(bands, "band").select("score", (F.col("bands_above") + above("here", W.partitionBy("band").orderBy(F.desc("score")))).alias("before"))
    before = materialize(before.filter(F.col("before") < n), "before")
    least = before.agg(F.min("score")).first()[0]
    high = fit & (F.col("score") >= least)
    number = F.row_number().over(W.partitionBy("score").orderBy(F.asc_nulls_last("id")))
    top = scored.filter(high).join(before, "score").withColumn("rank", (F.col("before") + number).cast("long"))
    top = top.select(*scored.columns, F.when(F.col("rank") <= n, F.col("rank")).alias("rank"))
    return top.unionByName(scored.filter(~high).withColumn("rank", none))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024,
    chunk_words: int = CHUNK_WORDS, long_chars: int = LONG_CHARS,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of ``docs``.

    Null, empty and wordless texts have no features, weight 0 and are never drawn while ``min_words``
    is positive. Null ids share one noise and rank after others of their score; rows that repeat an id
    share its noise and are each a row. Other columns don't matter. An empty target gives gains by the
    corpus alone; empty ``docs`` give no rows. Results don't depend on ``chunk_words`` or ``long_chars``.
    """
    gains = bucket_gains(docs, target, text_col, target_text, n, buckets, chunk_words, long_chars)
    scored = materialize(weights(docs, gains, id_col, text_col, n, chunk_words, long_chars).withColumn("score", F.col("weight") + noise("id", seed)), "scored")
    return draw(scored, percent, min_words)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, weighed by the words of all ``benchmark`` texts.

    Null, empty and very long texts, ties, repeated rows and empty tables as in ``resample``.
    """
    drawn = resample(read_table(spark, f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: CRC-32 by bytes over a table that is derived bit by bit
OP13_SQL = f"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS} AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest({SQL_WORDS}) AS w FROM benchmark),
vocab AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
b AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
    lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) % 10000 AS b
  FROM vocab, crc),
s AS (SELECT b, count(*) AS n FROM dw JOIN b USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN b USING (w) GROUP BY b),
g AS (
  SELECT k.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * (coalesce((SELECT sum(n) FROM s), 0) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1) * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) k(b) LEFT JOIN s ON s.b = k.b LEFT JOIN t ON t.b = k.b),
f AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS gain FROM dw JOIN b USING (w) JOIN g ON g.b = b.b GROUP BY r),
h AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n > 0 THEN (gain - ((gain % n) + n) % n) // n ELSE 0 END::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN f USING (r)),
z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END::BIGINT AS "rank" FROM o
"""
