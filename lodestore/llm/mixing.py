"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slots of the mixture map the points of a golden-ratio sequence through the cumulative target
weights, so that every stretch of slots has each source in its share. A source's documents, in
an order shuffled by a hash, are laid along its word axis, up to three times over; the axis is
cut into blocks of equally many words. The k-th slot of a source takes its k-th block, and a
source's words in the mixture end with its last slot.

Everything is DataFrame operations on (id, source, size); texts are never moved. No task holds a
whole source: prefix sums and slot ranks are taken within bounded buckets and shifted by the
buckets' totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.session import discard, materialize, read_table, scratch

WORD = r"[^\x20\x09-\x0D]+"
#: 2^32 / golden ratio, to the nearest odd number
GOLDEN = 2654435769
CHUNK = 1 << 16
GRID = 4096


def word_count(text: str | Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The shuffled order of documents. The text takes part, so that null and repeated ids are dealt too."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(text(id_col), F.lit("|"), F.md5(text(text_col))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """(sid, source, source_size, weight, target) for each source of ``sizes(source, size)``.

    Sources by code point, null last, get the weights in turn. Targets are weight shares of all
    words; none exceeds ``max_repeats`` times its source: the water level at which the capped
    sources and the weighted rest add up is found from running sums in order of cap by weight.
    The table has a row for each source, so its windows are over few rows.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("sid", (F.row_number().over(order) - 1).cast("int"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("sid", F.lit(len(weights))).cast("int") + 1).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * float(max_repeats)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = W.orderBy("ratio", "sid")
    everything = W.partitionBy()
    s = s.withColumn("_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_weights", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("_total", F.sum("source_size").over(everything) * float(share))
    s = s.withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_weights"))
    s = s.withColumn("_level", F.min(F.when(F.col("ratio") >= F.col("_level"), F.struct("ratio", "sid", "_level"))).over(everything)["_level"])
    return s.select("sid", "source", "source_size", "weight", F.least("cap", F.coalesce(F.col("_level") * F.col("weight"), F.col("cap"))).alias("target"))


def layout(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``sized(rid, id, source, size, key, tie)`` with sid, source_size, target and ``start``, the place of its first word on the source's axis."""
    d = sized.join(targets.drop("weight"), sized["source"].eqNullSafe(targets["source"]), "inner").drop(targets["source"])
    d = d.withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    sums = d.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    base = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = W.partitionBy("sid", "bucket").orderBy("key", "tie", "rid").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return d.join(base, ["sid", "bucket"]).withColumn("start", F.col("base") + F.col("inner")).drop("base", "inner", "bucket", "key", "tie")


def block_size(words: int) -> int:
    """Words of a block: so few that there are some 65,000 slots at least, since a source misses its target by a few blocks."""
    return min(4096, max(1, words // 65_536))


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """(slot, sid, block): which source's next block each slot of the mixture takes.

    There are as many slots as the targets together have blocks. A source gets its share of them
    up to the sequence's discrepancy, in every stretch of slots and in all.
    """
    spark = targets.sparkSession
    t = targets.filter("target > 0")
    t = t.withColumn("_upto", F.sum("target").over(W.orderBy("sid")) / F.sum("target").over(W.partitionBy()))
    t = t.withColumn("_from", F.coalesce(F.lag("_upto").over(W.orderBy("sid")), F.lit(0.0)))
    n = round((t.agg(F.sum("target")).first()[0] or 0) / block_words)
    cells = t.select("sid", "_from", "_upto", F.explode(F.sequence(F.floor(F.col("_from") * GRID).cast("int"), F.least(F.floor(F.col("_upto") * GRID), F.lit(GRID - 1)).cast("int"))).alias("cell"))
    slots = spark.range(n).select(F.col("id").alias("slot"), (F.pmod(F.pmod("id", F.lit(1 << 31)) * GOLDEN + F.lit(GOLDEN // 2), F.lit(1 << 32)) / float(1 << 32)).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * GRID).cast("int"))
    hit = slots.join(cells, "cell").filter("u >= _from AND u < _upto").select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    count = hit.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    past = count.select("sid", "chunk", F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("past"))
    ranked = hit.withColumn("rank", F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1)
    return ranked.join(past, ["sid", "chunk"]).select("slot", "sid", (F.col("past") + F.col("rank")).alias("block"))


def mix(docs: DataFrame, rid: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3, block_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(plan, pieces) of the mixture.

    plan: one row per document: rid, id, size, sid, source, source_size, target, start.
    pieces: slot, sid, block, rid, at, epoch, words: what each slot takes, in slot order.

    ``rid`` names a column that numbers the rows, if there is one. A null text has no words; such documents are in the plan and in no
    piece. A null source is a source of its own, the last one. Rows that repeat an id, null ones
    too, each count. Reruns give the same rows. A source ends where its slots end, or after
    ``max_repeats`` rounds.
    """
    sized = docs.select(
        (F.monotonically_increasing_id() if rid is None else F.col(rid)).alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"),
        shuffle_key(id_col, text_col).alias("key"), F.xxhash64(*(c for c in docs.columns if c != rid)).alias("tie"),
    )
    sized = materialize(sized, "sized")
    targets = materialize(source_targets(sized, weights, share, max_repeats), "targets")
    plan = materialize(layout(sized, targets), "layout")
    discard(sized)
    b = block_words or block_size(int(targets.agg(F.sum("target")).first()[0] or 0))
    slots = materialize(schedule(targets, b), "slots")
    ends = slots.groupBy("sid").agg((F.count("*") * b).alias("end"))
    p = plan.filter("size > 0").join(ends, "sid").select("sid", "rid", "size", "start", "source_size", "end", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("epoch"))
    p = p.withColumn("at", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn("upto", F.least(F.col("at") + F.col("size"), "end")).filter("upto > at")
    p = p.withColumn("block", F.explode(F.sequence(F.expr(f"at div {b}"), F.expr(f"(upto - 1) div {b}"))))
    p = p.withColumn("words", F.least("upto", (F.col("block") + 1) * b) - F.greatest("at", F.col("block") * b))
    return plan, p.join(slots, ["sid", "block"]).select("slot", "sid", "block", "rid", "at", "epoch", "words")


def taken_words(plan: DataFrame, pieces: DataFrame) -> DataFrame:
    """The plan's rows with ``taken``, the words of the document in the mixture, repeats counted, and ``first_slot``, where it first comes (null: nowhere)."""
    got = pieces.groupBy("rid").agg(F.sum("words").cast("long").alias("taken"), F.min("slot").alias("first_slot"))
    return plan.join(got, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def mixed_documents(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents of the mixture, with their columns, in the order of its slots: a row for each time that a document is taken.

    A document comes whole in the first slot that takes of it, also where the source's last slot
    cuts it. Documents without words (null texts too) are in no mixture. Rows that repeat an id
    are documents of their own. Partitions follow each other in slot order, and so do the rows of each.
    """
    # the row travels as one struct: its columns can't clash with ours; once written, its number stays
    number = "_".join(["rid", *docs.columns])
    with scratch("rows", "takes"):
        rows = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*docs.columns).alias("row")), "rows")
        _, pieces = mix(rows.select(F.col("rid").alias(number), "row.*"), number, text_col=text_col, **how)
        takes = pieces.groupBy("rid", "epoch").agg(F.min(F.struct("slot", "at")).alias("place"))
        takes = materialize(takes.select("rid", "place.*"), "takes")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.join(takes, "rid").repartitionByRange(n, "slot", "at").sortWithinPartitions("slot", "at")
    return out.select("row.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's words per document of the mixture of all ``documents``."""
    plan, pieces = mix(read_table(spark, f"{sf_dir}/documents.parquet"))
    return taken_words(plan, pieces).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, (1 + sid % 3)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / (1 + sid % 3) AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
v AS (SELECT level AS lv FROM l WHERE ratio >= level ORDER BY ratio, sid LIMIT 1),
t AS (SELECT sid, source, source_size, least(cap, coalesce((SELECT lv FROM v) * weight, cap)) AS target FROM l),
n AS (SELECT least(4096, greatest(1, CAST(floor(coalesce(sum(target), 0)) AS BIGINT) // 65536)) AS b, coalesce(sum(target), 0) AS total FROM t),
c AS (SELECT sid, coalesce(lag(upto) OVER (ORDER BY sid), 0) AS low, upto FROM (SELECT sid, sum(target) OVER (ORDER BY sid) / sum(target) OVER () AS upto FROM t WHERE target > 0)),
g AS (SELECT i AS slot, (((i % 2147483648) * 2654435769 + 1327217884) % 4294967296) / 4294967296.0::DOUBLE AS u
      FROM (SELECT unnest(range(CAST(round_even(total / b, 0) AS BIGINT))) AS i FROM n)),
r AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS block FROM g JOIN c ON u >= low AND u < upto),
e AS (SELECT sid, count(*) * (SELECT b FROM n) AS stop FROM r GROUP BY sid),
p AS (
  SELECT d.doc_id, d.size, t.sid, t.source_size, t.target, coalesce(e.stop, 0) AS stop,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN e ON e.sid = t.sid)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, stop - start)) + greatest(0, least(size, stop - start - source_size))
        + greatest(0, least(size, stop - start - 2 * source_size)))::BIGINT AS taken,
       (SELECT min(slot) FROM r WHERE r.sid = p.sid AND p.size > 0 AND r.block BETWEEN p.start // (SELECT b FROM n) AND (least(p.stop, p.start + p.size) - 1) // (SELECT b FROM n)) AS first_slot
FROM p
"""
