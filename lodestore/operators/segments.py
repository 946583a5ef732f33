"""A full-text index in segments that never change, for exact and prefix search by BM25.

A batch of changes becomes a segment: postings (term, id, tf, dl) dealt to files by ranges of the
term and sorted within them, the documents' lengths, and for each file the least and the greatest
term in it. A range of terms, be it one term or all with a prefix, thus names the few files that
can hold it. The ids of a batch are also written as tombstones: they hide what earlier segments
say of these documents, which is how documents are replaced and deleted. Segments of like size are
merged, so there are a few for each power of ``fanout``. A manifest lists segments and tombstones
and carries the corpus figures; a batch is in it as a whole or not at all, and one that is applied
again changes nothing.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.functions import text as X
from lodestore.operators.search import K1, B
from lodestore.session import discard, materialize
from lodestore.sources import manifest as M

#: no term that begins with a prefix is greater than the prefix and this
LAST = "\U0010ffff"


def name_tokens(name: Column) -> Column:
    """Tokens of names: runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(name), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def term_counts(toks: str) -> Column:
    """array<struct<term, tf>> of a sorted array of terms, within the row: where a run of equal ones begins, and how long it is."""
    at = F.filter(F.transform(toks, lambda t, i: F.when((i == 0) | (F.get(toks, i - 1) != t), i)), lambda i: i.isNotNull())
    end = F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(toks)))
    return F.zip_with(at, F.slice(end, 1, F.size(at)), lambda a, b: F.struct(F.get(toks, a).alias("term"), (b - a).alias("tf")))


class SegmentIndex:
    """The index at a shared folder. ``tokens`` makes an array of terms of a text; ``files``: how many files a segment's postings are dealt to (None: by size, as AQE finds)."""

    def __init__(self, spark: SparkSession, root: str, tokens: Callable[[Column], Column] = X.tokens, fanout: int = 4, files: int | None = None, version: int | None = None):
        self.spark, self.root, self.tokens, self.fanout, self.files = spark, root.rstrip("/"), tokens, fanout, files
        self.version, self.state = M.load(spark, self.root, version)
        if not self.state:
            self.state = {"batch": -1, "seq": 0, "segments": [], "tombs": [], "docs": 0, "length": 0}

    def apply(self, changes: DataFrame, batch: int) -> bool:
        """Apply changes (id, text, deleted[, at]); False if this batch, or a later one, is applied already.

        A change replaces the document of its id or, ``deleted``, removes it. Of several changes of an
        id the one with the greatest ``at`` counts, then a deletion, then the greatest text. Null ids
        are one document; null texts are empty documents, which count in the corpus figures.
        """
        if batch <= self.state["batch"]:
            return False
        one = changes
        if not changes.groupBy("id").count().filter("count > 1").isEmpty():  # else no text need be shuffled to find an id's last change
            one = self._last(changes)
        deleted = F.coalesce(F.col("deleted"), F.lit(False))
        toks = F.when(deleted, F.array().cast("array<string>")).otherwise(self.tokens(F.coalesce("text", F.lit(""))))
        counted = one.select("id", deleted.alias("deleted"), F.sort_array(toks).alias("toks"))
        changed = materialize(counted.select("id", "deleted", F.size("toks").alias("dl"), term_counts("toks").alias("terms")), "changes")
        removed = self.documents().join(changed.select(F.col("id").alias("_id")), F.col("id").eqNullSafe(F.col("_id")), "left_semi").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        seq, state = self.state["seq"] + 1, dict(self.state)
        put = changed.filter("NOT deleted")
        segment = self._write(put.select("id", "dl"), put.select("id", "dl", F.inline("terms")), seq)
        state["segments"] = [*state["segments"], segment] if segment["docs"] else state["segments"]
        if removed[0]:
            tomb = f"tomb-{uuid.uuid4().hex}"
            changed.select("id").write.parquet(f"{self.root}/{tomb}")
            state["tombs"] = [*state["tombs"], {"seq": seq, "path": tomb}]
        discard(changed)
        self._publish(state | {"batch": batch, "seq": seq, "docs": state["docs"] + segment["docs"] - removed[0], "length": state["length"] + segment["length"] - removed[1]})
        self._merge()
        return True

    @staticmethod
    def _last(changes: DataFrame) -> DataFrame:
        at = F.col("at") if "at" in changes.columns else F.lit(0)
        last = F.max(F.struct(at.alias("at"), F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce(F.col("text"), F.lit("")).alias("text"))).alias("c")
        return changes.groupBy("id").agg(last).select("id", "c.deleted", "c.text")

    def _write(self, docs: DataFrame, postings: DataFrame, seq: int) -> dict:
        """Write a segment's files; nobody reads them before they are published."""
        path = f"seg-{uuid.uuid4().hex}"
        base = f"{self.root}/{path}"
        docs.write.option("compression", "zstd").parquet(f"{base}/docs")
        by = [F.col("term"), F.col("id")]  # a term of very many documents is split by these
        dealt = postings.repartitionByRange(self.files, *by) if self.files else postings.repartitionByRange(*by)
        dealt.select("term", "id", "tf", "dl").sortWithinPartitions("term", "id").write.option("compression", "zstd").parquet(f"{base}/postings")
        terms = self.spark.read.schema(dealt.select("term").schema).parquet(f"{base}/postings")
        terms.groupBy(F.input_file_name().alias("file")).agg(F.min("term").alias("lo"), F.max("term").alias("hi")).write.parquet(f"{base}/ranges")
        n, length = self.spark.read.schema("id long, dl int").parquet(f"{base}/docs").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return {"seq": seq, "path": path, "docs": n, "length": length}

    def _publish(self, state: dict) -> None:
        M.publish(self.spark, self.root, self.version + 1, state)
        self.version, self.state = self.version + 1, state

    def _tier(self, segment: dict) -> int:
        return int(math.log(segment["docs"] + 1, self.fanout))

    def _merge(self) -> None:
        """Merge neighbouring segments as long as ``fanout`` of them are of one tier or below."""
        while True:
            segments = self.state["segments"]
            run: list[dict] = []
            for s in reversed(segments):  # the newest are the smallest
                if run and self._tier(s) > max(map(self._tier, run)):
                    break
                run.insert(0, s)
            if len(run) < self.fanout:
                return
            docs = self._live(self._docs(run))
            postings = self._live(self._postings([(s, f"{self.root}/{s['path']}/postings") for s in run]))
            merged = self._write(docs.select("id", "dl"), postings.select("term", "id", "tf", "dl"), run[-1]["seq"])
            left = [s for s in segments if s not in run] + ([merged] if merged["docs"] else [])
            left.sort(key=lambda s: s["seq"])
            tombs = [t for t in self.state["tombs"] if any(s["seq"] < t["seq"] for s in left)]
            self._publish(self.state | {"segments": left, "tombs": tombs})

    def _docs(self, segments: Sequence[dict]) -> DataFrame:
        parts = [self.spark.read.schema("id long, dl int").parquet(f"{self.root}/{s['path']}/docs").withColumn("seq", F.lit(s["seq"])) for s in segments]
        return reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], "id long, dl int, seq int")) if parts else self.spark.createDataFrame([], "id long, dl int, seq int")

    def _postings(self, files: Sequence[tuple[dict, str]]) -> DataFrame:
        schema = "term string, id long, tf int, dl int"
        paths: dict[int, list[str]] = {}
        for s, f in files:
            paths.setdefault(s["seq"], []).append(f)
        parts = [self.spark.read.schema(schema).parquet(*found).withColumn("seq", F.lit(seq)) for seq, found in sorted(paths.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema + ", seq int")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (id, seq, …) that no later tombstone hides."""
        if not self.state["tombs"]:
            return rows
        parts = [self.spark.read.schema("id long").parquet(f"{self.root}/{t['path']}").withColumn("gone", F.lit(t["seq"])) for t in self.state["tombs"]]
        gone = reduce(DataFrame.unionByName, parts).groupBy(F.col("id").alias("_id")).agg(F.max("gone").alias("gone"))
        return rows.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("gone") > F.col("seq")), "left_anti")

    def documents(self) -> DataFrame:
        """(id, dl, seq) of all documents."""
        return self._live(self._docs(self.state["segments"]))

    def files_of(self, bounds: Sequence[tuple[str, str]]) -> list[tuple[dict, str]]:
        """The files of postings that may hold a term within any of the bounds, by the segments' tables of ranges."""
        found = []
        touches = reduce(Column.__or__, (((F.col("hi") >= lo) & (F.col("lo") <= hi)) for lo, hi in bounds))
        for s in self.state["segments"]:
            ranges = self.spark.read.schema("file string, lo string, hi string").parquet(f"{self.root}/{s['path']}/ranges")
            found += [(s, r.file) for r in ranges.filter(touches).select("file").distinct().collect()]
        return found

    def matches(self, queries: dict[int, str], prefix: bool = False) -> DataFrame:
        """(qid, asked, mult, id, tf, dl): documents with a query's term or, ``prefix``, with terms that begin with it (tf counts them all)."""
        given = F.array(*(F.struct(F.lit(i).cast("int").alias("qid"), F.lit(q).alias("q")) for i, q in sorted(queries.items())))
        asked = self.spark.range(1).select(F.inline(given)).select("qid", F.explode(self.tokens(F.col("q"))).alias("asked")).groupBy("qid", "asked").agg(F.count("*").alias("mult"))
        terms = sorted({r.asked for r in asked.select("asked").distinct().collect()})
        if not terms:
            return asked.select("*", F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("tf"), F.lit(0).cast("long").alias("dl"))
        bounds = [(t, t + LAST if prefix else t) for t in terms]
        rows = self._postings(self.files_of(bounds))
        hit = (lambda t: F.startswith("term", F.lit(t))) if prefix else (lambda t: F.col("term") == t)
        rows = self._live(rows.filter(reduce(Column.__or__, map(hit, terms))))
        rows = rows.withColumn("asked", F.explode(F.filter(F.array(*map(F.lit, terms)), lambda t: F.startswith("term", t) if prefix else F.col("term") == t)))
        return rows.groupBy("asked", "id").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl")).join(asked, "asked")

    def bm25(self, queries: dict[int, str], prefix: bool = False, every: bool = False, k1: float = K1, b: float = B) -> DataFrame:
        """(qid, id, score) of documents with a query term or prefix; ``every``: with all of the query's."""
        hits = materialize(self.matches(queries, prefix), "hits")
        n, avgdl = self.state["docs"], self.state["length"] / max(1, self.state["docs"]) or 1.0
        df = hits.groupBy("qid", "asked").agg(F.count("*").alias("df"))  # a row per query term
        idf = F.greatest(F.lit(0.0), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
        part = F.col("mult") * idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
        scored = hits.join(df, ["qid", "asked"]).groupBy("qid", "id").agg(F.sum(part).alias("score"), F.count("*").alias("found"))
        if every:
            wanted = hits.sparkSession.createDataFrame([(i, len(set(ts))) for i, ts in self._asked(queries).items()], "qid int, wanted int")
            scored = scored.join(wanted, "qid").filter("found = wanted")
        return scored.select("qid", "id", "score")

    def _asked(self, queries: dict[int, str]) -> dict[int, list[str]]:
        given = self.spark.createDataFrame(sorted(queries.items()), "qid int, q string")
        return {r.qid: r.toks for r in given.select("qid", self.tokens(F.col("q")).alias("toks")).collect()}

    def vacuum(self) -> list[str]:
        """Delete what no version but this one reads."""
        return M.sweep(self.spark, self.root, {s["path"] for s in [*self.state["segments"], *self.state["tombs"]]}, 1)


def follow(index: SegmentIndex, changes: DataFrame, checkpoint: str) -> None:
    """Bring an index up to date with what a stream of changes has; the checkpoint tells where it stopped. A batch that is retried is applied once."""
    changes.writeStream.foreachBatch(lambda df, n: index.apply(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
