"""A table by key that batches change in place of being rewritten: hash buckets, copied when touched.

Rows lie in as many buckets as the table was made with, by a hash of their key. A batch reads and
writes only the buckets its keys fall into; the manifest then names the new files of these and the
old ones of all others. A reader keeps to the version it opened, and a batch that is applied again,
as after a failure, changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestore.session import discard, materialize
from lodestore.sources import manifest as M


class BucketTable:
    """The table at a shared folder. ``key``: its columns decide the bucket; null is a key like others. ``version`` None opens the newest."""

    def __init__(self, spark: SparkSession, root: str, key: Sequence[str], buckets: int = 64, version: int | None = None):
        self.spark, self.root, self.key = spark, root.rstrip("/"), list(key)
        self.version, self.state = M.load(spark, self.root, version)
        if not self.state:
            self.state = {"batch": -1, "buckets": buckets, "schema": None, "files": {}}
        self.buckets = self.state["buckets"]  # of a table that is there its own number counts

    def _rows(self, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(self.state["schema"])
        paths = [f"{self.root}/{p}" for b, p in self.state["files"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """All rows of this version."""
        if self.state["schema"] is None:
            raise ValueError(f"{self.root} holds no table yet")
        return self._rows()

    def files(self) -> dict[int, str]:
        """Where each bucket's rows lie."""
        return {int(b): p for b, p in self.state["files"].items()}

    def _same_key(self, other: str) -> F.Column:
        same = F.lit(True)
        for k in self.key:
            same = same & F.col(k).eqNullSafe(F.col(f"{other}{k}"))
        return same

    def _keys(self, df: DataFrame) -> DataFrame:
        return df.select(*(F.col(k).alias(f"_new_{k}") for k in self.key)).distinct()

    def _change(self, new: DataFrame, batch: int, merge: Callable[[DataFrame, DataFrame], DataFrame], schema: T.StructType | None) -> bool:
        if batch <= self.state["batch"]:
            return False
        new = materialize(new, "batch")
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("_bucket")
        touched = {r[0] for r in new.select(bucket).distinct().collect()}
        if self.state["schema"] is None:
            self.state = self.state | {"schema": (schema or new.schema).jsonValue()}
        columns = T.StructType.fromJson(self.state["schema"]).fieldNames()
        rows = merge(self._rows(touched), new).select(*columns).withColumn("_bucket", bucket)
        path = f"d-{uuid.uuid4().hex}"
        # dealt by bucket; a bucket beyond the advisory size goes to several tasks
        rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{path}")
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        names = [f.getPath().getName() for f in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)]
        files = {b: f for b, f in self.state["files"].items() if int(b) not in touched}
        files |= {n.removeprefix("_bucket="): f"{path}/{n}" for n in names if n.startswith("_bucket=")}
        state = self.state | {"batch": batch, "files": files}
        M.publish(self.spark, self.root, self.version + 1, state)
        self.version, self.state = self.version + 1, state
        discard(new)
        return True

    def _others(self, old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(self._keys(new), self._same_key("_new_"), "left_anti")

    def upsert(self, rows: DataFrame, batch: int, keep: Sequence[str] = (), order: str | None = None) -> bool:
        """Rows by key: new ones are added and replace old ones, of which the ``keep`` columns stay where they aren't null.

        Of rows that repeat a key in a batch the one with the greatest ``order``, then the greatest
        values by column, counts. False if the batch is applied already.
        """
        rest = [c for c in rows.columns if c not in self.key]
        first = [F.col(order).alias("_order")] if order else []
        one = rows.groupBy(*self.key).agg(F.max(F.struct(*first, *rest)).alias("_r")).select(*self.key, *(F.col("_r")[c].alias(c) for c in rest)).select(*rows.columns)

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            if keep:
                kept = old.select(*(F.col(k).alias(f"_old_{k}") for k in self.key), *(F.col(c).alias(f"_kept_{c}") for c in keep))
                put = new.join(kept, self._same_key("_old_"), "left")
                put = put.select(*(F.coalesce(f"_kept_{c}", c).alias(c) if c in keep else c for c in new.columns))
            else:
                put = new
            return self._others(old, new).unionByName(put)

        return self._change(one, batch, merge, rows.schema)

    def replace(self, rows: DataFrame, batch: int) -> bool:
        """All rows of each key that ``rows`` has are replaced by its rows, however many."""
        return self._change(rows, batch, lambda old, new: self._others(old, new).unionByName(new), rows.schema)

    def delete(self, keys: DataFrame, batch: int) -> bool:
        """The rows of these keys go."""
        if self.state["schema"] is None:
            raise ValueError(f"{self.root} holds no table yet")
        return self._change(keys.select(*self.key).distinct(), batch, self._others, None)

    def vacuum(self) -> list[str]:
        """Delete what no version but this one reads."""
        return M.sweep(self.spark, self.root, {p.split("/")[0] for p in self.state["files"].values()}, 1)


def follow(table: BucketTable, changes: DataFrame, checkpoint: str, how: Callable[[BucketTable, DataFrame, int], object] = lambda t, df, n: t.upsert(df, n)) -> None:
    """Apply a stream's batches to a table, each once, from where the checkpoint stopped."""
    changes.writeStream.foreachBatch(lambda df, n: how(table, df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
