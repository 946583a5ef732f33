"""Structured Streaming forms of the stateful operators.

Event time with watermarks bounds the state. Keyed automata (breakers, trackers, reminders,
checkpoints, frame reassembly) share one stateful processor that keeps a key's automaton as a
small JSON value. Outputs go to files in the shared folder, never to the driver's memory.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestore.operators.requests import Breaker
from lodestore.operators.sessions import gap_sessions
from lodestore.session import own_dir, python_path, shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    path = f"{folder}/{name}.parquet"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_append(stream: DataFrame) -> DataFrame:
    """Run over what is there, into Parquet; the result as a table."""
    spark = stream.sparkSession
    base = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    base = f"{own_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", base).trigger(availableNow=True).start().awaitTermination()


def run_complete(stream: DataFrame) -> DataFrame:
    """Run an aggregate over what is there; each batch rewrites the whole result, the last one is returned."""
    spark = stream.sparkSession
    path = f"{own_dir(spark)}/complete-{uuid.uuid4().hex}"
    run_batches(stream, lambda batch, n: batch.write.parquet(f"{path}/{n:08d}"), "complete")
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*")
    found = sorted(str(f.getPath()) for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))
    return spark.read.schema(stream.schema).parquet(found[-1]) if found else spark.createDataFrame([], stream.schema)


def sessions(events: DataFrame, gap_seconds: int = 90, late: str = "10 minutes", owner: str = "user_id", ts: str = "ts") -> DataFrame:
    """(owner, started, ended, n) of sessions, emitted once the watermark has passed them."""
    e = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    g = e.groupBy(F.session_window("_t", f"{gap_seconds} seconds").alias("w"), owner).agg(F.count("*").alias("n"))
    return g.select(owner, F.col("w.start").alias("started"), (F.col("w.end") - F.expr(f"INTERVAL {gap_seconds} SECONDS")).alias("ended"), "n")


def with_open_sessions(emitted: DataFrame, events: DataFrame, gap_seconds: int = 90, owner: str = "user_id", ts: str = "ts") -> DataFrame:
    """The sessions that a finished stream has emitted, and those still open at its end.

    Sessions leave an owner's state in time order, so what is open is made of the events after the
    owner's last emitted session.
    """
    last = emitted.groupBy(F.col(owner).alias("_owner")).agg(F.max("ended").alias("_last"))
    left = events.join(last, events[owner].eqNullSafe(last["_owner"]), "left").filter(F.col("_last").isNull() | (F.col(ts).cast("timestamp") > F.col("_last")))
    rest = gap_sessions(left.select(events.columns), gap_seconds, owner, ts)
    return emitted.unionByName(rest.select(owner, *(F.col(c).cast("timestamp").alias(c) for c in ("started", "ended")), "n"))


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day", ts: str = "ts") -> DataFrame:
    """One row per key within the watermark: one log row per request."""
    return events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")


def counters(events: DataFrame, *by: str) -> DataFrame:
    """Cumulative counts, for complete mode."""
    return events.groupBy(*by).agg(F.count("*").alias("n"))


def daily_upserts(events: DataFrame, path: str, aggregate: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], day: str = "date") -> None:
    """Keep a table by day at ``path`` up to date: each batch's days are merged with their old rows and only their partitions rewritten."""

    def handle(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = aggregate(batch)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            old = spark.read.parquet(path).select(new.columns).withColumn(day, F.col(day).cast(new.schema[day].dataType))
            new = merge(old.join(new.select(day).distinct(), day, "left_semi").select(new.columns).unionByName(new))
            new = new.checkpoint()
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)

    shared_dir(events.sparkSession)
    run_batches(events, handle)


def latest_per_key(events: DataFrame, handle: Callable[[DataFrame], None], key: str, order: str) -> None:
    """Debounced reprocessing: each batch hands on the last event of a key only."""

    def batch(df: DataFrame, _: int) -> None:
        rest = [c for c in df.columns if c != key]
        handle(df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("s")).select(key, "s.*"))

    run_batches(events, batch)


def tail(spark: SparkSession, path: str, schema, rebuild: Callable[[DataFrame], None], every: str = "500 milliseconds"):
    """A query that rebuilds an index whenever files arrive; the caller stops it."""
    stream = spark.readStream.schema(schema).json(path)
    base = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"
    return stream.writeStream.foreachBatch(lambda df, _: rebuild(df)).option("checkpointLocation", base).trigger(processingTime=every).start()


class _Fold(StatefulProcessor):
    """Runs an automaton along each key's rows, in order within a batch."""

    def __init__(self, start: str, step: Callable, order: list[str], key: str, columns: list[str]) -> None:
        self.begin, self.step, self.order, self.key, self.columns = start, step, order, key, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("automaton", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = json.loads(self.state.get()[0]) if self.state.exists() else json.loads(self.begin)
        out = []
        for row in pd.concat(list(rows)).sort_values(self.order).to_dict("records"):
            now, made = self.step(now, row)
            out += [{self.key: key[0], **m} for m in made]
        self.state.update((json.dumps(now),))
        if out:
            yield pd.DataFrame(out)[self.columns]

    def close(self) -> None:
        pass


def folded(events: DataFrame, key: str, order: list[str], start: dict, step: Callable, schema: str, ttl: str = "None") -> DataFrame:
    """Rows that an automaton makes along each key. ``step(state, row) -> (state, rows)``; state is a JSON value."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    python_path(spark)
    columns = [c.strip().split()[0] for c in schema.split(",")]
    return events.groupBy(key).transformWithStateInPandas(_Fold(json.dumps(start), step, order, key, columns), outputStructType=schema, outputMode="Append", timeMode=ttl)


def breaker_step(limit: int = 5, rest_ms: int = 30_000) -> Callable:
    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        b = Breaker(limit, rest_ms)
        b.state, b.failures, b.opened = state["state"], state["failures"], state["opened"]
        now, allowed = b.step(int(row["ts_ms"]), bool(row["ok"]))
        return {"state": b.state, "failures": b.failures, "opened": b.opened}, [{"seq": row["seq"], "state": now, "allowed": allowed}]

    return step


BREAKER_START = {"state": "CLOSED", "failures": 0, "opened": 0}


def breakers(calls: DataFrame, limit: int = 5, rest_ms: int = 30_000) -> DataFrame:
    """Circuit-breaker states along calls (provider, seq, ts_ms, ok)."""
    return folded(calls, "provider", ["ts_ms", "seq"], BREAKER_START, breaker_step(limit, rest_ms), "provider string, seq long, state string, allowed boolean")


def checkpoint_step(every: int = 40) -> Callable:
    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        n = state["calls"] + 1
        return {"calls": n}, [{"event_id": row["event_id"], "calls": n}] if n % every == 0 else []

    return step


def checkpoints(history: DataFrame, every: int = 40) -> DataFrame:
    return folded(history, "user_id", ["ts", "event_id"], {"calls": 0}, checkpoint_step(every), "user_id long, event_id long, calls long")


def tracker_step(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """Open tasks: created, completed and deleted ones, none below zero."""
    s = dict(state)
    if row["action"] == "create":
        s["created"] += 1
    elif row["action"] == "complete":
        s["completed"] += 1
    elif row["action"] == "delete":
        s["created"] = max(0, s["created"] - 1)
    return s, [{"seq": row["seq"], "open": max(0, s["created"] - s["completed"])}]


def task_trackers(actions: DataFrame) -> DataFrame:
    return folded(actions, "session", ["seq"], {"created": 0, "completed": 0}, tracker_step, "session string, seq long, open long")


def reminder_step(throttle_ms: int = 180_000, block_after: int = 2) -> Callable:
    """Reminders to save: at most one per throttle, counted, blocking beyond a number; a save starts anew."""

    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        if row["saved"]:
            return {"last": None, "count": 0}, []
        if state["last"] is not None and row["ts_ms"] - state["last"] < throttle_ms:
            return state, []
        n = state["count"] + 1
        return {"last": int(row["ts_ms"]), "count": n}, [{"seq": row["seq"], "reminders": n, "blocked": n > block_after}]

    return step


def reminders(events: DataFrame, throttle_ms: int = 180_000, block_after: int = 2) -> DataFrame:
    return folded(events, "session", ["ts_ms", "seq"], {"last": None, "count": 0}, reminder_step(throttle_ms, block_after), "session string, seq long, reminders long, blocked boolean")


def last_rows_step(keep: int = 50) -> Callable:
    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        ids = [*state["ids"], int(row["event_id"])][-keep:]
        return {"ids": ids}, [{"event_id": row["event_id"], "oldest_kept": ids[0], "kept": len(ids)}]

    return step


def rolling_last(history: DataFrame, keep: int = 50) -> DataFrame:
    """The ring of the last rows of each owner: with each row, the oldest that is still kept."""
    return folded(history, "user_id", ["ts", "event_id"], {"ids": []}, last_rows_step(keep), "user_id long, event_id long, oldest_kept long, kept long")


def cache_step(ttl_ms: int) -> Callable:
    """Exact cache of one tenant: an entry answers equal requests until its time is over."""

    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        seen = {h: t for h, t in state["seen"].items() if row["ts_ms"] - t[0] <= ttl_ms}
        hit = seen.get(row["hash"])
        seen[row["hash"]] = [int(row["ts_ms"]), int(row["id"])]
        return {"seen": seen}, [{"id": row["id"], "by": hit[1]}] if hit else []

    return step


def cache_hits(requests: DataFrame, ttl_ms: int = 86_400_000) -> DataFrame:
    """Keyed by tenant and hash together, so a key's state is one entry."""
    keyed = requests.withColumn("key", F.concat_ws("/", F.col("tenant").cast("string"), "hash"))
    return folded(keyed, "key", ["ts_ms", "id"], {"seen": {}}, cache_step(ttl_ms), "key string, id long, by long")


def frame_step(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """Chunks to whole frames: what follows the last blank line waits for the next chunk."""
    *whole, rest = (state["rest"] + row["chunk"]).replace("\r\n", "\n").split("\n\n")
    out = []
    for f in whole:
        data = "\n".join(x[5:].lstrip(" ") for x in f.split("\n") if x.startswith("data:"))
        if data:
            out.append({"n": state["n"] + len(out), "data": data})
    return {"rest": rest, "n": state["n"] + len(out)}, out


def frames(chunks: DataFrame) -> DataFrame:
    """Server-sent events (stream_id, n, data) of chunks (stream_id, seq, chunk), cut anywhere."""
    return folded(chunks, "stream_id", ["seq"], {"rest": "", "n": 0}, frame_step, "stream_id string, n long, data string")


def expired(entries: DataFrame, now: int, days: int = 30) -> DataFrame:
    """Rows to purge."""
    return entries.filter(F.lit(now) - F.col("epoch") > days * 86400)


def inactive(events: DataFrame, now: int, hours: int = 2, owner: str = "user_id", epoch: str = "epoch") -> DataFrame:
    """(owner, last) of owners without an event for some hours."""
    return events.groupBy(owner).agg(F.max(epoch).alias("last")).filter(F.lit(now) - F.col("last") > hours * 3600)
