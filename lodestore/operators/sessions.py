"""Session and tool-history analysis: windows per user, ordered by (ts, id).

Windows are partitioned by the history's owner and their frames are a few rows, so a task
streams through its owners. Nothing gathers an owner's whole history in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.functions import text as X

GAP_SECONDS = 90
MAX_CHAIN = 8


def _by(owner: str = "user_id", ts: str = "ts", seq: str = "event_id"):
    return W.partitionBy(owner).orderBy(ts, seq)


def rolling_last(history: DataFrame, keep: int = 50, owner: str = "user_id", ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """The newest ``keep`` rows of each owner."""
    w = W.partitionBy(owner).orderBy(F.desc(ts), F.desc(seq))
    return history.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= keep)


def retry_success(history: DataFrame, back: int = 10, min_overlap: float = 0.3, owner: str = "user_id", ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """Successes after a similar failure: among the ``back`` rows before, a failed command of the same first token and enough common tokens."""
    toks = X.tokens(F.lower(F.trim(F.col("command"))))
    h = history.withColumn("toks", toks)
    before = F.collect_list(F.when(~F.col("success") & (F.size("toks") > 0), F.col("toks"))).over(_by(owner, ts, seq).rowsBetween(-back, -1))
    h = h.withColumn("failed", before).filter(F.col("success") & (F.size("toks") > 0))
    overlap = lambda f: F.size(F.filter("toks", lambda t: F.array_contains(f, t))) / F.greatest(F.size(f), F.size("toks"))
    alike = F.exists("failed", lambda f: (F.get(f, F.lit(0)) == F.get(F.col("toks"), F.lit(0))) & (overlap(f) > min_overlap))
    return h.filter(alike).drop("toks", "failed")


def exploration_success(history: DataFrame, back: int = 5, needed: int = 3, owner: str = "user_id", ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """Exploratory successes with at least ``needed`` exploratory rows among the ``back`` before."""
    n = F.sum(F.col("exploratory").cast("int")).over(_by(owner, ts, seq).rowsBetween(-back, -1))
    return history.withColumn("explored", n).filter(F.col("exploratory") & F.col("success") & (F.col("explored") >= needed))


def gap_sessions(events: DataFrame, gap_seconds: int = GAP_SECONDS, owner: str = "user_id", ts: str = "ts") -> DataFrame:
    """(owner, started, ended, n): runs of events whose gaps don't exceed ``gap_seconds``; a gap of exactly that stays inside."""
    g = events.groupBy(owner, F.session_window(F.col(ts).cast("timestamp"), f"{gap_seconds} seconds").alias("_w"))
    return g.agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n")).drop("_w")


def chains(history: DataFrame, gap_seconds: int = GAP_SECONDS, longest: int = MAX_CHAIN, owner: str = "user_id", ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """(owner, seq, length, steps): for each non-trivial success the chain that it ends, if it has two steps.

    A chain goes back over non-trivial successes until a failure lies between, the gap between two
    steps exceeds ``gap_seconds``, or ``longest`` steps come before; trivial commands are passed over.
    """
    w = _by(owner, ts, seq)
    h = history.withColumn("fails", F.sum((~F.col("success")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    h = h.filter(F.col("success") & ~X.is_trivial(F.col("command")))
    gap = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(w)
    cut = F.coalesce((F.lag("fails").over(w) != F.col("fails")) | (gap > gap_seconds), F.lit(True))
    h = h.withColumn("cut", cut.cast("int")).withColumn("run", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    steps = F.collect_list(F.col(seq)).over(W.partitionBy(owner, "run").orderBy(ts, seq).rowsBetween(-longest, 0))
    return h.withColumn("steps", steps).filter(F.size("steps") >= 2).select(owner, seq, F.size("steps").cast("long").alias("length"), "steps")


def chain_overlap(a: DataFrame, b: DataFrame, min_overlap: float = 0.7) -> DataFrame:
    """(a_id, b_id, overlap) of chains (id, steps array<string>): steps of the shorter that the longer has at most one place away, over the longer's length.

    Chains meet on a common step near the same place, never all with all.
    """
    ea = a.select(F.col("id").alias("a_id"), F.size("steps").alias("na"), F.posexplode("steps").alias("i", "step"))
    eb = b.select(F.col("id").alias("b_id"), F.size("steps").alias("nb"), F.posexplode("steps").alias("j", "step"))
    eb = eb.withColumn("i", F.explode(F.array(F.col("j") - 1, F.col("j"), F.col("j") + 1)))
    hit = ea.join(eb, ["step", "i"])
    place = F.when(F.col("na") <= F.col("nb"), F.col("i")).otherwise(F.col("j"))
    out = hit.groupBy("a_id", "b_id").agg(F.count_distinct(place).alias("m"), F.first(F.greatest("na", "nb")).alias("n"))
    return out.select("a_id", "b_id", (F.col("m") / F.col("n")).alias("overlap")).filter(F.col("overlap") >= min_overlap)


def session_asof(entries: DataFrame, starts: DataFrame, owner: str = "user_id", ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """Entries with ``session_seq``, the latest start not after them (null before the first).

    One sort per owner over the union; starts come first among equal times.
    """
    both = entries.select("*", F.lit(None).cast("long").alias("_start"), F.lit(1).alias("_kind")).unionByName(
        starts.select("*", F.col(seq).cast("long").alias("_start"), F.lit(0).alias("_kind"))
    )
    w = W.partitionBy(owner).orderBy(ts, "_kind", seq).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("session_seq", F.last("_start", ignorenulls=True).over(w)).filter("_kind = 1").drop("_start", "_kind")


def next_bound(starts: DataFrame, owner: str = "user_id", ts: str = "ts", seq: str = "event_id") -> DataFrame:
    return starts.withColumn("until", F.lead(ts).over(_by(owner, ts, seq)))


def checkpoints(history: DataFrame, every: int = 40, owner: str = "user_id", ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """The rows at which an owner's running count reaches a multiple of ``every``."""
    return history.withColumn("calls", F.row_number().over(_by(owner, ts, seq)).cast("long")).filter(F.col("calls") % every == 0)


def budgeted(rows: DataFrame, length: str, budget: int, group: str, *order) -> DataFrame:
    """Rows of each group, in order, until the next would exceed the budget of characters (a newline each)."""
    w = W.partitionBy(group).orderBy(*order)
    used = F.coalesce(F.sum(F.col(length) + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    over = (used + F.col(length) > budget).cast("int")
    return rows.withColumn("_over", over).withColumn("_past", F.max("_over").over(w.rowsBetween(W.unboundedPreceding, 0))).filter("_past = 0").drop("_over", "_past")


def trigram_runs(texts: DataFrame, id_col: str, text_col: str, more_than: int = 5) -> DataFrame:
    """(id, run): texts in which one trigram of words repeats consecutively over ``more_than`` times.

    Consecutive equal trigrams mean one word repeated, so the longest run of equal words decides:
    r equal words make r - 2 equal trigrams. Runs are found within each text's own array.
    """
    toks = F.filter(F.split(F.lower(X.blank(F.col(text_col))), r"\s+"), lambda t: F.length(t) > 0)
    step = lambda acc, t: F.struct(t.alias("w"), F.when(t == acc["w"], acc["n"] + 1).otherwise(1).alias("n"), F.greatest(acc["best"], F.when(t == acc["w"], acc["n"] + 1).otherwise(1)).alias("best"))
    zero = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("best"))
    run = F.aggregate(toks, zero, step, lambda acc: acc["best"] - 2)
    long_enough = (F.length(X.blank(F.col(text_col))) >= 30) & (F.size(toks) >= 3 + more_than)
    return texts.select(F.col(id_col).alias("id"), F.when(long_enough, F.greatest(run, F.lit(0))).otherwise(0).cast("long").alias("run")).filter(F.col("run") > more_than)


def last_of_role(turns: DataFrame, role: str, conv: str = "conv_id") -> DataFrame:
    """(conv, text): the last message of a role in each conversation."""
    return turns.filter(F.col("role") == role).groupBy(conv).agg(F.max_by("text", "turn").alias("text"))


def candidates(chains_: DataFrame, suggested_at: int = 2, created: DataFrame | None = None) -> DataFrame:
    """(fingerprint, occurrences, status) of chains (fingerprint): candidate, suggested after so many occurrences, created if it is in ``created``."""
    n = chains_.groupBy("fingerprint").agg(F.count("*").alias("occurrences"))
    status = F.when(F.col("occurrences") >= suggested_at, "suggested").otherwise("candidate")
    if created is None:
        return n.withColumn("status", status)
    done = created.select("fingerprint").distinct().withColumn("_done", F.lit(True))
    return n.join(done, "fingerprint", "left").withColumn("status", F.when(F.col("_done"), "created").otherwise(status)).drop("_done")


def first_definitions(params: DataFrame, group: str, name: str = "name", ordinal: str = "ordinal") -> DataFrame:
    """The first row of each parameter name of a group."""
    rest = [c for c in params.columns if c not in (group, name)]
    return params.groupBy(group, name).agg(F.min_by(F.struct(*rest), ordinal).alias("s")).select(group, name, "s.*")
