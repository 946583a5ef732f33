"""Request-log analytics: dashboards, percentiles, histograms, rollups, exports, breakers and caches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.functions.text import blank, escape_label
from lodestore.functions.vector import cosine, percentage
from lodestore.session import python_path

LOCAL = ("ollama", "openai-local")
#: USD per million tokens that a local or cached answer saves
COST_PROMPT, COST_COMPLETION = 3.0, 15.0
BUCKETS = (10, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


def is_error(error: Column, strict: bool = False) -> Column:
    """Notes about a successful fallback are no errors, unless ``strict``."""
    return error.isNotNull() if strict else error.isNotNull() & ~error.startswith("note:")


def _measures(strict: bool = False) -> dict[str, Column]:
    local = F.col("provider").isin(*LOCAL)
    cloud = F.col("provider").isNotNull() & ~local & (F.col("provider") != "cache")
    hit = F.col("cache_hit").isNotNull()
    saves = hit | F.coalesce(local, F.lit(False))
    n = F.count("*")
    p = F.coalesce(F.sum(F.when(saves, F.coalesce("prompt_tokens", F.lit(0)))), F.lit(0)).cast("long")
    c = F.coalesce(F.sum(F.when(saves, F.coalesce("completion_tokens", F.lit(0)))), F.lit(0)).cast("long")
    return {
        "total": n, "local_pct": percentage(F.count_if(local), n), "cloud_pct": percentage(F.count_if(cloud), n),
        "fallback_pct": percentage(F.count_if(F.col("fallback") != 0), n), "cache_hit_pct": percentage(F.count_if(hit), n), "error_pct": percentage(F.count_if(is_error(F.col("error"), strict)), n),
        "est_tokens_saved": p + c, "est_cost_saved_usd": F.round((p * COST_PROMPT + c * COST_COMPLETION) / 1_000_000, 4),
    }


def dashboard(log: DataFrame, strict: bool = False) -> DataFrame:
    """One row of shares and savings."""
    return log.agg(*(c.alias(k) for k, c in _measures(strict).items()))


def daily_rollup(log: DataFrame, ts: str = "ts", strict: bool = False) -> DataFrame:
    """The same by day."""
    return log.groupBy(F.to_date(ts).alias("date")).agg(*(c.alias(k) for k, c in _measures(strict).items()))


def endpoint_breakdown(log: DataFrame) -> DataFrame:
    local = F.coalesce(F.col("provider").isin(*LOCAL), F.lit(False))
    cloud = F.col("provider").isNotNull() & ~local & (F.col("provider") != "cache")
    return log.groupBy(F.coalesce("endpoint", F.lit("(unknown)")).alias("endpoint")).agg(F.count("*").alias("count"), F.count_if(local).alias("local"), F.count_if(cloud).alias("cloud"), F.count_if(F.col("cache_hit").isNotNull()).alias("cache"))


def percentiles(log: DataFrame, value: str = "latency_ms", points: tuple[float, ...] = (0.5, 0.95, 0.99), by: tuple[str, ...] = ()) -> DataFrame:
    """The value at index floor(n * p) of the ascending values, exactly; nulls don't count.

    Values are first counted, so what is ranked is distinct values: running counts over them
    say which value covers an index. No list of all values is built.
    """
    c = log.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    c = c.withColumn("_upto", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(W.partitionBy(*by)))
    at = lambda p: F.least(F.floor(F.col("_all") * p), F.col("_all") - 1)
    aggs = [F.min(F.when(F.col("_upto") > at(p), F.col(value))).alias(f"p{round(p * 100)}") for p in points]
    return c.groupBy(*by).agg(*aggs) if by else c.agg(*aggs)


def histogram(log: DataFrame, value: str = "latency_ms", buckets: tuple[int, ...] = BUCKETS) -> DataFrame:
    """(le, ord, n): cumulative counts; one aggregation over the log, then a row per bucket."""
    v = F.col(value)
    aggs = [F.count_if(v <= b).alias(f"b{b}") for b in buckets]
    one = log.filter(v.isNotNull()).agg(*aggs, F.count("*").alias("binf"))
    rows = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.lit(i).alias("ord"), F.col(f"b{b}").alias("n")) for i, b in enumerate(buckets)), F.struct(F.lit("+Inf").alias("le"), F.lit(len(buckets)).alias("ord"), F.col("binf").alias("n")))
    return one.select(F.inline(rows))


def provider_model_counts(log: DataFrame, strict: bool = False) -> DataFrame:
    e = is_error(F.col("error"), strict)
    return log.groupBy("provider", "model").agg(F.count_if(~e).alias("ok"), F.count_if(e).alias("err"), F.count("*").alias("total"))


def ratios(log: DataFrame) -> DataFrame:
    hit, back = F.avg(F.col("cache_hit").isNotNull().cast("double")), F.avg((F.col("fallback") != 0).cast("double"))
    return log.agg(F.round(F.coalesce(hit, F.lit(0.0)), 4).alias("cache_hit_ratio"), F.round(F.coalesce(back, F.lit(0.0)), 4).alias("fallback_ratio"))


def metrics_text(log: DataFrame, prefix: str = "router", strict: bool = False) -> DataFrame:
    """(ord, line): the exposition format, a row per line, in order of ``ord`` and line."""
    label = lambda c: escape_label(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")))
    counts = provider_model_counts(log, strict).select(F.inline(F.array(*(F.struct(F.lit(1).alias("ord"), F.concat(F.lit(f'{prefix}_requests_total{{provider="'), label("provider"), F.lit('",model="'), label("model"), F.lit(f'",status="{s}"}} '), F.col(c).cast("string")).alias("line")) for s, c in (("ok", "ok"), ("error", "err"))))))
    r = ratios(log).select(F.inline(F.array(*(F.struct(F.lit(o).alias("ord"), F.concat(F.lit(f"{prefix}_{c} "), F.format_string("%.4f", F.col(c))).alias("line")) for o, c in ((2, "cache_hit_ratio"), (3, "fallback_ratio"))))))
    h = histogram(log).select((F.lit(4) + F.col("ord")).cast("int").alias("ord"), F.concat(F.lit(f'{prefix}_request_latency_ms_bucket{{le="'), "le", F.lit('"} '), F.col("n").cast("string")).alias("line"))
    t = log.filter("latency_ms IS NOT NULL").agg(F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("s"), F.count("*").alias("n"))
    t = t.select(F.inline(F.array(*(F.struct(F.lit(o).alias("ord"), F.concat(F.lit(f"{prefix}_request_latency_ms_{k} "), F.col(c).cast("string")).alias("line")) for o, k, c in ((40, "sum", "s"), (41, "count", "n"))))))
    return counts.unionByName(r).unionByName(h).unionByName(t)


# fixed values: tokens and seconds that an event of each kind saves, and the price of a thousand tokens
SAVINGS = (("session_load_decision", 10, 2), ("session_load_research", 20, 5), ("research_search_hit", 1000, 120), ("memory_check_hit", 500, 60), ("duplicate_save_avoided", 200, 30))
PRICE_PER_THOUSAND = 0.012


def savings(events: DataFrame, rates: DataFrame) -> DataFrame:
    """One row: tokens, seconds, hits and cost saved, from events (kind) and rates (kind, tokens, seconds); unknown kinds save nothing."""
    n = events.groupBy("kind").agg(F.count("*").alias("n")).join(rates, "kind")
    t = n.agg(F.coalesce(F.sum(F.col("n") * F.col("tokens")), F.lit(0)).alias("tokens_saved"), F.coalesce(F.sum(F.col("n") * F.col("seconds")), F.lit(0)).alias("seconds_saved"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))
    return t.withColumn("cost_saved", F.round(F.col("tokens_saved") / 1000.0 * PRICE_PER_THOUSAND, 4))


def recomputed_sessions(entries: DataFrame, starts: DataFrame, ts: str = "ts", checks: int = 2, hit_rate: float = 0.3) -> DataFrame:
    """One row: sessions (the larger of the distinct hours with entries and the starts, 1 at least), checks and hits."""
    hours = entries.agg(F.count_distinct(F.substring(F.date_format(ts, "yyyy-MM-dd HH"), 1, 13)).alias("hours"))
    s = hours.crossJoin(starts.agg(F.count("*").alias("starts")))  # one row each
    n = F.greatest("hours", "starts", F.lit(1))
    return s.select(n.alias("sessions"), (n * checks).alias("checks"), F.round(n * checks * hit_rate).cast("long").alias("hits"))


def lru_prune(cache: DataFrame, keep: int, key: str = "hash") -> DataFrame:
    """The ``keep`` rows with most hits, newest first among equals: a distributed top-k joined back, no window over all rows."""
    best = cache.orderBy(F.desc("hits"), F.desc("ts"), key).limit(keep).select(key)
    return cache.join(best, key, "left_semi")


def upsert_cache(cache: DataFrame, new: DataFrame, key: str = "hash") -> DataFrame:
    """New rows replace old ones of their key but keep the old hits."""
    old = cache.select(key, F.col("hits").alias("_hits"))
    put = new.drop("hits").join(old, key, "left").withColumn("hits", F.coalesce("_hits", F.lit(0)).cast(cache.schema["hits"].dataType)).drop("_hits")
    return cache.join(new.select(key), key, "left_anti").unionByName(put)


def cache_summary(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def log_rows(raw: DataFrame, fields: tuple[str, ...], max_error: int = 500) -> DataFrame:
    """The allowed fields only, the error cut short."""
    return raw.select(*(F.substring("error", 1, max_error).alias("error") if f == "error" else F.col(f) for f in fields))


SENSITIVE = r"(?i)^(?:authorization|x-api-key|cookie|proxy-authorization|x-auth-token|api-key)$"


def redact_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, _: ~k.rlike(SENSITIVE))


def request_hash(model: Column, messages: Column, auth: Column | None = None) -> Column:
    """Key of a request that has no more than a model and messages, under the caller's hashed credentials; ``body_hash`` takes whole requests."""
    who = F.lit("noauth") if auth is None else F.when(blank(auth) == "", "noauth").otherwise(F.substring(F.sha2(auth, 256), 1, 16))
    body = F.to_json(F.struct(messages.alias("messages"), model.alias("model")))
    return F.sha2(F.concat(who, F.lit("\n"), body), 256)


def cached_answers(requests: DataFrame, ttl_ms: int, min_cos: float = 0.92) -> DataFrame:
    """Requests (id, hash, tenant, ts_ms, vec) with the earlier request that answers them: hit ``exact`` or ``semantic``, and its id.

    Exact: the latest of the same hash within the time to live, by a running maximum along the
    hash's requests. Semantic: the latest of the tenant within it whose vector is near enough, a
    join on (tenant, time slot), a slot being one time to live, so a request meets its own slot
    and the one before.
    """
    slot = lambda c: F.floor(F.col(c) / ttl_ms)
    a = requests.select("id", "hash", "tenant", "ts_ms", "vec")
    b = requests.select(F.col("id").alias("b_id"), F.col("hash").alias("b_hash"), F.col("tenant").alias("b_tenant"), F.col("ts_ms").alias("b_ts"), F.col("vec").alias("b_vec"))
    within = (F.col("b_ts") < F.col("ts_ms")) & (F.col("ts_ms") - F.col("b_ts") <= ttl_ms)
    before = W.partitionBy("hash").orderBy("ts_ms").rangeBetween(W.unboundedPreceding, -1)
    exact = requests.filter("hash IS NOT NULL AND ts_ms IS NOT NULL").select("id", "ts_ms", F.max(F.struct("ts_ms", "id")).over(before).alias("m"))
    exact = exact.filter(F.col("ts_ms") - F.col("m.ts_ms") <= ttl_ms).select("id", F.lit("exact").alias("hit"), F.col("m.id").alias("by"))
    eb = b.withColumn("b_s", slot("b_ts"))
    rest = a.withColumn("s", F.explode(F.array(slot("ts_ms"), slot("ts_ms") - 1))).join(exact.select("id"), "id", "left_anti")
    sem = rest.join(eb, (F.col("tenant") == F.col("b_tenant")) & (F.col("s") == F.col("b_s"))).filter(within & (cosine(F.col("vec"), F.col("b_vec")) >= min_cos))
    sem = sem.groupBy("id").agg(F.max(F.struct("b_ts", "b_id")).alias("m")).select("id", F.lit("semantic").alias("hit"), F.col("m.b_id").alias("by"))
    return exact.unionByName(sem)


class Breaker:
    """Circuit breaker: opens after ``limit`` failures in a row, lets one probe through after ``rest_ms``."""

    def __init__(self, limit: int = 5, rest_ms: int = 30_000) -> None:
        self.limit, self.rest = limit, rest_ms
        self.state, self.failures, self.opened = "CLOSED", 0, 0

    def step(self, ts: int, ok: bool) -> tuple[str, bool]:
        """(state afterwards, whether the call was let through)."""
        if self.state == "OPEN":
            if ts - self.opened < self.rest:
                return self.state, False
            self.state = "HALF_OPEN"
        if ok:
            self.state, self.failures = "CLOSED", 0
        else:
            self.failures += 1
            if self.state == "HALF_OPEN" or self.failures >= self.limit:
                self.state, self.opened = "OPEN", ts
        return self.state, True


def breaker_states(calls: DataFrame, key: str = "provider", limit: int = 5, rest_ms: int = 30_000) -> DataFrame:
    """(key, seq, state, allowed) along each provider's calls (key, seq, ts_ms, ok).

    A state machine can't be a set expression. Rows are dealt by key and stretch of time, sorted
    within partitions, and streamed: memory holds one automaton, however many calls there are.

    A stretch starts with a time slot (of ``rest_ms``) that has calls but, like the slot before it,
    no failure: whatever came before, its first call is let through and closes the breaker, so
    stretches don't depend on each other. Only a provider that fails in every other slot is one stretch.
    Calls without a time are left out; without an outcome they failed.
    """
    slotted = calls.select(key, "seq", "ts_ms", F.coalesce("ok", F.lit(False)).alias("ok"), F.floor(F.col("ts_ms") / rest_ms).alias("slot"))
    slots = slotted.groupBy(key, "slot").agg(F.count_if(~F.col("ok")).alias("bad"))
    along = W.partitionBy(key).orderBy("slot")
    fresh = (F.col("bad") == 0) & ~((F.lag("slot").over(along) == F.col("slot") - 1) & (F.lag("bad").over(along) > 0))
    slots = slots.withColumn("fresh", F.coalesce(fresh, F.col("bad") == 0).cast("int"))
    slots = slots.select(F.col(key).alias("_key"), F.col("slot").alias("_slot"), F.sum("fresh").over(along.rowsBetween(W.unboundedPreceding, 0)).alias("stretch"))
    stretched = slotted.join(slots, slotted[key].eqNullSafe(slots["_key"]) & (slotted["slot"] == slots["_slot"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, b = None, Breaker(limit, rest_ms)
        for pdf in batches:
            out = []
            for k, part, ts, ok in zip(pdf[key], pdf["stretch"], pdf["ts_ms"], pdf["ok"], strict=True):
                if (k, part) != now:
                    now, b = (k, part), Breaker(limit, rest_ms)
                out.append(b.step(int(ts), bool(ok)))
            yield pd.DataFrame({key: pdf[key], "seq": pdf["seq"], "state": [s for s, _ in out], "allowed": [a for _, a in out]})

    python_path(calls.sparkSession)
    dealt = stretched.select(key, "stretch", "seq", "ts_ms", "ok").repartition(key, "stretch").sortWithinPartitions(key, "stretch", "ts_ms", "seq")
    return dealt.mapInPandas(run, f"{key} string, seq long, state string, allowed boolean")


VOLATILE = ("user", "stream")
CANONICAL = ("max_tokens", "messages", "model", "params", "stop", "stop_sequences", "system", "temperature", "tools", "top_k", "top_p")


def canonical_json(body: Column) -> Column:
    """The fields of a request that its answer depends on, in the order of their names; volatile ones are left out."""
    fields = [F.get_json_object(body, f"$.{name}") for name in CANONICAL]
    parts = F.array_compact(F.array(*(F.when(v.isNotNull(), F.concat(F.lit(f'"{n}":'), F.to_json(F.struct(v.alias("v"))))) for n, v in zip(CANONICAL, fields, strict=True))))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def body_hash(body: Column, auth: Column | None = None) -> Column:
    """Key of a whole request: its canonical JSON under the caller's hashed credentials. Requests that differ in any field the answer depends on have different keys."""
    who = F.lit("noauth") if auth is None else F.when(blank(auth) == "", "noauth").otherwise(F.substring(F.sha2(auth, 256), 1, 16))
    return F.sha2(F.concat(who, F.lit("\n"), canonical_json(body)), 256)
