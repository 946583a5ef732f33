"""Store maintenance: staleness, duplicates, pruning, clustering, compaction, upserts, transcripts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.functions.text import blank, is_system_message, script_skeleton

DAY = 86_400
#: days after which an entry of a class is stale
STALE_DAYS = {"volatile": 14, "versioned": 60}
# fixed values: phrases that tell of a finding
SIGNALS = (
    "i found that", "the documentation says", "this api returns", "testing shows", "according to", "the docs mention", "the error occurs because", "the root cause is", "this library requires", "the behavior is", "it turns out that", "the issue was",
)
CATEGORY_ORDER = ("architecture", "convention", "testing", "scope", "tradeoff", "other")


def stale(findings: DataFrame, now: int, limits: dict[str, int] = STALE_DAYS) -> DataFrame:
    """Findings older than their class allows, with ``age_days``; without a date they are infinitely old."""
    age = F.coalesce((F.lit(now) - F.col("epoch")) / float(DAY), F.lit(float("inf")))
    limit = F.lit(None).cast("double")
    for k, days in limits.items():
        limit = F.when(F.col("staleness") == k, float(days)).otherwise(limit)
    return findings.withColumn("age_days", age).filter(F.col("id").isNotNull() & (F.col("age_days") > limit))


def topic_key(topic: Column) -> Column:
    return F.lower(F.trim(blank(topic)))


def topic_duplicates(findings: DataFrame) -> DataFrame:
    """(id, first_id, n): entries that share a topic with others, with the smallest id of the group and its size.

    A class per topic instead of all its pairs: copies grow the table, not its square.
    """
    f = findings.select("id", topic_key(F.col("topic")).alias("k")).filter("id IS NOT NULL AND k <> ''")
    g = f.groupBy("k").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return f.join(g, "k").select("id", "first_id", "n")


def topic_pairs(findings: DataFrame) -> DataFrame:
    """(id1, id2, similarity): the pairs of one topic. For small stores; ``topic_duplicates`` carries the same in linear size."""
    f = findings.select("id", topic_key(F.col("topic")).alias("k")).filter("id IS NOT NULL AND k <> ''")
    return f.withColumnRenamed("id", "id1").join(f.withColumnRenamed("id", "id2"), "k").filter("id1 < id2").select("id1", "id2", F.lit(1.0).alias("similarity"))


#: rows of one side of a cell where all are compared with all
BLOCK_ROWS = 4096


def similar_pairs(vectors: DataFrame, min_cos: float, blocks: int | None = None) -> DataFrame:
    """(id1, id2, similarity) of all pairs with cosine above ``min_cos``, exactly; vectors of one length.

    The comparison of all with all is dealt by pairs of blocks, each pair of blocks once: a vector
    goes to ``blocks`` cells, and a cell is one matrix product in double precision. Blocks grow with
    the table, so that a side of a cell holds some ``BLOCK_ROWS`` rows. Null vectors and null ids
    take no part; a vector without length is similar to none. For thresholds of near-duplicates use
    the near-duplicate operators.
    """
    blocks = blocks or max(8, -(-vectors.count() // BLOCK_ROWS))
    v = vectors.filter("id IS NOT NULL AND vec IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("g"))
    cells = v.select("id", "vec", "g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c")).select("id", "vec", "g", F.least("g", "c").alias("i"), F.greatest("g", "c").alias("j"))
    low = min_cos - 1e-4  # similarities are rounded to four places

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        side = pdf["g"].to_numpy()
        x = np.array(pdf["vec"].tolist(), float).reshape(len(pdf), -1)
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        ids = pdf["id"].to_numpy(np.int64)
        a, b = (side == i), (side == j)
        found = []
        ia, ib, xa, xb = ids[a], ids[b], x[a], x[b]
        for at in range(0, len(ia), 1024):
            cos = xa[at : at + 1024] @ xb.T
            r, c = np.nonzero(cos > low)
            one = pd.DataFrame({"id1": ia[at + r], "id2": ib[c], "similarity": cos[r, c]})
            found.append(one[one["id1"] < one["id2"]] if i == j else one[one["id1"] != one["id2"]])
        out = pd.concat(found) if found else pd.DataFrame({"id1": [], "id2": [], "similarity": []})
        return pd.DataFrame({"id1": np.minimum(out["id1"], out["id2"]), "id2": np.maximum(out["id1"], out["id2"]), "similarity": out["similarity"]})

    pairs = cells.groupBy("i", "j").applyInPandas(compare, "id1 long, id2 long, similarity double")
    return pairs.withColumn("similarity", F.round("similarity", 4)).filter(F.col("similarity") > min_cos)


#: sizes of the pieces by which topics that hold one another are found
PIECES = (8, 3, 1)


def _tag_pairs(tags: Column) -> Column:
    """Two common tags: each pair of tags, in order."""
    own = F.array_sort(F.array_distinct(tags))
    return F.flatten(F.transform(own, lambda x: F.transform(F.filter(own, lambda y: y > x), lambda y: F.concat(x, F.lit("\x00"), y))))


def _like_topics(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (id, t, tags, ...) joined with rows (id2, t2, tags2, ...) where one topic holds the other and two tags or more are common.

    If t holds t2, a piece from the middle of t2 is a piece of t: one key of the shorter topic meets the keys
    of all pieces of the longer, each with a pair of tags. Only ids and hashed keys are
    shuffled, and only candidates are compared. Rows without an id are left out.
    """

    def key(id_col: str, t: Column, tags: Column, pieces: Column) -> list[Column]:
        return [F.col(id_col), F.explode(F.array_distinct(F.flatten(F.transform(_tag_pairs(tags), lambda p: F.transform(pieces, lambda x: F.xxhash64(p, x)))))).alias("key")]

    def holding(rows: DataFrame, id_col: str, t: Column, tags: Column) -> DataFrame:
        none = F.array().cast("array<string>")

        def pieces(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1)))
            return F.when(F.length(t) >= n, F.transform(starts, lambda i: t.substr(i, F.lit(n)))).otherwise(none)

        return rows.select(*key(id_col, t, tags, F.array_distinct(F.flatten(F.array(*map(pieces, PIECES))))))

    def held(rows: DataFrame, id_col: str, t: Column, tags: Column) -> DataFrame:
        size = F.coalesce(*(F.when(F.length(t) >= n, F.lit(n)) for n in PIECES))
        middle = F.floor((F.length(t) - size) / 2).cast("int") + 1
        return rows.select(*key(id_col, t, tags, F.array(t.substr(middle, size))))

    a, b = ("id", F.col("t"), F.col("tags")), ("id2", F.col("t2"), F.col("tags2"))
    near = holding(left, *a).join(held(right, *b), "key").select("id", "id2").unionByName(held(left, *a).join(holding(right, *b), "key").select("id", "id2")).distinct()
    both = near.join(left, "id").join(right, "id2")
    return both.filter("(contains(t, t2) OR contains(t2, t)) AND size(array_intersect(tags, tags2)) >= 2")


def dedup_probe(store: DataFrame, new: DataFrame) -> DataFrame:
    """(new_id, id): for each new entry the first stored one (by id) of a like topic, one within the other, and two common tags or more."""
    rows = lambda df: df.select("id", topic_key(F.col("topic")).alias("t"), F.transform("tags", F.lower).alias("tags")).filter("t <> ''")
    n = rows(new).select(F.col("id").alias("id2"), F.col("t").alias("t2"), F.col("tags").alias("tags2"))
    return _like_topics(rows(store), n).groupBy(F.col("id2").alias("new_id")).agg(F.min("id").alias("id"))


def missing(entries: DataFrame, have: DataFrame) -> DataFrame:
    """Entries without a row in ``have``."""
    return entries.join(have.select("id"), "id", "left_anti")


def orphans(have: DataFrame, entries: DataFrame) -> DataFrame:
    return have.join(entries.select("id"), "id", "left_anti")


def valid_only(have: DataFrame, entries: DataFrame) -> DataFrame:
    return have.join(entries.select("id"), "id", "left_semi")


def coverage(entries: DataFrame, have: DataFrame, project: str) -> DataFrame:
    """(project, total, embedded, percent) by project."""
    h = have.select("id").distinct().withColumn("_h", F.lit(True))
    g = entries.join(h, "id", "left").groupBy(project).agg(F.count("*").alias("total"), F.count("_h").alias("embedded"))
    return g.withColumn("percent", F.round(F.col("embedded") / F.col("total") * 1000) / 10)


def tag_counts(findings: DataFrame, n: int = 20) -> DataFrame:
    return findings.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(n)


def tag_clusters(findings: DataFrame) -> DataFrame:
    """(id, cluster): the entry's globally most frequent tag, the first on ties; uncategorized without tags."""
    t = findings.select("id", F.posexplode_outer("tags").alias("pos", "tag"))
    freq = t.filter("tag IS NOT NULL").groupBy("tag").agg(F.count("*").alias("freq"))
    best = t.join(freq, "tag", "left").groupBy("id").agg(F.max_by("tag", F.struct(F.coalesce("freq", F.lit(0)), -F.coalesce("pos", F.lit(0)))).alias("cluster"))
    return best.withColumn("cluster", F.coalesce("cluster", F.lit("uncategorized")))


def cluster_labels(findings: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, label): its three most frequent tags."""
    n = findings.select("id", F.explode("tags").alias("tag")).join(clusters, "id").groupBy("cluster", "tag").agg(F.count("*").alias("n"))
    r = n.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("n"), "tag"))).filter("r <= 3")
    return r.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]), ", ").alias("label"))


def attach_to_clusters(loose: DataFrame, clustered: DataFrame) -> DataFrame:
    """(id, cluster): each loose entry's cluster of greatest tag overlap (by rows of the clusters as given), the smallest name on ties."""
    tags = clustered.select("cluster", F.explode("tags").alias("tag")).groupBy("cluster", "tag").agg(F.count("*").alias("n"))
    hit = loose.select("id", F.explode(F.array_distinct("tags")).alias("tag")).join(tags, "tag").groupBy("id", "cluster").agg(F.sum("n").alias("n"))
    return hit.groupBy("id").agg(F.min_by("cluster", F.struct(-F.col("n"), "cluster")).alias("cluster"))


def heatmap(findings: DataFrame, project: str, tags: list[str]) -> DataFrame:
    """Counts by project, a column for each of the given tags."""
    f = findings.select(project, F.explode("tags").alias("tag"))
    return f.groupBy(project).agg(*(F.count_if(F.col("tag") == t).alias(t) for t in tags))


def top_heatmap(findings: DataFrame, project: str, n: int = 12) -> DataFrame:
    """(project, tag, n) for the most frequent tags of all findings; ties by name, no row where there are none."""
    f = findings.select(project, F.explode("tags").alias("tag"))
    return f.join(tag_counts(findings, n).select("tag"), "tag").groupBy(project, "tag").agg(F.count("*").alias("n"))


def activity(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """(day, research, decisions) from epochs."""
    day = F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd").alias("day")
    both = findings.select(day, F.lit(1).alias("r"), F.lit(0).alias("d")).unionByName(decisions.select(day, F.lit(0).alias("r"), F.lit(1).alias("d")))
    return both.groupBy("day").agg(F.sum("r").alias("research"), F.sum("d").alias("decisions"))


def primary_tags(findings: DataFrame) -> DataFrame:
    """(tag, n, stable, versioned, volatile, tokens) by first tag."""
    tag = F.coalesce(F.get("tags", F.lit(0)), F.lit("untagged")).alias("tag")
    return findings.groupBy(tag).agg(F.count("*").alias("n"), *(F.count_if(F.col("staleness") == s).alias(s) for s in ("stable", "versioned", "volatile")), F.ceil(F.sum(F.length("finding")) / 4).alias("tokens"))


def store_tokens(texts: DataFrame, col: str) -> DataFrame:
    return texts.agg(F.ceil(F.coalesce(F.sum(F.length(col)), F.lit(0)) / 4).alias("tokens"))


def grouped_decisions(decisions: DataFrame, order: tuple[str, ...] = CATEGORY_ORDER) -> DataFrame:
    """(ord, category, line): lines of decisions in the fixed order of categories, unknown ones last, by time inside."""
    pos = F.array_position(F.array(*map(F.lit, order)), F.col("category"))
    return decisions.select(F.when(pos > 0, pos).otherwise(999).cast("int").alias("ord"), "category", "epoch", F.concat(F.lit("- "), "decision").alias("line"))


def newest_first(findings: DataFrame) -> list[Column]:
    """Order by staleness class, then newest."""
    return [F.when(F.col("staleness") == "stable", 0).when(F.col("staleness") == "versioned", 1).otherwise(2), F.desc("epoch"), F.col("id")]


def page(rows: DataFrame, number: int, size: int, *order) -> DataFrame:
    return rows.orderBy(*order).offset(number * size).limit(size)


def compaction(findings: DataFrame, now: int) -> DataFrame:
    """(id, reason): superseded, volatile for over 90 days, or of low confidence for over 60."""
    old = lambda days: F.lit(now) - F.col("epoch") > days * DAY
    gone = findings.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("id")).distinct().withColumn("_gone", F.lit(True))
    f = findings.join(gone, "id", "left")
    reason = F.when(F.col("_gone"), "superseded").when((F.col("staleness") == "volatile") & old(90), "volatile").when((F.col("confidence") < 0.5) & old(60), "unsure")
    return f.select("id", reason.alias("reason")).filter("reason IS NOT NULL")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, of the highest version: an aggregation of structs, so nothing is ranked in a window."""
    every = old.unionByName(new)
    rest = [c for c in every.columns if c not in (key, version)]
    return every.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("s")).select(key, "s.*").select(every.columns)


def replace_by_file(old: DataFrame, new: DataFrame, file_col: str = "file_path") -> DataFrame:
    """All rows of the files in ``new`` give way to its rows."""
    return old.join(new.select(file_col).distinct(), file_col, "left_anti").select(old.columns).unionByName(new)


def bump(items: DataFrame, key: Column, ts: str = "epoch") -> DataFrame:
    """(key, usage_count, last_used, first_id): repeated saves counted."""
    return items.groupBy(key.alias("key")).agg(F.count("*").alias("usage_count"), F.max(ts).alias("last_used"), F.min("id").alias("first_id"))


def condense(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, line): a transcript's user and assistant messages, those that tell of a finding marked; system messages left out."""
    low = F.lower(blank(F.col("text")))
    signal = F.exists(F.array(*map(F.lit, SIGNALS)), lambda p: F.contains(low, p))
    t = turns.filter(F.col("role").isin("user", "assistant") & (F.trim(blank(F.col("text"))) != ""))
    t = t.filter((F.col("role") == "assistant") | ~is_system_message(F.col("text")))
    head = F.when(F.col("role") == "user", "[USER] ").when(signal, "[RESEARCH-CANDIDATE] ").otherwise("[ASSISTANT] ")
    return t.select("conv_id", "turn", F.concat(head, F.trim("text")).alias("line"))


def context_counts(stores: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in stores.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def undo(stores: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Every store without the rows of an id."""
    return {name: df.filter(F.col("id") != key) for name, df in stores.items()}


def fresh_index(findings: DataFrame, now: int, budget: int = 12_000, days: int = 7) -> DataFrame:
    """(id, line): lines of findings of the last days, newest first, until the next would exceed the budget.

    A line has at least five characters and its newline, so only so many newest findings can be in
    it: they are taken by a distributed top-k before their lengths are summed up.
    """
    badge = F.when(F.col("staleness") == "stable", "").otherwise(F.concat(F.lit(" ["), "staleness", F.lit("]")))
    line = F.concat(F.lit("- **"), F.coalesce("topic", F.lit("untitled")), F.lit("**"), badge, F.lit(": "), blank(F.col("finding")))
    near = findings.filter(F.col("epoch") >= now - days * DAY).select("id", "epoch", line.alias("line")).orderBy(F.desc("epoch"), "id").limit(budget // 6 + 1)
    w = W.orderBy(F.desc("epoch"), "id")
    used = F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = near.withColumn("over", (used + F.length("line") > budget).cast("int"))
    return cut.withColumn("past", F.max("over").over(w.rowsBetween(W.unboundedPreceding, 0))).filter("past = 0").select("id", "line")


def freshness(findings: DataFrame, now: int, days: int = 7) -> DataFrame:
    """One row: fresh and stale findings."""
    old = F.col("epoch") < now - days * DAY
    return findings.agg(F.count_if(~old).alias("fresh"), F.count_if(old).alias("stale"))


def overlapping_topics(findings: DataFrame) -> DataFrame:
    """(id, kept_id): findings of which the topic is part of a newer one's (or holds it), with two common tags or more; the newer one is kept."""
    f = findings.select("id", "topic", "tags", "epoch")
    pairs = dedup_probe_all(f)
    return pairs.groupBy("id").agg(F.max_by("kept_id", F.struct("kept_epoch", "kept_id")).alias("kept_id"))


def dedup_probe_all(findings: DataFrame) -> DataFrame:
    """(id, kept_id, kept_epoch): findings and the newer ones of a like topic."""
    f = findings.select("id", topic_key(F.col("topic")).alias("t"), F.transform("tags", F.lower).alias("tags"), "epoch").filter("t <> ''")
    newer = f.select(F.col("id").alias("id2"), F.col("t").alias("t2"), F.col("tags").alias("tags2"), F.col("epoch").alias("kept_epoch"))
    pairs = _like_topics(f, newer).filter("kept_epoch > epoch OR (kept_epoch = epoch AND id2 > id)")
    return pairs.select("id", F.col("id2").alias("kept_id"), "kept_epoch").distinct()


def matched_steps(steps: DataFrame, scripts: DataFrame) -> DataFrame:
    """(id, ord, command, script_id, name, template) of workflow steps (id, ord, command, description, template).

    A step becomes the first script (id, name, template) of its skeleton; where there is none it keeps
    its own template under its description. Scripts are reduced to one per skeleton before the join.
    """
    known = scripts.groupBy(script_skeleton(F.col("template")).alias("_skeleton")).agg(F.min_by(F.struct("id", "name", "template"), "id").alias("s"))
    named = steps.withColumn("_skeleton", script_skeleton(F.col("template"))).join(known, "_skeleton", "left")
    own = F.coalesce(F.nullif("description", F.lit("")), F.concat(F.lit("Step "), F.col("ord").cast("string")))
    return named.select("id", "ord", "command", F.col("s.id").alias("script_id"), F.coalesce("s.name", own).alias("name"), F.when(F.col("s").isNotNull(), F.col("s.template")).otherwise(F.col("template")).alias("template"))


def since_session(stores: dict[str, DataFrame], start: int) -> DataFrame:
    """(store, n): rows after the session's start."""
    out = None
    for name, df in stores.items():
        part = df.agg(F.count_if(F.col("epoch") > start).alias("n")).select(F.lit(name).alias("store"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def migrated_scripts(research: DataFrame, parameterize) -> tuple[DataFrame, DataFrame]:
    """(scripts, research without them): findings that hold scripts, parameterised, one per normalised template with its usage.

    ``parameterize``: a function from (id, command) to (id, template, parameters).
    """
    from lodestore.functions.text import is_reusable_script, normalize_template

    is_script = blank(F.col("topic")).startswith("Script:") | ((blank(F.col("source_tool")) == "auto-capture") & F.coalesce(F.array_contains("tags", "script"), F.lit(False)))
    f = blank(F.col("finding"))
    at = F.locate(": ", f)
    s = research.filter(is_script).select("id", "epoch", F.filter("tags", lambda t: ~t.isin("auto-capture", "script")).alias("tags"), F.when(at > 1, f.substr(at + 2, F.length(f))).otherwise(f).alias("command"), F.when(at > 1, f.substr(F.lit(1), at - 1)).otherwise(F.regexp_replace(blank(F.col("topic")), r"^Script:\s*", "")).alias("description"))
    s = s.filter((F.length("command") >= 10) & is_reusable_script(F.col("command")))
    t = s.join(parameterize(s.select("id", "command")), "id").withColumn("key", normalize_template(F.col("template")))
    one = t.groupBy("key").agg(F.min_by(F.struct("id", "description", "tags", "template", "parameters", "command"), F.struct("epoch", "id")).alias("s"), F.count("*").alias("usage_count"), F.max("epoch").alias("last_used"))
    return one.select("s.*", "usage_count", "last_used"), research.filter(~is_script)
