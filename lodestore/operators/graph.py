"""Relationship graphs as edge frames: triples (s, p, o, src) and code edges (kind, source, target).

Traversals run level by level: a join of the frontier with the edges, and an anti-join with what
has been processed. The number of levels is the caller's; each level's frontier is written to
the shared folder, so the plan does not grow and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.session import materialize


def lowered(triples: DataFrame) -> DataFrame:
    return triples.withColumn("s", F.lower("s")).withColumn("o", F.lower("o")).withColumn("p", F.coalesce(F.nullif("p", F.lit("")), F.lit("related_to")))


def adjacency(triples: DataFrame) -> DataFrame:
    """(entity, predicate, target, src, direction): each triple seen from both its ends."""
    t = lowered(triples)
    ends = F.array(
        F.struct(F.col("s").alias("entity"), F.col("p").alias("predicate"), F.col("o").alias("target"), "src", F.lit("out").alias("direction")),
        F.struct(F.col("o").alias("entity"), F.col("p").alias("predicate"), F.col("s").alias("target"), "src", F.lit("in").alias("direction")),
    )
    return t.select(F.inline(ends))


def cached_adjacency(triples: DataFrame, path: str, version: str, buckets: int = 64) -> DataFrame:
    """The adjacency kept at ``path`` for this version of the triples, written if it isn't there; other versions are never read.

    It is dealt by entity, so a look-up of a few entities (``bucket_of``) reads their buckets only.
    """
    spark = triples.sparkSession
    folder = f"{path}/{version}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        dealt = adjacency(triples).withColumn("bucket", bucket_of(F.col("entity"), buckets))
        dealt.repartition("bucket", F.pmod(F.xxhash64("src"), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(folder)
    return spark.read.parquet(folder)


def bucket_of(entity: Column, buckets: int = 64) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int")


def k_hop(triples: DataFrame, seeds: list[str], depth: int = 2) -> DataFrame:
    """(hop, entity, predicate, target, src, direction): connections met within ``depth`` hops.

    Entities of a level are processed in ascending order. A connection counts if its target isn't
    processed before its entity: not in an earlier level, and greater within the same level.
    Multiple edges stay multiple; self-loops never count.
    """
    spark = triples.sparkSession
    adj = adjacency(triples)
    level = spark.range(1).select(F.explode(F.array(*(F.lit(s.lower()) for s in sorted(set(seeds))))).alias("entity"))
    done = level.limit(0)
    out = None
    for hop in range(1, depth + 1):
        met = adj.join(level, "entity").join(done.select(F.col("entity").alias("target")), "target", "left_anti")
        same = level.select(F.col("entity").alias("target"), F.lit(True).alias("_same"))
        met = met.join(same, "target", "left").filter(F.col("_same").isNull() | (F.col("target") > F.col("entity"))).drop("_same")
        met = materialize(met.select(F.lit(hop).alias("hop"), "entity", "predicate", "target", "src", "direction"), "hop")
        out = met if out is None else out.unionByName(met)
        done = done.unionByName(level)
        level = met.select(F.col("target").alias("entity")).distinct().join(done, "entity", "left_anti")
    return out


def reached(hops: DataFrame) -> DataFrame:
    """(target, hop): the entities that a traversal found, with the first hop."""
    return hops.groupBy("target").agg(F.min("hop").alias("hop"))


IMPACT_KINDS = ("CALLS", "IMPORTS", "INHERITS")


def impact_radius(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 2) -> DataFrame:
    """(qualified_name, hop, kind, file_path): what depends on ``start``, level by level; duplicates are kept.

    Edges run from user to used. Unknown nodes have kind Unknown. Tests of the start come at hop 0
    with kind Test, unless they were met.
    """
    spark = edges.sparkSession
    back = edges.filter(F.col("kind").isin(*IMPACT_KINDS)).select(F.col("target_qualified").alias("used"), F.col("source_qualified").alias("user"))
    level = spark.range(1).select(F.lit(start).alias("used"))
    done, out = level.limit(0), None
    for hop in range(1, depth + 1):
        done = done.unionByName(level)
        met = back.join(level, "used").join(done.select(F.col("used").alias("user")), "user", "left_anti")
        met = materialize(met.select(F.col("user").alias("qualified_name"), F.lit(hop).alias("hop")), "impact")
        out = met if out is None else out.unionByName(met)
        level = met.select(F.col("qualified_name").alias("used")).distinct().join(done, "used", "left_anti")
    info = nodes.select("qualified_name", "kind", "file_path")
    found = out.join(info, "qualified_name", "left").withColumn("kind", F.coalesce("kind", F.lit("Unknown")))
    tests = edges.filter((F.col("kind") == "TESTED_BY") & (F.col("source_qualified") == start)).select(F.col("target_qualified").alias("qualified_name")).join(out.select("qualified_name").distinct(), "qualified_name", "left_anti")
    tests = tests.join(info.drop("kind"), "qualified_name", "left").select("qualified_name", F.lit(0).alias("hop"), F.lit("Test").alias("kind"), "file_path")
    return found.select("qualified_name", "hop", "kind", "file_path").unionByName(tests)


def neighbours(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(relation, qualified_name, kind, file_path): callers, callees, inheritors, tests and members of an entity."""
    e = edges.select("kind", "source_qualified", "target_qualified")
    is_source, is_target = F.col("source_qualified") == name, F.col("target_qualified") == name
    rel = (
        F.when((F.col("kind") == "CALLS") & is_target, F.struct(F.lit("caller").alias("relation"), F.col("source_qualified").alias("qualified_name")))
        .when((F.col("kind") == "INHERITS") & is_target, F.struct(F.lit("inheritor").alias("relation"), F.col("source_qualified").alias("qualified_name")))
        .when((F.col("kind") == "TESTED_BY") & is_source, F.struct(F.lit("test").alias("relation"), F.col("target_qualified").alias("qualified_name")))
    )
    callee = F.when((F.col("kind") == "CALLS") & is_source, F.struct(F.lit("callee").alias("relation"), F.col("target_qualified").alias("qualified_name")))
    rows = e.filter(is_source | is_target).select(F.explode(F.array_compact(F.array(rel, callee))).alias("r")).select("r.*")
    info = nodes.select("qualified_name", F.col("kind"), "file_path")
    members = nodes.filter(F.col("parent_name") == name).select(F.lit("member").alias("relation"), "qualified_name", "kind", "file_path")
    return rows.join(info, "qualified_name", "left").select("relation", "qualified_name", "kind", "file_path").unionByName(members)


def class_hierarchy(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(relation, qualified_name): parents, children and members of a class."""
    e = edges.filter("kind = 'INHERITS'")
    up = e.filter(F.col("source_qualified") == name).select(F.lit("parent").alias("relation"), F.col("target_qualified").alias("qualified_name"))
    down = e.filter(F.col("target_qualified") == name).select(F.lit("child").alias("relation"), F.col("source_qualified").alias("qualified_name"))
    return up.unionByName(down).unionByName(nodes.filter(F.col("parent_name") == name).select(F.lit("member").alias("relation"), "qualified_name"))


def module_hierarchy(nodes: DataFrame, prefix: str) -> DataFrame:
    """(file_path, class_name): files under a path and their classes; the filter reaches the scan."""
    n = nodes.filter(F.col("file_path").startswith(prefix))
    return n.select("file_path", F.when(F.col("kind").isin("Class", "Interface"), F.col("qualified_name")).alias("class_name")).distinct()


def file_structure(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("file_path") == path).orderBy("line_start", "qualified_name")


def degrees(triples: DataFrame) -> DataFrame:
    """(entity, degree): the ends of triples that each entity is."""
    return adjacency(triples).groupBy("entity").agg(F.count("*").alias("degree"))


def average_degree(triples: DataFrame) -> DataFrame:
    """One row: entities, triples and 2T/E to one decimal."""
    d = degrees(triples).agg(F.count("*").alias("entities"), F.coalesce(F.sum("degree"), F.lit(0)).alias("ends"))
    return d.select("entities", (F.col("ends") / 2).cast("long").alias("triples"), F.when(F.col("entities") > 0, F.round(F.col("ends") / F.col("entities"), 1)).otherwise(0.0).alias("avg_degree"))


def top_subgraph(triples: DataFrame, n: int = 50) -> DataFrame:
    """Distinct (s, p, o), mentions left out, of which both ends are among the ``n`` entities of highest degree."""
    t = lowered(triples).filter("p <> 'mentions'")
    best = degrees(t).orderBy(F.desc("degree"), "entity").limit(n).select("entity")
    return t.join(best.withColumnRenamed("entity", "s"), "s", "left_semi").join(best.withColumnRenamed("entity", "o"), "o", "left_semi").select("s", "p", "o").distinct()


def timeline(triples: DataFrame, entries: DataFrame, entity: str) -> DataFrame:
    """Entries (id, epoch, ...) whose triples touch the entity, with their predicates."""
    e = entity.lower()
    t = lowered(triples).filter((F.col("s") == e) | (F.col("o") == e)).groupBy("src").agg(F.array_sort(F.collect_set("p")).alias("predicates"))
    return entries.join(t, entries["id"] == t["src"]).drop("src")


def prune(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples without those of which both ends are given and neither is a known entity."""
    known = entities.select(F.lower("entity").alias("entity")).distinct()
    t = triples.join(known.select(F.col("entity").alias("_s"), F.lit(True).alias("_ks")), F.lower("s") == F.col("_s"), "left").join(known.select(F.col("entity").alias("_o"), F.lit(True).alias("_ko")), F.lower("o") == F.col("_o"), "left")
    orphan = (F.coalesce("s", F.lit("")) != "") & (F.coalesce("o", F.lit("")) != "") & F.col("_ks").isNull() & F.col("_ko").isNull()
    return t.filter(~orphan).select(triples.columns)


def entity_index(entries: DataFrame) -> DataFrame:
    """(entity, id) from entries (id, entities array), lower-cased, trimmed, distinct."""
    e = entries.select("id", F.explode("entities").alias("e")).select(F.lower(F.trim("e")).alias("entity"), "id")
    return e.filter("entity <> ''").distinct()


def not_yet_extracted(entries: DataFrame, triples: DataFrame) -> DataFrame:
    """Entries of which no triple comes: what a backfill has to do, nothing the second time."""
    return entries.join(triples.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def changed_since(stores: dict[str, DataFrame], epoch: int) -> DataFrame:
    """(store, id, epoch) of rows after a time, over several stores."""
    out = None
    for name, df in stores.items():
        part = df.filter(F.col("epoch") > epoch).select(F.lit(name).alias("store"), F.col("id").cast("long").alias("id"), "epoch")
        out = part if out is None else out.unionByName(part)
    return out


def all_projects(graphs: dict[str, DataFrame]) -> DataFrame:
    """Triples of several projects, tagged with theirs."""
    out = None
    for name, df in graphs.items():
        part = lowered(df).withColumn("project", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def project_stats(triples: DataFrame) -> DataFrame:
    """(project, triples, entities)."""
    ends = triples.select("project", F.explode(F.array("s", "o")).alias("e")).groupBy("project").agg(F.count_distinct("e").alias("entities"))
    return triples.groupBy("project").agg(F.count("*").alias("triples")).join(ends, "project")
