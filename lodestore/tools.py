"""The public tools: functions over a store of DataFrames that return DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.operators import graph, maintain, search, snapshot


@dataclass
class Store:
    """Frames of a project; those that aren't there may be None.

    research: id, topic, tags, finding, entities, staleness, confidence, epoch, supersedes;
    decisions: id, category, decision, rationale, epoch; scripts: id, name, description, tags, template, usage_count;
    explorations: id, query, tags, files, entities; vectors: id, vec; triples: s, p, o, src;
    nodes and edges: the code graph; candidates: fingerprint, occurrences, status; calls: tool calls of the session.
    """

    research: DataFrame
    decisions: DataFrame
    scripts: DataFrame | None = None
    explorations: DataFrame | None = None
    vectors: DataFrame | None = None
    triples: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    candidates: DataFrame | None = None
    calls: DataFrame | None = None


def get_context(store: Store) -> DataFrame:
    """(store, n): how much there is of everything."""
    parts = {"research": store.research, "decisions": store.decisions, "scripts": store.scripts, "explorations": store.explorations, "nodes": store.nodes, "edges": store.edges}
    return maintain.context_counts({k: v for k, v in parts.items() if v is not None})


def _research_text(store: Store) -> DataFrame:
    r = store.research
    entities = F.col("entities") if "entities" in r.columns else F.lit(None).cast("array<string>")
    return r.select("id", search.searchable_research(F.col("topic"), F.col("tags"), F.col("finding"), entities).alias("text"))


def memory_search(store: Store, query: str, query_vector: Sequence[float] | None = None, limit: int = 10) -> DataFrame:
    """(kind, id, score, rank, sources): findings by both rankings fused, then decisions by text.

    Vectors of other stores are left out before the ranking, so the limit is met.
    """
    docs = _research_text(store)
    lists = {"bm25": search.top(search.bm25(docs, {0: query}).select("id", "score"), 20)}
    if query_vector is not None and store.vectors is not None:
        lists["embedding"] = search.top(search.cosine_scores(store.vectors.join(store.research.select("id"), "id", "left_semi"), query_vector), 20)
    hits = search.top(search.fuse(lists), limit).select(F.lit("research").alias("kind"), "id", "score", "rank", F.array_join("sources", "+").alias("sources"))
    d = store.decisions.select("id", search.searchable_decision(F.col("decision"), F.col("rationale"), F.col("category")).alias("text"))
    found = search.top(search.bm25(d, {0: query}).select("id", "score"), 3)
    return hits.unionByName(found.select(F.lit("decision").alias("kind"), "id", "score", "rank", F.lit("bm25").alias("sources")))


def memory_connections(store: Store, hits: DataFrame, depth: int = 2, limit: int = 10) -> DataFrame:
    """The graph around the entities of the findings among ``hits`` (kind, id); the few hits' entities are fetched to seed it."""
    seeds = [r.e for r in hits.filter("kind = 'research'").select("id").join(store.research, "id").select(F.explode("entities").alias("e")).distinct().orderBy("e").collect()]
    found = graph.k_hop(store.triples, seeds or [""], depth)
    return found.orderBy("hop", "entity", "target", "predicate", "src").limit(limit)


def script_search(store: Store, query: str, limit: int = 5) -> DataFrame:
    docs = store.scripts.select("id", search.searchable_script(F.col("name"), F.col("description"), F.col("tags")).alias("text"))
    return search.top(search.bm25(docs, {0: query}).select("id", "score"), limit).join(store.scripts, "id")


def exploration_search(store: Store, query: str, limit: int = 5) -> DataFrame:
    docs = store.explorations.select("id", search.searchable_exploration(F.col("query"), F.col("tags"), F.col("files"), F.col("entities")).alias("text"))
    return search.top(search.bm25(docs, {0: query}).select("id", "score"), limit).join(store.explorations, "id")


def memory_save(store: Store, new: DataFrame) -> DataFrame:
    """The findings with new ones, except those that a stored one covers (like topic, two common tags)."""
    known = maintain.dedup_probe(store.research, new).select(F.col("new_id").alias("id"))
    return store.research.unionByName(new.join(known, "id", "left_anti"), allowMissingColumns=True)


def session_summary(store: Store, unsaved: DataFrame) -> DataFrame:
    """One row: counts and whether saves are pending."""
    one = store.research.agg(F.count("*").alias("research")).crossJoin(store.decisions.agg(F.count("*").alias("decisions"))).crossJoin(unsaved.agg(F.count("*").alias("unsaved")))
    return one.withColumn("status", F.when(F.col("unsaved") > 0, "PENDING_SAVES").otherwise("CLEAN"))


def graph_context(store: Store, entity: str, depth: int = 2, limit: int = 20) -> DataFrame:
    return graph.k_hop(store.triples, [entity], depth).orderBy("hop", "entity", "target", "predicate", "src").limit(limit)


def code_search(store: Store, query: str, limit: int = 20) -> DataFrame:
    """Prefix search, or where it finds nothing, the text anywhere in a name."""
    found = search.prefix_search(store.nodes, query, ["name", "qualified_name", "file_path", "signature"], "qualified_name", limit)
    if found.isEmpty():
        found = search.like_search(store.nodes, query, ["name", "qualified_name"]).withColumn("hits", F.lit(0).cast("long")).limit(limit)
    return found


def code_context(store: Store, name: str) -> DataFrame:
    """Neighbours of the entity that a name resolves to, with a limit for each relation."""
    hit = search.resolve(store.nodes, name, ["name", "qualified_name", "file_path", "signature"]).select("qualified_name").first()
    limits = {"caller": 20, "callee": 20, "inheritor": 10, "test": 10, "member": 30}
    rows, out = graph.neighbours(store.nodes, store.edges, hit[0] if hit else name), None
    for relation, n in limits.items():
        part = rows.filter(F.col("relation") == relation).orderBy("qualified_name").limit(n)
        out = part if out is None else out.unionByName(part)
    return out


def code_impact(store: Store, name: str, depth: int = 2) -> DataFrame:
    hit = search.resolve(store.nodes, name, ["name", "qualified_name", "file_path", "signature"]).select("qualified_name").first()
    return graph.impact_radius(store.nodes, store.edges, hit[0] if hit else name, depth)


def code_structure(store: Store, target: str) -> DataFrame:
    """A file's members if the target is a file, else files and classes under it."""
    inside = graph.file_structure(store.nodes, target)
    if inside.isEmpty():
        return graph.module_hierarchy(store.nodes, target)
    return inside


def list_skills(store: Store) -> DataFrame:
    """(status, n) of workflow candidates."""
    return store.candidates.groupBy("status").agg(F.count("*").alias("n"))


def run_maintenance(store: Store, now: int, min_cos: float = 0.92) -> dict[str, DataFrame]:
    """What maintenance would do, task by task; nothing is written."""
    out = {"stale": maintain.stale(store.research, now), "duplicates": maintain.topic_duplicates(store.research)}
    if store.vectors is not None:
        out |= {"missing_vectors": maintain.missing(store.research.select("id"), store.vectors), "orphan_vectors": maintain.orphans(store.vectors.select("id"), store.research), "similar": maintain.similar_pairs(store.vectors, min_cos)}
    if store.triples is not None and "entities" in store.research.columns:
        out["kept_triples"] = graph.prune(store.triples, graph.entity_index(store.research).select("entity"))
    return out


def get_corpus_snapshot(store: Store, budget: int = 50_000) -> DataFrame:
    return snapshot.snapshot(store.research, maintain.tag_clusters(store.research), budget)
