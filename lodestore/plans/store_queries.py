"""Maintenance, clustering and vector-store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.functions import vector as V
from lodestore.operators import classify as C
from lodestore.operators import maintain as M
from lodestore.plans import data as D

Q, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


FI = D.FINDINGS
NOW = 1_709_000_000


@query("stale_entries", f"WITH {FI} SELECT id, round(({NOW} - epoch) / 86400.0::DOUBLE, 4) AS age_days FROM findings WHERE ({NOW} - epoch) / 86400.0::DOUBLE > CASE staleness WHEN 'volatile' THEN 14 WHEN 'versioned' THEN 60 END")
def _(s, d):
    return M.stale(D.findings(s, d), NOW).select("id", F.round("age_days", 4).alias("age_days"))


K = "k AS (SELECT id, lower(trim(topic)) AS k FROM findings WHERE trim(topic) <> '')"


@query("topic_duplicates", f"WITH {FI}, {K}, g AS (SELECT k, min(id) AS first_id, count(*) AS n FROM k GROUP BY k HAVING count(*) > 1) SELECT id, first_id, n FROM k JOIN g USING (k)")
def _(s, d):
    return M.topic_duplicates(D.findings(s, d))


@query("topic_duplicate_pairs", f"WITH {FI}, {K} SELECT a.id AS id1, b.id AS id2, 1.0::DOUBLE AS similarity FROM k a JOIN k b ON a.k = b.k AND a.id < b.id")
def _(s, d):
    return M.topic_pairs(D.findings(s, d))


def _vecs(s, d):
    return D.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


PAIRS = "SELECT a.vec_id AS id1, b.vec_id AS id2, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"


@query("pairwise_similarity", f"SELECT * FROM ({PAIRS}) WHERE similarity > 0.35")
def _(s, d):
    return M.similar_pairs(_vecs(s, d), 0.35)


@query("embedding_duplicates", f"WITH {FI}, {K} SELECT * FROM ({PAIRS}) p WHERE similarity > 0.4 AND NOT EXISTS (SELECT 1 FROM k a JOIN k b USING (k) WHERE a.id = p.id1 AND b.id = p.id2)")
def _(s, d):
    topics = M.topic_duplicates(D.findings(s, d)).select("id", "first_id")
    pairs = M.similar_pairs(_vecs(s, d), 0.4)
    known = pairs.join(topics.select(F.col("id").alias("id1"), F.col("first_id").alias("f1")), "id1").join(topics.select(F.col("id").alias("id2"), F.col("first_id").alias("f2")), "id2").filter("f1 = f2").select("id1", "id2")
    return pairs.join(known, ["id1", "id2"], "left_anti")


@query("dedup_probe", f"WITH {FI}, t AS (SELECT id, lower(trim(topic)) AS t, tags, staleness FROM findings WHERE trim(topic) <> '') SELECT n.id AS new_id, min(s.id) AS id FROM t s JOIN t n ON s.tags = n.tags AND (contains(s.t, n.t) OR contains(n.t, s.t)) AND n.staleness = 'volatile' AND s.staleness <> 'volatile' GROUP BY n.id")
def _(s, d):
    f = D.findings(s, d)
    return M.dedup_probe(f.filter("staleness <> 'volatile'"), f.filter("staleness = 'volatile'"))


@query("missing_embeddings", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(s, d):
    return M.missing(D.findings(s, d).select("id"), _vecs(s, d))


@query("orphan_embeddings", "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    return M.orphans(_vecs(s, d).select("id"), D.table(s, d, "labels").select(F.col("doc_id").alias("id")))


@query("valid_embeddings", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def _(s, d):
    return M.valid_only(_vecs(s, d).select("id", "label"), D.table(s, d, "labels").select(F.col("doc_id").alias("id")))


@query("embedding_coverage", "SELECT source, count(*) AS total, count(vec_id) AS embedded, round(count(vec_id) / count(*)::DOUBLE * 1000) / 10 AS percent FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY source")
def _(s, d):
    return M.coverage(D.table(s, d, "documents").select(F.col("doc_id").alias("id"), "source"), _vecs(s, d), "source")


@query("tag_counts", f"WITH {FI} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM findings) GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def _(s, d):
    return M.tag_counts(D.findings(s, d))


CLUSTER = "fr AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM findings) GROUP BY tag), cl AS (SELECT id, CASE WHEN (SELECT n FROM fr WHERE tag = tags[2]) > (SELECT n FROM fr WHERE tag = tags[1]) THEN tags[2] ELSE tags[1] END AS cluster FROM findings)"


@query("tag_clusters", f"WITH {FI}, {CLUSTER} SELECT * FROM cl")
def _(s, d):
    return M.tag_clusters(D.findings(s, d))


@query("cluster_labels", f"WITH {FI}, {CLUSTER}, n AS (SELECT cluster, tag, count(*) AS n FROM (SELECT id, unnest(tags) AS tag FROM findings) JOIN cl USING (id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, tag) AS r FROM n) SELECT cluster, string_agg(tag, ', ' ORDER BY r) AS label FROM r WHERE r <= 3 GROUP BY cluster")
def _(s, d):
    f = D.findings(s, d)
    return M.cluster_labels(f, M.tag_clusters(f))


@query("attach_to_clusters", f"WITH {FI}, c AS (SELECT staleness AS cluster, tags FROM findings WHERE staleness <> 'volatile'), n AS (SELECT cluster, tag, count(*) AS n FROM (SELECT cluster, unnest(tags) AS tag FROM c) GROUP BY ALL), h AS (SELECT id, cluster, sum(n) AS n FROM (SELECT id, unnest(tags) AS tag FROM findings WHERE staleness = 'volatile') JOIN n USING (tag) GROUP BY ALL) SELECT id, arg_min(cluster, (-n, cluster)) AS cluster FROM h GROUP BY id")
def _(s, d):
    f = D.findings(s, d)
    return M.attach_to_clusters(f.filter("staleness = 'volatile'"), f.filter("staleness <> 'volatile'").withColumn("cluster", F.col("staleness")))


@query("tag_heatmap", "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source")
def _(s, d):
    f = D.findings(s, d).withColumn("source", F.get("tags", F.lit(1)))
    return M.heatmap(f, "source", ["en", "de", "fr"])


@query("tag_heatmap_top", f"WITH {FI}, t AS (SELECT tags[2] AS source, unnest(tags) AS tag FROM findings), top AS (SELECT tag FROM t GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 12) SELECT source, tag, count(*) AS n FROM t JOIN top USING (tag) GROUP BY source, tag")
def _(s, d):
    return M.top_heatmap(D.findings(s, d).withColumn("source", F.get("tags", F.lit(1))), "source")


@query("activity_timeline", f"WITH {FI}, b AS (SELECT strftime(make_timestamp(epoch * 1000000), '%Y-%m-%d') AS day, 1 AS r, 0 AS d FROM findings UNION ALL SELECT strftime(make_timestamp((1704067200 + item_id * 7200) * 1000000), '%Y-%m-%d'), 0, 1 FROM benchmark) SELECT day, sum(r)::BIGINT AS research, sum(d)::BIGINT AS decisions FROM b GROUP BY day")
def _(s, d):
    return M.activity(D.findings(s, d), D.table(s, d, "benchmark").select((F.lit(1704067200) + F.col("item_id") * 7200).alias("epoch")))


@query("primary_tags", f"WITH {FI} SELECT tags[1] AS tag, count(*) AS n, count(*) FILTER (staleness = 'stable') AS stable, count(*) FILTER (staleness = 'versioned') AS versioned, count(*) FILTER (staleness = 'volatile') AS volatile, ceil(sum(len(finding)) / 4.0)::BIGINT AS tokens FROM findings GROUP BY 1")
def _(s, d):
    return M.primary_tags(D.findings(s, d))


@query("store_tokens", "SELECT ceil(sum(len(text)) / 4.0)::BIGINT AS tokens FROM documents")
def _(s, d):
    return M.store_tokens(D.table(s, d, "documents"), "text")


CATS = "['tradeoff', 'architecture', 'zzz', 'testing', 'scope', 'convention'][item_id % 6 + 1]"


@query("grouped_decisions", f"SELECT CASE WHEN list_position(['architecture', 'convention', 'testing', 'scope', 'tradeoff', 'other'], {CATS}) > 0 THEN list_position(['architecture', 'convention', 'testing', 'scope', 'tradeoff', 'other'], {CATS}) ELSE 999 END::INTEGER AS ord, {CATS} AS category, item_id AS epoch, '- ' || text AS line FROM benchmark")
def _(s, d):
    cats = F.array(*map(F.lit, ("tradeoff", "architecture", "zzz", "testing", "scope", "convention")))
    b = D.table(s, d, "benchmark").select(F.element_at(cats, (F.col("item_id") % 6 + 1).cast("int")).alias("category"), F.col("item_id").alias("epoch"), F.col("text").alias("decision"))
    return M.grouped_decisions(b)


@query("staleness_page", f"WITH {FI} SELECT id, staleness FROM findings ORDER BY CASE staleness WHEN 'stable' THEN 0 WHEN 'versioned' THEN 1 ELSE 2 END, epoch DESC, id LIMIT 10 OFFSET 20")
def _(s, d):
    f = D.findings(s, d)
    return M.page(f, 2, 10, *M.newest_first(f)).select("id", "staleness")


@query("compaction_proposal", f"WITH {FI}, f AS (SELECT *, CASE WHEN id % 10 = 0 THEN id + 1 END AS supersedes FROM findings) SELECT id, reason FROM (SELECT id, CASE WHEN id IN (SELECT supersedes FROM f WHERE supersedes IS NOT NULL) THEN 'superseded' WHEN staleness = 'volatile' AND {NOW + 5_000_000} - epoch > 90 * 86400 THEN 'volatile' WHEN confidence < 0.5 AND {NOW + 5_000_000} - epoch > 60 * 86400 THEN 'unsure' END AS reason FROM f) WHERE reason IS NOT NULL")
def _(s, d):
    f = D.findings(s, d).withColumn("supersedes", F.when(F.col("id") % 10 == 0, F.col("id") + 1))
    return M.compaction(f, NOW + 5_000_000)


@query("upsert_nodes", "WITH n AS (SELECT 'p' || p_partkey AS qualified_name, 1 AS version, p_brand AS kind FROM part UNION ALL SELECT 'p' || p_partkey, 2, 'new' FROM part WHERE p_size > 25 UNION ALL SELECT 'q' || p_partkey, 2, 'new' FROM part WHERE p_size = 1) SELECT qualified_name, max(version) AS version, max_by(kind, version) AS kind FROM n GROUP BY 1")
def _(s, d):
    p = D.table(s, d, "part")
    row = lambda df, head, ver, kind: df.select(F.concat(F.lit(head), F.col("p_partkey").cast("string")).alias("qualified_name"), F.lit(ver).alias("version"), kind.alias("kind"))
    new = row(p.filter("p_size > 25"), "p", 2, F.lit("new")).unionByName(row(p.filter("p_size = 1"), "q", 2, F.lit("new")))
    return M.upsert(row(p, "p", 1, F.col("p_brand")), new, "qualified_name", "version")


@query("replace_by_file", "SELECT p_partkey AS id, 'f' || (p_partkey % 20) AS file_path FROM part WHERE p_partkey % 20 > 3 UNION ALL SELECT p_partkey + 1000000, 'f' || (p_partkey % 20) FROM part WHERE p_partkey % 20 <= 3 AND p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'f' || (p_partkey % 20) FROM part WHERE p_partkey % 20 IN (1, 3)")
def _(s, d):
    p = D.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("f"), (F.col("p_partkey") % 20).cast("string")).alias("file_path"))
    return M.replace_by_file(p, p.filter("id % 20 IN (0, 2)").withColumn("id", F.col("id") + 1000000))


@query("usage_bumps", f"WITH {FI} SELECT lower(trim(topic)) AS key, count(*) AS usage_count, max(epoch) AS last_used, min(id) AS first_id FROM findings GROUP BY 1")
def _(s, d):
    return M.bump(D.findings(s, d), M.topic_key(F.col("topic")))


SIG = "(" + " OR ".join(f"contains(lower(text), '{p}')" for p in M.SIGNALS) + ")"


@query("transcript_condense", f"SELECT conv_id, turn, CASE WHEN role = 'user' THEN '[USER] ' WHEN {SIG} THEN '[RESEARCH-CANDIDATE] ' ELSE '[ASSISTANT] ' END || trim(text, ' ') AS line FROM conversations WHERE role IN ('user', 'assistant') AND trim(text, ' ') <> '' AND (role = 'assistant' OR NOT (starts_with(trim(text), '/') OR starts_with(lower(trim(text)), '[system') OR starts_with(lower(trim(text)), 'system:') OR contains(text, '<system-reminder>')))")
def _(s, d):
    return M.condense(D.table(s, d, "conversations"))


@query("context_counts", "SELECT 'research' AS store, count(*) AS n FROM documents UNION ALL SELECT 'decisions', count(*) FROM benchmark UNION ALL SELECT 'events', count(*) FROM events")
def _(s, d):
    return M.context_counts({"research": D.findings(s, d), "decisions": D.table(s, d, "benchmark"), "events": D.table(s, d, "events")})


@query("undo_save", "SELECT doc_id AS id FROM documents WHERE doc_id <> 7")
def _(s, d):
    return M.undo({"research": D.findings(s, d)}, 7)["research"].select("id")


CENT = "c AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL), cv AS (SELECT label, list(m ORDER BY pos) AS vec FROM c GROUP BY label)"


@query("label_centroids", f"WITH {CENT} SELECT label, pos::INTEGER AS pos, round(m, 6) AS mean FROM c")
def _(s, d):
    return C.label_centroids(_vecs(s, d)).select("label", F.posexplode("vec").alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


@query("nearest_centroid", f"WITH {CENT}, s AS (SELECT vec_id, cv.label AS nearest, round(list_cosine_similarity(embedding::DOUBLE[], vec), 6) AS score FROM embeddings, cv) SELECT vec_id AS id, arg_max(nearest, (score, -nearest)) AS nearest, max(score) AS score FROM s GROUP BY vec_id")
def _(s, d):
    v = _vecs(s, d)
    return C.nearest_centroid(v, C.label_centroids(v))
