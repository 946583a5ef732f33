"""URL filters by a path-template tree, in DataFrame operations only.

Rules decide first; their verdicts also label the tree. Per host, paths form a tree of their
segments, of any depth. Digits are generalised to ``#``. At each node, children that are nearly
all different become one wildcard ``*``; else branches that don't differ from the rest of their
siblings, by two-proportion tests of their shares of labelled and of blocked URLs, merge into one
branch ``~``, and the others keep their names. Absence of evidence merges nothing: both sides need
``support`` URLs, and ``labels`` labelled ones if their node has any. A template is rejected if it
has labels and its blocked share, smoothed towards the share among all labelled URLs, reaches a
threshold.

URLs are counted per distinct generalised path before anything is joined, so a hot host weighs
no more than the number of its distinct paths. The tree is built from branching to branching: what
all paths below a node share, however many segments, is one step, and below a node with too few URLs
for any evidence everything keeps its name, so steps number the branchings that such a number of URLs
pass one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.session import discard, materialize

#: (host, path) prefix and whether it allows
RULES = (("com/", True), ("example.com/en/", False), ("www.example.com/en/", True), ("net/es/", False), ("net/fr/", False))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null and without ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, bool], ...] = RULES) -> Column:
    """The longest rule that fits, or null. A rule fits its host and all subdomains, if the path starts with the rule's."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = rule.partition("/")
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith("/" + p), F.lit(rule)).otherwise(out)
    return out


#: a child's (c) share of x among y is that of its siblings (p - c), as far as they tell
_LIKE = "abs({x}c / {y}c - ({x}p - {x}c) / ({y}p - {y}c)) <= {z} * sqrt(({x}p / {y}p) * (1 - {x}p / {y}p) * (1 / {y}c + 1 / ({y}p - {y}c)))"


def _name(t: str, min_children: int, min_support: float, support: int, labels: int, z: float) -> str:
    """SQL of a child's name in the tree, from sums n, lab, bad of the child (c) and of its node (p), and k, the node's children."""
    like = lambda x, y: _LIKE.format(x=x, y=y, z=z)
    known = f"labc >= {labels} AND labp - labc >= {labels} AND {like('bad', 'lab')}"
    return f"CASE WHEN k >= {min_children} AND np < {min_support} * k THEN '*' WHEN k > 1 AND nc >= {support} AND np - nc >= {support} AND {like('lab', 'n')} AND (labp = 0 OR ({known})) THEN '~' ELSE {t} END"


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, bool], ...] = RULES, min_children: int = 8, min_support: float = 3.0, support: int = 20, labels: int = 5, z: float = 1.96, smoothing: float = 8.0, reject: float = 0.8) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) for every row.

    purity is null for URLs without a host. A template without labelled URLs is never rejected.
    Null, empty and other URLs without ``://`` have neither template nor purity and are allowed. Empty
    tables give no rows; repeated rows each count and each have a row; null ids stay null; other columns
    don't matter. ``min_children`` is 2 at least: an only child keeps its name.
    """
    if min_children < 2:
        raise ValueError("an only child keeps its name: min_children is 2 at least")
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col).cast("string"))
    u = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    u = u.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    u = materialize(u.withColumn("segs", F.transform(segs, lambda s: F.regexp_replace(s, "[0-9]+", "#"))), "urls")
    key, sums = ["host", "segs"], ["n", "lab", "bad"]
    blocks = [r for r, allow in rules if not allow]
    paths = u.filter("host <> ''").groupBy(*key).agg(F.count("*").alias("n"), F.count("rule").alias("lab"), F.count_if(F.col("rule").isin(blocks)).alias("bad"))
    paths = materialize(paths, "paths")
    prior = paths.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("lab"), F.lit(0)) + 2.0)).alias("p")).first().p
    live, done = materialize(paths.withColumn("g", F.lit("")).withColumn("d", F.lit(0)), "level"), None
    rest = lambda upto: F.array_join(F.transform(F.slice("segs", F.col("d") + 1, F.greatest(upto - F.col("d"), F.lit(0))), lambda s: F.concat(F.lit("/"), s)), "")
    own = F.slice("segs", F.col("d") + 1, F.greatest(F.size("segs") - F.col("d"), F.lit(0)))
    ref = F.slice("ref", F.col("d") + 1, F.greatest(F.size("ref") - F.col("d"), F.lit(0)))
    differs = F.array_position(F.zip_with(own, ref, lambda x, y: x == y), F.lit(False))  # from 1; 0 for none
    while not live.isEmpty():
        # where a node's paths part: until then each has the name of its segment, as has all of a node with too few URLs for evidence
        node = live.groupBy("host", "g").agg(F.sum("n").alias("here"), F.max(F.struct(F.size("segs").alias("size"), "segs"))["segs"].alias("ref"))
        parts = live.join(node.filter(F.col("here") >= min(min_children, 2 * support)), ["host", "g"]).groupBy("host", "g").agg(F.min(F.when(differs > 0, F.col("d") + differs - 1)).cast("int").alias("b"))
        at = live.join(parts, ["host", "g"], "left").withColumn("g", F.concat("g", rest(F.coalesce("b", F.size("segs"))))).withColumn("t", F.when(F.size("segs") > F.col("b"), F.get("segs", F.col("b"))))
        at = materialize(at, "level")
        part = at.filter("t IS NULL").select(*key, *sums, "g")
        if done is None:
            done = materialize(part, "paths")
        else:
            part.write.mode("append").parquet(done._lodestore_path)
        child = at.filter("t IS NOT NULL").groupBy("host", "g", "t").agg(*(F.sum(c).cast("double").alias(f"{c}c") for c in sums))
        pool = child.groupBy("host", "g").agg(F.count("*").alias("k"), *(F.sum(f"{c}c").alias(f"{c}p") for c in sums))
        named = child.join(pool, ["host", "g"]).select("host", "g", "t", F.expr(_name("t", min_children, min_support, support, labels, z)).alias("name"))
        level = at.join(named, ["host", "g", "t"]).select(*key, *sums, F.concat("g", F.lit("/"), "name").alias("g"), (F.col("b") + 1).alias("d"))
        before, live = live, materialize(level, "level")
        discard(before)
        discard(at)
    done = paths.withColumn("g", F.lit("")) if done is None else spark.read.schema(done.schema).parquet(done._lodestore_path)
    tree = materialize(done.select(*key, *sums, F.concat("host", F.lit("/"), F.substring("g", 2, 1 << 30)).alias("template")), "tree")
    score = tree.groupBy("template").agg(F.sum("lab").alias("tlab"), F.sum("bad").alias("tbad"))
    score = score.select("template", "tlab", ((F.col("tbad") + F.lit(smoothing) * F.lit(prior)) / (F.col("tlab") + F.lit(smoothing))).alias("p"))
    found = u.join(tree.select(*key, "template").join(score, "template"), key, "left")
    allow = [r for r, a in rules if a]
    verdict = F.when(F.col("rule").isin(allow), "allow").when(F.col("rule").isNotNull(), "block").when((F.col("tlab") > 0) & (F.col("p") >= reject), "block").otherwise("allow")
    return found.select("id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("p", 6).alias("purity"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's verdicts on all ``pages``."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")


OP2_SQL = f"""
WITH RECURSIVE a AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
b AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
         list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '[0-9]+', '#', 'g')) AS segs FROM a),
n0 AS (SELECT host, segs, count(*) AS n, count(rule) AS lab, count(*) FILTER (rule IN ('example.com/en/', 'net/es/', 'net/fr/')) AS bad FROM b WHERE host <> '' GROUP BY ALL),
w AS (
  SELECT host, segs, 0 AS d, '' AS g, n, lab, bad FROM n0
  UNION ALL
  SELECT host, segs, d + 1, g || '/' || {_name("t", 8, 3.0, 20, 5, 1.96)}, n, lab, bad
  FROM (SELECT *, count(DISTINCT t) OVER p AS k, sum(n) OVER c AS nc, sum(lab) OVER c AS labc, sum(bad) OVER c AS badc, sum(n) OVER p AS np, sum(lab) OVER p AS labp, sum(bad) OVER p AS badp
        FROM (SELECT *, segs[d + 1] AS t FROM w WHERE len(segs) > d) WINDOW p AS (PARTITION BY host, g), c AS (PARTITION BY host, g, t))),
t AS (SELECT host, segs, lab, bad, host || '/' || substr(g, 2) AS template FROM w WHERE d = len(segs)),
s AS (SELECT template, sum(lab) AS tlab, (sum(bad) + 8.0::DOUBLE * (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(lab), 0) + 2.0::DOUBLE) FROM n0)) / (sum(lab) + 8.0::DOUBLE) AS p FROM t GROUP BY template)
SELECT b.page_id, b.host, b.path, b.rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN tlab > 0 AND p >= 0.8 THEN 'block' ELSE 'allow' END AS verdict,
       t.template, round(p, 6) AS purity
FROM b LEFT JOIN t ON b.host = t.host AND b.segs = t.segs LEFT JOIN s ON s.template = t.template
"""
