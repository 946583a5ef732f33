"""Graph, code-graph and extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.functions import extract as E
from lodestore.functions import text as X
from lodestore.operators import graph as G
from lodestore.plans import data as D

Q, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


T = D.TRIPLES
ADJ = "adj AS (SELECT s AS entity, p AS predicate, o AS target, src, 'out' AS direction FROM triples UNION ALL SELECT o, p, s, src, 'in' FROM triples)"
DEG = "deg AS (SELECT entity, count(*) AS degree FROM adj GROUP BY entity)"


@query("adjacency", f"WITH {T}, {ADJ} SELECT * FROM adj")
def _(s, d):
    return G.adjacency(D.triples(s, d))


@query("entity_degree", f"WITH {T}, {ADJ}, {DEG} SELECT * FROM deg ORDER BY degree DESC, entity LIMIT 20")
def _(s, d):
    return G.degrees(D.triples(s, d)).orderBy(F.desc("degree"), "entity").limit(20)


@query("average_degree", f"WITH {T}, {ADJ} SELECT count(DISTINCT entity) AS entities, (count(*) // 2)::BIGINT AS triples, round(count(*) / count(DISTINCT entity)::DOUBLE, 1) AS avg_degree FROM adj")
def _(s, d):
    return G.average_degree(D.triples(s, d))


@query("khop_expand", f"""WITH {T}, {ADJ}, h1 AS (SELECT 1 AS hop, * FROM adj WHERE entity IN ('nation_1', 'cust_7') AND (target NOT IN ('nation_1', 'cust_7') OR (target > entity))),
f AS (SELECT DISTINCT target AS entity FROM h1 WHERE target NOT IN ('nation_1', 'cust_7')),
h2 AS (SELECT 2 AS hop, a.* FROM adj a JOIN f ON a.entity = f.entity WHERE a.target NOT IN ('nation_1', 'cust_7') AND (a.target NOT IN (SELECT entity FROM f) OR a.target > a.entity))
SELECT * FROM h1 UNION ALL SELECT * FROM h2""")
def _(s, d):
    return G.k_hop(D.triples(s, d), ["nation_1", "cust_7"], 2)


@query("khop_reached", f"""WITH {T}, {ADJ}, h1 AS (SELECT DISTINCT target FROM adj WHERE entity = 'region_1' AND target <> 'region_1'), h2 AS (SELECT DISTINCT a.target FROM adj a JOIN h1 ON a.entity = h1.target WHERE a.target <> 'region_1' AND a.target NOT IN (SELECT target FROM h1))
SELECT target, 1 AS hop FROM h1 UNION ALL SELECT target, 2 FROM h2""")
def _(s, d):
    return G.reached(G.k_hop(D.triples(s, d), ["region_1"], 2))


@query("top_subgraph", f"""WITH {T}, {ADJ}, {DEG}, b AS (SELECT entity, count(*) AS degree FROM adj WHERE predicate <> 'mentions' GROUP BY entity ORDER BY degree DESC, entity LIMIT 50) SELECT DISTINCT s, p, o FROM triples WHERE p <> 'mentions' AND s IN (SELECT entity FROM b) AND o IN (SELECT entity FROM b)""")
def _(s, d):
    return G.top_subgraph(D.triples(s, d))


@query("entity_timeline", f"WITH {T}, {D.FINDINGS}, t AS (SELECT src, string_agg(DISTINCT p, '+' ORDER BY p) AS predicates FROM triples WHERE s = 'nation_3' OR o = 'nation_3' GROUP BY src) SELECT id, epoch, predicates FROM findings JOIN t ON id = src")
def _(s, d):
    return G.timeline(D.triples(s, d), D.findings(s, d).select("id", "epoch"), "Nation_3").withColumn("predicates", F.array_join("predicates", "+"))


@query("prune_orphans", f"WITH {T}, k AS (SELECT 'cust_' || c_custkey AS entity FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'region_1') SELECT * FROM triples WHERE s IN (SELECT entity FROM k) OR o IN (SELECT entity FROM k)")
def _(s, d):
    k = D.table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("Cust_"), F.col("c_custkey").cast("string")).alias("entity")).unionByName(D.values(s, [("region_1",)], "entity string"))
    return G.prune(D.triples(s, d), k)


@query("entity_index", f"WITH {D.FINDINGS}, e AS (SELECT id, lower(trim(unnest(tags))) AS entity FROM findings) SELECT DISTINCT entity, id FROM e WHERE entity <> ''")
def _(s, d):
    return G.entity_index(D.findings(s, d).select("id", F.col("tags").alias("entities")))


@query("backfill_missing", f"WITH {T}, {D.FINDINGS} SELECT id FROM findings WHERE id NOT IN (SELECT src FROM triples)")
def _(s, d):
    return G.not_yet_extracted(D.findings(s, d).select("id"), D.triples(s, d))


@query("since_delta", f"WITH {D.FINDINGS} SELECT 'findings' AS store, id, epoch FROM findings WHERE epoch > 1706000000 UNION ALL SELECT 'orders', o_orderkey, epoch_us(o_orderdate) // 1000000 FROM orders WHERE epoch_us(o_orderdate) // 1000000 > 1706000000 UNION ALL SELECT 'events', event_id, epoch_us(ts) // 1000000 FROM events WHERE epoch_us(ts) // 1000000 > 1706000000")
def _(s, d):
    secs = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    o = D.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), secs("o_orderdate").alias("epoch"))
    e = D.table(s, d, "events").select(F.col("event_id").alias("id"), secs("ts").alias("epoch"))
    return G.changed_since({"findings": D.findings(s, d), "orders": o, "events": e}, 1706000000)


# code graph: suppliers call parts, parts inherit by brand, nations contain regions
CODE = """nodes AS (SELECT 'part.' || p_partkey AS qualified_name, 'Method' AS kind, 'src/' || (p_partkey % 9) || '.py' AS file_path, p_partkey % 100 AS line_start, 'supp.' || (p_partkey % 10) AS parent_name FROM part
  UNION ALL SELECT 'supp.' || s_suppkey, 'Class', 'lib/' || (s_suppkey % 4) || '.py', s_suppkey % 50, NULL FROM supplier),
edges AS (SELECT DISTINCT 'CALLS' AS kind, 'supp.' || l_suppkey AS source_qualified, 'part.' || l_partkey AS target_qualified FROM lineitem
  UNION ALL SELECT 'INHERITS', 'supp.' || s_suppkey, 'supp.' || (s_suppkey // 3) FROM supplier
  UNION ALL SELECT 'TESTED_BY', 'part.' || p_partkey, 'test.' || p_partkey FROM part
  UNION ALL SELECT 'IMPORTS', 'part.' || p_partkey, 'part.' || (p_partkey // 2) FROM part)"""


def _code(s, d):
    k = lambda kind, c: F.concat(F.lit(f"{kind}."), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
    part, supp = D.table(s, d, "part").select("p_partkey"), D.table(s, d, "supplier").select("s_suppkey")
    nodes = part.select(k("part", "p_partkey").alias("qualified_name"), F.lit("Method").alias("kind"), F.concat(F.lit("src/"), (F.col("p_partkey") % 9).cast("string"), F.lit(".py")).alias("file_path"), (F.col("p_partkey") % 100).alias("line_start"), k("supp", F.col("p_partkey") % 10).alias("parent_name"))
    nodes = nodes.unionByName(supp.select(k("supp", "s_suppkey").alias("qualified_name"), F.lit("Class").alias("kind"), F.concat(F.lit("lib/"), (F.col("s_suppkey") % 4).cast("string"), F.lit(".py")).alias("file_path"), (F.col("s_suppkey") % 50).alias("line_start"), F.lit(None).cast("string").alias("parent_name")))
    e = lambda kind, df, a, b: df.select(F.lit(kind).alias("kind"), a.alias("source_qualified"), b.alias("target_qualified"))
    half = lambda c, n: F.expr(f"{c} div {n}")
    edges = e("CALLS", D.table(s, d, "lineitem"), k("supp", "l_suppkey"), k("part", "l_partkey")).distinct()
    edges = edges.unionByName(e("INHERITS", supp, k("supp", "s_suppkey"), k("supp", half("s_suppkey", 3))))
    edges = edges.unionByName(e("TESTED_BY", part, k("part", "p_partkey"), k("test", "p_partkey")))
    return nodes, edges.unionByName(e("IMPORTS", part, k("part", "p_partkey"), k("part", half("p_partkey", 2))))


@query("code_graph_stats", f"WITH {CODE} SELECT 'nodes' AS what, kind, count(*) AS n, count(DISTINCT file_path) AS files FROM nodes GROUP BY kind UNION ALL SELECT 'edges', kind, count(*), 0 FROM edges GROUP BY kind")
def _(s, d):
    n, e = _code(s, d)
    return n.groupBy(F.lit("nodes").alias("what"), "kind").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files")).unionByName(e.groupBy(F.lit("edges").alias("what"), "kind").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("files")))


@query("callers_callees", f"""WITH {CODE}, r AS (SELECT 'caller' AS relation, source_qualified AS qualified_name FROM edges WHERE kind = 'CALLS' AND target_qualified = 'supp.3' UNION ALL SELECT 'callee', target_qualified FROM edges WHERE kind = 'CALLS' AND source_qualified = 'supp.3' UNION ALL SELECT 'inheritor', source_qualified FROM edges WHERE kind = 'INHERITS' AND target_qualified = 'supp.3' UNION ALL SELECT 'test', target_qualified FROM edges WHERE kind = 'TESTED_BY' AND source_qualified = 'supp.3')
SELECT r.*, n.kind, n.file_path FROM r LEFT JOIN nodes n USING (qualified_name) UNION ALL SELECT 'member', qualified_name, kind, file_path FROM nodes WHERE parent_name = 'supp.3'""")
def _(s, d):
    return G.neighbours(*_code(s, d), "supp.3")


@query("class_hierarchy", f"WITH {CODE} SELECT 'parent' AS relation, target_qualified AS qualified_name FROM edges WHERE kind = 'INHERITS' AND source_qualified = 'supp.2' UNION ALL SELECT 'child', source_qualified FROM edges WHERE kind = 'INHERITS' AND target_qualified = 'supp.2' UNION ALL SELECT 'member', qualified_name FROM nodes WHERE parent_name = 'supp.2'")
def _(s, d):
    return G.class_hierarchy(*_code(s, d), "supp.2")


@query("module_hierarchy", f"WITH {CODE} SELECT DISTINCT file_path, CASE WHEN kind IN ('Class', 'Interface') THEN qualified_name END AS class_name FROM nodes WHERE starts_with(file_path, 'lib/')")
def _(s, d):
    return G.module_hierarchy(_code(s, d)[0], "lib/")


@query("file_structure", f"WITH {CODE} SELECT qualified_name, line_start FROM nodes WHERE file_path = 'src/3.py'")
def _(s, d):
    return G.file_structure(_code(s, d)[0], "src/3.py").select("qualified_name", "line_start")


@query("impact_radius", f"""WITH {CODE}, b AS (SELECT target_qualified AS used, source_qualified AS u FROM edges WHERE kind IN ('CALLS', 'IMPORTS', 'INHERITS')),
h1 AS (SELECT u AS qualified_name, 1 AS hop FROM b WHERE used = 'part.5' AND u <> 'part.5'), l1 AS (SELECT DISTINCT qualified_name FROM h1),
h2 AS (SELECT u AS qualified_name, 2 AS hop FROM b JOIN l1 ON b.used = l1.qualified_name WHERE u <> 'part.5' AND u NOT IN (SELECT qualified_name FROM l1)), h AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2)
SELECT h.qualified_name, hop, coalesce(kind, 'Unknown') AS kind, file_path FROM h LEFT JOIN nodes USING (qualified_name)
UNION ALL SELECT e.target_qualified, 0, 'Test', n.file_path FROM edges e LEFT JOIN nodes n ON n.qualified_name = e.target_qualified WHERE e.kind = 'TESTED_BY' AND e.source_qualified = 'part.5' AND e.target_qualified NOT IN (SELECT qualified_name FROM h)""")
def _(s, d):
    return G.impact_radius(*_code(s, d), "part.5", 2)


TEXTS = [
    (1, "DomService.cs uses XPathDocument. The FindAllDescendants() method returns AutomationElement objects."),
    (2, "DomService uses XPathDocument for evaluation"),
    (3, "See https://dev.example.com/org/_apis/build/12345/logs and run npm; GetPageSourceAsync calls parseTree()"),
    (4, "nothing here"),
    (5, None),
]
TEXT_SCHEMA = "id long, text string"
NAMES = ["pre-tool-use.js", "AppiumToolHandler", "curl", "system.xml", "microsoft.extensions", "a.b.c", "loadAsync", "camelCase", "plain", "shared.js"]
TYPES = ["File", "Class", "Tool", "Namespace", "Namespace", "Namespace", "Function", "Function", "Concept", "File"]


_kept = lambda pattern, keep="true": f"list_filter(list_transform(regexp_extract_all(t, '{pattern}', 1), lambda x: lower(x)), lambda x: {keep})"
_STOP = ", ".join(f"'{w}'" for w in E.STOP)
_KEEP = f"len(x) > 3 AND x NOT IN ({_STOP})"
_VERB = " ".join(f"WHEN regexp_matches(b, '\\b(?:{pattern})\\b') THEN '{verb}'" for verb, pattern in E.VERBS)
#: entities of notes in order of discovery, relations and co-occurrences
ENTITIES = f"""{D.NOTES}, u AS (SELECT id, coalesce(text, '') AS t, lower(t) AS low, regexp_extract_all(t, 'https?://[^\\s"'']+') AS urls FROM notes),
l AS (SELECT id, low, list_concat({_kept("\\b([A-Z][a-zA-Z]*[a-z][a-zA-Z]*[A-Z][a-zA-Z]*)\\b", _KEEP)}, {_kept("\\b([A-Z][a-z]{2,}(?:[A-Z][a-z]+)+)\\b", _KEEP)},
  {_kept("\\b([\\w.-]+\\.(?:cs|js|ts|tsx|py|json|xml|jsonl|sh|ps1|md|yaml|yml|toml|csproj|sln|bat))\\b")}, {_kept("\\b([a-z][a-zA-Z]+)\\s*\\(", _KEEP)}, {_kept("\\b([A-Z][a-zA-Z]+Async)\\b")},
  {_kept("\\b([A-Z][a-z]+(?:\\.[A-Z][a-z]+)+)\\b")}, {_kept("\\b(az|curl|git|node|npm|npx|dotnet|docker|python3?|pip|powershell|bash)\\b")},
  list_filter(list_transform(urls, lambda x: lower(regexp_extract(x, '^https?://(?:[^/?#@]*@)?([^/:?#]+)', 1))), lambda x: x NOT IN ('', 'localhost')),
  list_filter(flatten(list_transform(urls, lambda y: list_transform(list_filter(string_split(regexp_extract(y, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: len(x) > 2 AND NOT regexp_matches(x, '^\\d+$') AND x <> '_apis')[-3:], lambda x: lower(x)))), lambda x: x NOT IN ({_STOP}))) AS every FROM u),
f AS (SELECT id, low, list_filter(every, lambda x, i: list_position(every, x) = i) AS es FROM l),
one AS (SELECT id, low, unnest(es) AS e, generate_subscripts(es, 1) AS i FROM f),
pair AS (SELECT x.id, x.low, x.e AS s, y.e AS o, x.i < y.i AS forward, instr(x.low, x.e) AS i, instr(x.low, y.e) AS j FROM one x JOIN one y ON x.id = y.id AND x.e <> y.e),
between_ AS (SELECT id, s, o, trim(substr(low, i + len(s), greatest(0, j - i - len(s)))) AS b FROM pair WHERE i > 0 AND i < j),
rel AS (SELECT id, s, CASE {_VERB} END AS p, o FROM between_ WHERE p IS NOT NULL),
sentence AS (SELECT id, unnest(regexp_split_to_array(low, '[.!?\\n]+')) AS sentence FROM f),
co AS (SELECT p.id, p.s, p.o FROM pair p JOIN sentence c ON c.id = p.id AND len(trim(sentence)) > 5 AND contains(sentence, s) AND contains(sentence, o)
  WHERE forward AND NOT EXISTS (SELECT 1 FROM rel r WHERE r.id = p.id AND (r.s = p.s AND r.o = p.o OR r.s = p.o AND r.o = p.s))),
made AS (SELECT id::VARCHAR AS s, 'mentions' AS p, e AS o, id AS src FROM one UNION ALL SELECT s, p, o, id FROM rel UNION ALL SELECT s, 'related_to', o, id FROM co)"""


EXTS = ("js", "cs", "txt", "yaml", "Service")
_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
ENTITY_TYPES = f"""WITH {D.NOTES}, c AS (SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN 'pre-' || adj || '-use.js' WHEN 1 THEN a || n || 'Handler' WHEN 2 THEN [{_quoted(E.TOOLS)}][p_size % {len(E.TOOLS)} + 1]
  WHEN 3 THEN 'system.' || noun WHEN 4 THEN 'microsoft.' || noun || '.xml' WHEN 5 THEN adj || '.' || noun || '.c' WHEN 6 THEN 'load' || n || 'Async' WHEN 7 THEN adj || n WHEN 8 THEN noun ELSE adj || '.' || [{_quoted(EXTS)}][p_size % {len(EXTS)} + 1] END AS name FROM words),
k AS (SELECT *, string_split(name, '.') AS w FROM c)
SELECT id, name, CASE WHEN len(w) > 2 THEN 'Namespace' WHEN len(w) = 2 THEN CASE WHEN w[1] NOT IN ({_quoted(E.ROOTS)}) AND lower(w[2]) IN ({_quoted(E.FILE_TYPES)}) THEN 'File' ELSE 'Namespace' END
  WHEN lower(name) LIKE '%async' OR regexp_matches(name, '^[a-z].*[A-Z]') THEN 'Function' WHEN regexp_matches(name, '^[A-Z][a-z]') THEN 'Class' WHEN name IN ({_quoted(E.TOOLS)}) THEN 'Tool' ELSE 'Concept' END AS type FROM k"""


@query("entity_types", ENTITY_TYPES)
def _(s, d):
    """Names of ten shapes, made of each part's name."""
    adj, noun = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("p_size") % len(words) + 1).cast("int"))
    shapes = [
        (F.lit("pre-"), adj, F.lit("-use.js")), (F.initcap(adj), F.initcap(noun), F.lit("Handler")), (pick(E.TOOLS),), (F.lit("system."), noun), (F.lit("microsoft."), noun, F.lit(".xml")),
        (adj, F.lit("."), noun, F.lit(".c")), (F.lit("load"), F.initcap(noun), F.lit("Async")), (adj, F.initcap(noun)), (noun,), (adj, F.lit("."), pick(EXTS)),
    ]
    name = F.coalesce(*(F.when(F.col("p_partkey") % 10 == i, F.concat(*c)) for i, c in enumerate(shapes)))
    p = D.table(s, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))
    return p.select("id", "name", E.entity_type(F.col("name")).alias("type"))


FOUND = {
    1: ["xpathdocument", "findalldescendants", "automationelement", "domservice", "domservice.cs"],
    2: ["domservice", "xpathdocument"],
    3: ["getpagesourceasync", "parsetree", "npm", "dev.example.com", "build", "logs", "org"],
}


@query("entity_extract", f"WITH {ENTITIES} SELECT id, e AS entity FROM one")
def _(s, d):
    return D.notes(s, d).select("id", F.explode(E.entities(F.col("text"))).alias("entity"))


RELATIONS = (
    [(1, a, "uses", b) for a in ("domservice", "domservice.cs") for b in ("automationelement", "findalldescendants", "xpathdocument")]
    + [(1, a, "returns", "automationelement") for a in ("findalldescendants", "xpathdocument")]
    + [(2, "domservice", "uses", "xpathdocument")]
    + [(3, a, "calls", "parsetree") for a in ("build", "dev.example.com", "getpagesourceasync", "logs", "npm", "org")]
)
TOGETHER = [(3, a, b) for a, bs in (("getpagesourceasync", ("npm", "build", "logs", "org")), ("npm", ("build", "logs", "org")), ("org", ("build", "logs")), ("build", ("logs",))) for b in bs]


@query("relations", D.sql_rows(RELATIONS, "id long, s string, p string, o string"))
def _(s, d):
    return E.relations(D.values(s, TEXTS, TEXT_SCHEMA))


@query("cooccurrence", f"WITH {ENTITIES} SELECT id, s, o FROM co")
def _(s, d):
    return E.cooccurrences(D.notes(s, d))


MADE = [(str(i), "mentions", e, i) for i, es in FOUND.items() for e in es] + [(s, p, o, i) for i, s, p, o in RELATIONS] + [(s, "related_to", o, i) for i, s, o in TOGETHER]


@query("triples_from_entries", D.sql_rows(MADE, "s string, p string, o string, src long"))
def _(s, d):
    return E.triples(D.values(s, TEXTS, TEXT_SCHEMA))


@query("conversation_entities", "SELECT conv_id, turn, e AS entity FROM (SELECT conv_id, turn, unnest(list_distinct(list_concat(list_transform(regexp_extract_all(text, '\\b([\\w.-]+\\.(?:cs|js|ts|tsx|py|json|xml|jsonl|sh|ps1|md|yaml|yml|toml|csproj|sln|bat))\\b', 1), lambda x: lower(x)), regexp_extract_all(text, '\\b(az|curl|git|node|npm|npx|dotnet|docker|python3?|pip|powershell|bash)\\b', 1)))) AS e FROM conversations)")
def _(s, d):
    c = D.table(s, d, "conversations")
    found = F.array_distinct(F.concat(F.transform(X.all_matches(F.col("text"), E._FILE, 1), F.lower), X.all_matches(F.col("text"), E._TOOL, 1)))
    return c.select("conv_id", "turn", F.explode(found).alias("entity"))


COMMANDS = [
    (1, 'curl -X POST "https://api.example.com/projects/0f8fad5b-d9cb-469f-a165-70867728950e/builds/12345" -d \'{"title": "a long title of some words here"}\'', "trigger a build"),
    (2, "grep -rn needle src | head", "search for needle"),
    (3, "node scripts/build.js --env production", "build it"),
    (4, 'cat "/tmp/some/longer/path/file.txt" | python -c "import sys" && echo done 123456', "read the file"),
    (5, "git log --oneline", None),
    (6, "npm install left-pad", "install"),
    (7, "make check", "look into what is failing"),
    (8, "", None),
]
CMD_SCHEMA = "id long, command string, description string"


@query("script_skeletons", f"WITH {D.sql_values(COMMANDS, CMD_SCHEMA, 'c')} SELECT id, substring(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(command, '\\{{\\{{[^}}]+\\}}\\}}', 'X', 'g'), '\"[^\"]{{30,}}\"', '\"...\"', 'g'), '\\{{[^}}]{{50,}}\\}}', '{{...}}', 'g'), 'https?://[^\\s\"]+', 'URL', 'g'), '(?i)[0-9a-f]{{8,}}', 'HEX', 'g'), '\\d{{5,}}', 'NUM', 'g'), '\\s+', ' ', 'g')), 1, 200) AS skeleton FROM c")
def _(s, d):
    return D.values(s, COMMANDS, CMD_SCHEMA).select("id", X.script_skeleton(F.col("command")).alias("skeleton"))


TAGS = {1: "node|curl".split("|")[1:], 2: ["grep"], 3: ["node", "js"], 4: ["python"], 5: ["git"], 6: ["npm"], 7: [], 8: []}


COMMAND_TAGS = f"""WITH {D.COMMANDS}, c AS (SELECT id, coalesce(command, '') AS c FROM commands),
t AS (SELECT id, list_concat(list_filter([{", ".join(f"'{w}'" for w in X.COMMAND_TOOLS)}], lambda x: contains(lower(c), x)), list_filter(list_transform(regexp_extract_all(c, '\\.\\w{{1,6}}\\b'), lambda x: lower(x[2:])), lambda x: x IN ({", ".join(f"'{w}'" for w in X.TAG_EXTENSIONS)}))) AS t FROM c)
SELECT id, coalesce(array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i)[:5], ','), '') AS tags FROM t"""


@query("command_tags", COMMAND_TAGS)
def _(s, d):
    return D.commands(s, d).select("id", F.array_join(X.command_tags(F.col("command")), ",").alias("tags"))


@query("intents", "SELECT * FROM (VALUES (1::BIGINT, false), (2, true), (3, false), (4, true), (5, true), (6, false), (7, true), (8, false)) v(id, exploratory)")
def _(s, d):
    return D.values(s, COMMANDS, CMD_SCHEMA).select("id", X.is_exploratory(F.col("command"), F.col("description")).alias("exploratory"))


@query("reusable_scripts", "SELECT * FROM (VALUES (1::BIGINT, true), (2, false), (3, false), (4, false), (5, false), (6, false), (7, false), (8, false)) v(id, reusable)")
def _(s, d):
    return D.values(s, COMMANDS, CMD_SCHEMA).select("id", X.is_reusable_script(F.col("command")).alias("reusable"))


TEMPLATES = [
    (1, 'curl -X POST "https://api.example.com/projects/{{uuid}}/builds/{{build_id}}" -d \'{"title": "{{title}}"}\'', 'curl -X POST "https://api.example.com/projects/{{PARAM}}/builds/{{PARAM}}" -d \'{"title": "{{PARAM}}"}\''),
    (4, 'cat "{{file_path}}" | python -c "import sys" && echo done 123456', 'cat "{{PARAM}}" | python -c "import sys" && echo done 123456'),
    *((i, c, c) for i, c, _ in COMMANDS if i not in (1, 4)),
]


TEMPLATE = f"""WITH {D.COMMANDS}, a AS (SELECT id, regexp_replace(coalesce(command, ''), '(?i)[0-9a-f]{{8}}-(?:[0-9a-f]{{4}}-){{3}}[0-9a-f]{{12}}', '{{{{uuid}}}}', 'g') AS c FROM commands),
b AS (SELECT id, regexp_replace(c, '(?i)/(build|log|run|pullrequest|workitem|iteration)s/\\d+', '/\\1s/{{{{\\1_id}}}}', 'g') AS c FROM a),
e AS (SELECT id, regexp_replace(c, '"(?:[A-Z]:\\\\[^"]{{10,}}|/(?:tmp|home|var|usr|opt)/[^"]{{10,}})"', '"{{{{file_path}}}}"', 'g') AS c FROM b),
f AS (SELECT id, regexp_replace(c, '(?i)"(title|description|name|message|value)":\\s*"[^"]{{20,}}"', '"\\1": "{{{{\\1}}}}"', 'g') AS template FROM e)
SELECT id, template, trim(regexp_replace(regexp_replace(template, '\\s+', ' ', 'g'), '\\{{\\{{[^}}]+\\}}\\}}', '{{{{PARAM}}}}', 'g')) AS normal FROM f"""


@query("command_templates", TEMPLATE)
def _(s, d):
    return D.commands(s, d).select("id", X.template_only(F.col("command")).alias("template")).select("id", "template", X.normalize_template(F.col("template")).alias("normal"))


@query("script_groups", f"WITH {D.HISTORY} SELECT 'tool ' || event_type AS skeleton, count(*) AS scripts, sum(k)::BIGINT AS total_usage FROM history GROUP BY 1")
def _(s, d):
    h = D.history(s, d)
    return h.groupBy(X.script_skeleton(F.concat(F.lit("tool "), "event_type")).alias("skeleton")).agg(F.count("*").alias("scripts"), F.sum("k").alias("total_usage"))


@query("sanitized_names", "SELECT item_id, coalesce(nullif(substring(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 60), ''), 'exploration') AS name FROM benchmark")
def _(s, d):
    return D.table(s, d, "benchmark").select("item_id", X.sanitize_filename(F.col("text")).alias("name"))
