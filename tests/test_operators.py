"""Operators against expectations that are no queries of the driver tables."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestore import config, tools
from lodestore.functions import extract, parameters, text, vector
from lodestore.operators import classify, compress, graph, maintain, quantize, requests, search, sessions, snapshot
from lodestore.sources import code, files
from lodestore.streaming import streams, translate


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("given", "tokens"), [("DomService.cs uses XPath", ["dom", "service", "cs", "uses", "x", "path"]), ("", []), (None, []), ("foo(bar, baz) => 'result'", ["foo", "bar", "baz", "result"]), ("pre-tool_use", ["pre-tool_use"])])
def test_tokens(spark, given, tokens):
    assert one(spark, text.tokens, given) == tokens


CORPUS = [("r1", "xpath verification of elements"), ("r2", "xpath engine"), ("r3", "verification xpath notes"), ("r4", "build pipeline"), ("r5", "unrelated words here")]


def test_bm25_ranks_matching_documents(spark):
    docs = spark.createDataFrame(CORPUS, "id string, text string")
    got = search.top(search.bm25(docs, {0: "xpath verification"}), 3)
    assert {r.id for r in got.collect()} == {"r1", "r2", "r3"}
    assert search.bm25(docs, {0: "zzz"}).count() == 0 and search.bm25(docs.limit(0), {0: "xpath"}).count() == 0
    once = {r.id: r.score for r in search.bm25(docs, {0: "xpath"}).collect()}
    twice = {r.id: r.score for r in search.bm25(docs, {0: "xpath xpath"}).collect()}
    assert all(math.isclose(twice[k], 2 * once[k]) for k in once)


def test_fusion(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "id string, rank int")
    b = spark.createDataFrame([("z", 0), ("y", 1)], "id string, rank int")
    got = {r.id: r for r in search.fuse({"bm25": a, "embedding": b}).collect()}
    assert got["y"].sources == ["bm25", "embedding"] and got["x"].score == got["z"].score < got["y"].score
    low = {r.id: r.score for r in search.fuse({"bm25": a}, k=10).collect()}
    assert low["x"] > got["x"].score
    assert search.fuse({"bm25": a.limit(0)}).count() == 0


def test_k_hop(spark):
    t = spark.createDataFrame([("A", "uses", "B", 1), ("B", "calls", "C", 2), ("C", "x", "D", 3), ("A", "calls", "B", 4), ("B", "self", "B", 5)], "s string, p string, o string, src long")
    r = lambda seeds, d: {x.target for x in graph.reached(graph.k_hop(t, seeds, d)).collect()}
    assert r(["a"], 1) == {"b"} and r(["A"], 2) == {"b", "c"} and r(["d"], 1) == {"c"}
    assert graph.k_hop(t, ["a"], 1).count() == 2  # multiple edges count
    assert graph.k_hop(t, ["nobody"], 2).count() == 0


def test_relations(spark):
    t = spark.createDataFrame([(1, "DomService uses XPathDocument for evaluation")], "id long, text string")
    assert [(r.s, r.p, r.o) for r in extract.relations(t).collect()] == [("domservice", "uses", "xpathdocument")]
    assert extract.cooccurrences(t).count() == 0


def test_parameters():
    c = 'curl "https://h/projects/0f8fad5b-d9cb-469f-a165-70867728950e/builds/12/x/1f8fad5b-d9cb-469f-a165-70867728950e" "/tmp/some/longer/path" 2f8fad5b-d9cb-469f-a165-70867728950e'
    template, params = parameters.parameterize(c)
    assert [p["name"] for p in params] == ["project_id", "uuid", "uuid_2", "build_id", "file_path"]
    assert "/builds/{{build_id}}/" in template and '"{{file_path}}"' in template
    assert parameters.parameterize("") == ("", [])
    nested, params = parameters.parameterize('{"title": "a longer title about 3f8fad5b-d9cb-469f-a165-70867728950e", "value": "4f8fad5b-d9cb-469f-a165-70867728950e"}')
    assert nested == '{"title": "{{title}}", "value": "{{uuid_2}}"}'  # too little of the second value is left beside its id
    assert [p["default"] for p in params if p["name"] == "title"] == ["a longer title about {{uuid}}"]


def test_body_hash_tells_all_fields_apart(spark):
    bodies = ['{"model":"m","messages":[1]}', '{"messages":[1],"model":"m","user":"x","stream":true}', '{"model":"m","messages":[1],"params":{"a":1}}', '{"model":"m","messages":[1],"stop_sequences":["x"]}', '{"model":"m","messages":[1],"system":"s"}', '{"model":"m","messages":[1],"tools":[]}']
    got = [r.h for r in spark.createDataFrame([(b,) for b in bodies], "body string").select(requests.body_hash(F.col("body")).alias("h")).collect()]
    assert got[0] == got[1] and len(set(got)) == len(bodies) - 1


@pytest.mark.parametrize(("command", "description", "yes"), [("grep -r x .", None, True), ("git log", None, True), ("npm install", None, False), ("git commit -m x", None, False), ("mkdir a", None, False), ("curl -X POST http://h", None, False), ("curl -X PATCH http://h", "search it", False), ("curl http://h", None, True)])
def test_intent(spark, command, description, yes):
    df = spark.createDataFrame([(command, description)], "c string, d string")
    assert df.select(text.is_exploratory(F.col("c"), F.col("d")).alias("y")).first().y is yes


def test_complexity_gates(spark):
    rows = [(1, "hello", 0), (2, "hello", 2), (3, "```\n" + "x" * 5001 + "\n```", 0), (4, "--- a\n+++ b", 0), (5, "a/b.c d/e.f g/h.i j/k.l", 0)]
    got = {r.id: r for r in classify.complexity(spark.createDataFrame(rows, "id long, full_text string, n_tools int")).collect()}
    assert not got[1].forced and got[1].score < 0.4
    assert all(got[i].forced and got[i].score == 1.0 for i in (2, 3, 4, 5))


def test_prompts_fall_on_their_side(spark):
    simple = ["fix this typo", "what is the capital of France?", "translate to German: good morning", "list the planets", "rename x to y"]
    hard = ["refactor the parser and migrate the store, think step by step, touching src/a.py lib/b.py and x/c.py", "design and implement a scheduler; reason about failures; chain of thought; respond in json" + " detail" * 900]
    df = spark.createDataFrame([(i, p, p) for i, p in enumerate(simple + hard)], "id long, full_text string, user_text string")
    got = {r.id: r.score for r in classify.complexity(df).collect()}
    assert all(got[i] < 0.4 for i in range(len(simple))) and all(got[i] > 0.4 for i in range(len(simple), len(simple) + len(hard)))


def test_gap_of_exactly_ninety_seconds_stays(spark):
    rows = [(1, 0.0, 1), (1, 90.0, 2), (1, 180.001, 3)]
    df = spark.createDataFrame(rows, "user_id long, t double, event_id long").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    assert sorted(r.n for r in sessions.gap_sessions(df).collect()) == [1, 2]
    long = df.withColumn("command", F.lit("deploy --service accounts --region north")).withColumn("success", F.lit(True))
    assert [(r.event_id, r.length) for r in sessions.chains(long).collect()] == [(2, 2)]


def test_percentile_rule(spark):
    for n in (1, 2, 20, 101):
        df = spark.createDataFrame([(i,) for i in range(n)] + [(None,)], "latency_ms long")
        r = requests.percentiles(df).first()
        assert (r.p50, r.p95, r.p99) == tuple(int(n * p) for p in (0.5, 0.95, 0.99))


def test_breaker():
    b = requests.Breaker()
    assert [b.step(i, False)[0] for i in range(5)][-1] == "OPEN"
    assert b.step(1000, True) == ("OPEN", False) and b.step(40_000, False) == ("OPEN", True) and b.step(80_000, True) == ("CLOSED", True)


def test_dedup_probe(spark):
    s = spark.createDataFrame([(1, "Build errors", ["ci", "Net"]), (2, "build", ["ci", "net", "x"]), (3, "other", ["ci", "net"])], "id long, topic string, tags array<string>")
    n = spark.createDataFrame([(9, "build ERRORS in tests", ["CI", "net"]), (8, "build", ["ci"]), (7, "", ["ci", "net"])], "id long, topic string, tags array<string>")
    assert [(r.new_id, r.id) for r in maintain.dedup_probe(s, n).collect()] == [(9, 1)]


def test_quantizer_properties():
    r = quantize.rotation(48)
    assert np.allclose(r @ r.T, np.eye(48), atol=1e-4)
    v = np.random.default_rng(0).standard_normal((20, 48))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for bits in range(2, 9):
        q = quantize.levels(v, bits)
        assert (quantize.unpack(quantize.pack(q, bits), bits, 48) == q).all()
        assert np.abs(quantize.values(q, bits) - v).max() <= 2 / 2**bits * 1.1
        raw, signs = quantize.encode(v, bits)
        assert raw.shape[1] == math.ceil(48 * bits / 8) and signs.shape[1] == 6
    raw, signs = quantize.encode(v, 8, residual=False)
    assert np.mean((quantize.decode(raw, signs, 8, 48) - v) ** 2) < 1e-4
    with pytest.raises(ValueError):
        quantize._check(1)


def test_quantized_sizes(spark):
    df = spark.range(1)
    assert df.select(vector.quantized_size(384, 3).alias("n")).first().n == 192 and df.select(vector.quantized_size(384, 3, False).alias("n")).first().n == 144


def test_compression_is_lossless(spark):
    texts = ["the cat and the dog and the cow", "the cat  and\nthe dog, the cat's 3.5 and the", "«0» the cat", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    merges = compress.train(df, merges=5)
    assert merges and merges[0] == ("and", "the")
    for t in texts:
        assert compress.decompress(compress.compress(t, merges), merges) == t or "«" in t
    assert len(compress.compress(texts[0], merges)) < len(texts[0]) + 5


def test_snapshot_fits_its_budget(spark):
    f = spark.createDataFrame([(i, f"t{i}", "x" * (50 * i), i) for i in range(1, 30)], "id long, topic string, finding string, epoch long")
    c = f.select("id", (F.col("id") % 3).alias("cluster"))
    for budget in (100_000, 12_000, 3500, 600):
        total = sum(len(r.line) + 1 for r in snapshot.snapshot(f, c, budget).collect())
        assert 0 < total <= budget


def test_json_lines(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "s.jsonl").write_text('{"id":1,"t":"a"}\n{"id":2}\nnot json\n\n')
    path = str(tmp_path / "p1" / "s.jsonl")
    assert sorted((r.id, r.t) for r in files.read_jsonl(spark, path, schema).collect()) == [(1, "a"), (2, None)]
    assert [(r.good, r.bad) for r in files.corrupt_report(spark, path, schema).collect()] == [(2, 1)]
    assert files.read_jsonl(spark, path, schema, max_bytes=3).count() == 0 and files.read_jsonl(spark, str(tmp_path / "none"), schema).count() == 0
    assert {r._project for r in files.projects(spark, str(tmp_path), "s.jsonl", schema).collect()} == {"p1"}
    (tmp_path / "m.json").write_text(json.dumps({"a": [1.0, 2.0], "b": []}))
    assert {r.key: r.value for r in files.read_json_map(spark, str(tmp_path / "m.json"), "array<double>").collect()} == {"a": [1.0, 2.0], "b": []}
    (tmp_path / "bad.json").write_text("{")
    assert files.read_json_map(spark, str(tmp_path / "bad.json"), "array<double>").count() == 0


def test_file_walk_and_parse(spark, tmp_path):
    for p, t in {"src/a.py": "def f():\n    g()\n", "node_modules/b.js": "x", ".git/c.py": "x", "d.txt": "x", "tests/test_a.py": "def test_f():\n    f()\n", "bad.py": "def ("}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    found = files.walk(spark, str(tmp_path))
    names = {r.path.rsplit("/", 1)[-1] for r in found.collect()}
    assert names == {"a.py", "test_a.py", "bad.py"}
    nodes, edges = code.code_graph(found)
    assert {r.kind for r in nodes.collect()} == {"File", "Function"}
    kinds = [r.kind for r in edges.collect()]
    assert kinds.count("CALLS") == 2 and kinds.count("TESTED_BY") == 1
    known = found.select("path", files.file_hash(F.col("content")).alias("hash")).filter("path LIKE '%a.py'")
    assert files.changed_files(found, known).count() == 1


def test_imports_resolve(spark):
    fs = spark.createDataFrame([("src/c.js", "import x from './d'; const y = require('../lib'); import z from 'fs';"), ("src/d.ts", ""), ("lib/index.js", "")], "path string, content string")
    got = {r.target_qualified for r in code.resolve_imports(code.code_graph(fs)[1], fs).collect()}
    assert got == {"src/d.ts", "lib/index.js", "fs"}


@pytest.mark.parametrize("src", translate.FORMATS)
@pytest.mark.parametrize("dst", translate.FORMATS)
def test_translation_keeps_text_and_reason(spark, src, dst):
    frames = {
        "anthropic": ['{"delta":{"text":"Hel"}}', '{"delta":{"text":"lo"}}', '{"delta":{"stop_reason":"max_tokens"},"usage":{"output_tokens":2}}'],
        "openai": ['{"choices":[{"delta":{"content":"Hel"}}]}', '{"choices":[{"delta":{"content":"lo"}}]}', '{"choices":[{"finish_reason":"length"}]}'],
        "ollama": ['{"message":{"content":"Hel"}}', '{"message":{"content":"lo"}}', '{"done":true,"done_reason":"length","eval_count":2}'],
    }[src]
    df = spark.createDataFrame([("s", i, f) for i, f in enumerate(frames)], "stream_id string, n long, data string")
    rows = translate.translate(df, src, dst).orderBy("n", "part").collect()
    again = translate.common(spark.createDataFrame([("s", i, r.data) for i, r in enumerate(rows)], "stream_id string, n long, data string"), dst).orderBy("n").collect()
    assert "".join(r.text or "" for r in again) == "Hello"
    assert [r.reason for r in again if r.reason] == [{"anthropic": "max_tokens"}.get(dst, "length")]


def test_keyed_steps():
    step, state = streams.reminder_step(), {"last": None, "count": 0}
    made = []
    for seq, (ts, saved) in enumerate([(0, False), (1000, False), (200_000, False), (400_000, False), (410_000, True), (420_000, False)]):
        state, out = step(state, {"seq": seq, "ts_ms": ts, "saved": saved})
        made += [(o["seq"], o["reminders"], o["blocked"]) for o in out]
    assert made == [(0, 1, False), (2, 2, False), (3, 3, True), (5, 1, False)]
    state = {"created": 0, "completed": 0}
    opens = []
    for a in ("delete", "create", "create", "complete", "complete", "complete"):
        state, out = streams.tracker_step(state, {"seq": 0, "action": a})
        opens.append(out[0]["open"])
    assert opens == [0, 1, 2, 1, 0, 0]


def test_stream_equals_batch(spark, sf):
    h = streams.stream_table(spark, sf, "events").select("user_id", "event_id", "ts")
    got = streams.run_append(streams.rolling_last(h, 5)).filter("kept > 5 OR kept < 1")
    assert got.count() == 0


def test_config():
    c = config.merged({"bm25": {"k1": 2.0}, "other": 1})
    assert c["bm25"] == {"k1": 2.0, "b": 0.75} and c["searchMode"] == "hybrid" and c["other"] == 1
    assert config.from_environment({"searchMode": "x", "limit": 3, "on": False}, env={"LODESTORE_SEARCH_MODE": "y", "LODESTORE_LIMIT": "7", "LODESTORE_ON": "yes"}) == {"searchMode": "y", "limit": 7, "on": True}
    with pytest.raises(ValueError):
        config.checked({"query": "x" * 5000})
    assert config.checked({"finding": "x" * 5000})["finding"]
    deep = []
    for _ in range(9):
        deep = [deep]
    with pytest.raises(ValueError):
        config.checked(deep)


def test_tools_over_a_store(spark):
    r = spark.createDataFrame([(1, "xpath engine", ["a", "b"], "it evaluates xpath", ["dom"], "stable", 0.9, 10, None), (2, "build", ["c"], "it builds", ["ci"], "volatile", 0.2, 20, None)], "id long, topic string, tags array<string>, finding string, entities array<string>, staleness string, confidence double, epoch long, supersedes long")
    d = spark.createDataFrame([(1, "scope", "use xpath", "it works", 5)], "id long, category string, decision string, rationale string, epoch long")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (99, [1.0, 0.0])], "id long, vec array<double>")
    s = tools.Store(r, d, vectors=v)
    hits = [(x.kind, x.id) for x in tools.memory_search(s, "xpath", [1.0, 0.1]).orderBy(F.desc("kind"), "rank").collect()]
    assert hits == [("research", 1), ("research", 2), ("decision", 1)]
    t = spark.createDataFrame([("dom", "uses", "tree", 1), ("tree", "has", "node", 2), ("ci", "runs", "tests", 3)], "s string, p string, o string, src long")
    near = tools.memory_connections(tools.Store(r, d, triples=t), tools.memory_search(s, "xpath").filter("kind = 'research'"))
    assert [(x.entity, x.target) for x in near.collect()] == [("dom", "tree"), ("tree", "node")]
    new = spark.createDataFrame([(7, "xpath", ["a", "b"], "again"), (8, "new", ["z"], "x")], "id long, topic string, tags array<string>, finding string")
    assert {x.id for x in tools.memory_save(s, new).collect()} == {1, 2, 8}
    done = tools.run_maintenance(s, now=100 * 86400)
    assert {x.id for x in done["stale"].collect()} == {2} and {x.id for x in done["orphan_vectors"].collect()} == {99}
    assert tools.session_summary(s, d.limit(0)).first().status == "CLEAN"


def test_references_in_several_broadcasts_give_the_same(spark):
    r = np.random.default_rng(8)
    v = spark.createDataFrame([(i, i % 7, x.tolist()) for i, x in enumerate(r.standard_normal((60, 6)))], "id long, label int, vec array<double>")
    centroids = classify.label_centroids(v)
    one = sorted(map(tuple, classify.nearest_centroid(v, centroids).collect()))
    assert one == sorted(map(tuple, classify.nearest_centroid(v, centroids, bank_bytes=100).collect())) and len(one) == 60
    banks = spark.createDataFrame([("simple" if i % 2 else "complex", x.tolist()) for i, x in enumerate(r.standard_normal((9, 6)))], "category string, vec array<double>")
    assert sorted(map(tuple, classify.nearest_reference(v, banks).collect())) == sorted(map(tuple, classify.nearest_reference(v, banks, bank_bytes=100).collect()))
