"""Queries that once ran on inline rows: Spark reads a given table, and rows grow with it."""

import os

import pytest
from pyspark.sql import functions as F

from lodestore.functions import extract as E
from lodestore.functions import text as X
from lodestore.operators import requests as R
from lodestore.operators import sessions as S
from lodestore.plans import catalog
from lodestore.plans import graph_queries as GQ


def scanned(df):
    return {os.path.basename(f) for f in df.inputFiles()}


@pytest.fixture
def copies(spark, sf, tmp_path):
    """Makes a folder with a table of sf0.001 and a copy of it under shifted keys."""

    def make(name, key, by):
        t = spark.read.parquet(f"{sf}/{name}.parquet")
        t.unionByName(t.withColumn(key, t[key] + by)).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def test_backfill_makes_what_the_first_run_passed_over(spark, sf, copies):
    one = catalog.QUERIES["backfilled_triples"](spark, sf).first()
    assert one["left_over"] > 0 and one["first_time"] > 0 and one["second_time"] == 0
    two = catalog.QUERIES["backfilled_triples"](spark, copies("part", "p_partkey", 300)).first()
    assert [two[c] for c in one.asDict()] == [2 * one[c] for c in one.asDict()]


def test_canonical_requests_reads_events(spark, sf):
    q = catalog.QUERIES["canonical_requests"](spark, sf)
    assert scanned(q) == {"events.parquet"} and q.count() == 1000
    assert 0 < q.filter("same_as < id").count() < 1000


def test_bodies_that_ask_the_same(spark):
    bodies = ['{"stream":true,"model":"m","user":"u","messages":[1]}', '{"messages":[1],"model":"m"}', '{"model":"n","messages":[1],"temperature":0.5}']
    a, b, c = (r[0] for r in spark.createDataFrame([(x,) for x in bodies], "body string").select(R.canonical_json(F.col("body"))).collect())
    assert a == b != c


def test_chain_overlap_reads_events(spark, sf):
    q = catalog.QUERIES["chain_overlap"](spark, sf)
    assert scanned(q) == {"events.parquet"} and q.count() > 2
    assert q.filter("overlap < 1").count() and q.filter("a_chains > 1").count()


def test_overlap_of_chains(spark):
    chains = lambda *rows: spark.createDataFrame([(i, s.split("|")) for i, s in rows], "id long, steps array<string>")
    a, b = chains((1, "a|b|c"), (2, "a|x"), (3, "q|r|s|t")), chains((10, "b|a|c"), (11, "x|a|y"), (12, "r|q|t|s"), (13, "z"))
    assert sorted(map(tuple, S.chain_overlap(a, b).collect())) == [(1, 10, 1.0), (3, 12, 1.0)]


def test_command_tags_reads_events(spark, sf):
    q = catalog.QUERIES["command_tags"](spark, sf)
    assert scanned(q) == {"events.parquet"} and q.count() == 1000


def test_tags_of_commands(spark):
    got = spark.createDataFrame(GQ.COMMANDS, GQ.CMD_SCHEMA).select("id", X.command_tags(F.col("command")).alias("tags")).collect()
    assert {r["id"]: r["tags"] for r in got} == GQ.TAGS


def test_command_templates_reads_events(spark, sf):
    q = catalog.QUERIES["command_templates"](spark, sf)
    assert scanned(q) == {"events.parquet"} and q.count() == 1000
    assert q.filter("normal LIKE '%{{PARAM}}%'").count() >= 250


def test_templates_of_commands(spark):
    got = spark.createDataFrame(GQ.COMMANDS, GQ.CMD_SCHEMA).select("id", X.template_only(F.col("command")).alias("t")).select("id", "t", X.normalize_template(F.col("t"))).collect()
    assert sorted(map(tuple, got)) == sorted(GQ.TEMPLATES)


def test_cooccurrence_reads_part(spark, sf, copies):
    n = catalog.QUERIES["cooccurrence"](spark, sf).count()
    assert n > len(GQ.TOGETHER) and catalog.QUERIES["cooccurrence"](spark, copies("part", "p_partkey", 300)).count() == 2 * n


def test_cooccurrences_of_texts(spark):
    assert sorted(map(tuple, E.cooccurrences(spark.createDataFrame(GQ.TEXTS, GQ.TEXT_SCHEMA)).collect())) == sorted(GQ.TOGETHER)


def test_endpoint_kinds_reads_events(spark, sf):
    q = catalog.QUERIES["endpoint_kinds"](spark, sf)
    assert scanned(q) == {"events.parquet"} and q.count() == 1000
    kinds = {"/v1/embeddings": "embedding", "/v1/responses": "responses", "/v1/completions": "completion", "/v1/messages": "chat"}
    assert {r["path"]: r["kind"] for r in q.select("path", "kind").distinct().collect() if r["path"] in kinds} == kinds


def test_entity_extract_reads_part(spark, sf):
    q = catalog.QUERIES["entity_extract"](spark, sf)
    assert scanned(q) == {"part.parquet"} and q.select("id").distinct().count() > 100


def test_entities_of_texts(spark):
    got = spark.createDataFrame(GQ.TEXTS, GQ.TEXT_SCHEMA).select("id", E.entities("text").alias("es")).collect()
    assert {r["id"]: sorted(r["es"]) for r in got if r["es"]} == {i: sorted(es) for i, es in GQ.FOUND.items()}


def test_entity_types_reads_part(spark, sf):
    q = catalog.QUERIES["entity_types"](spark, sf)
    assert scanned(q) == {"part.parquet"} and q.count() == 200
    assert {r["type"] for r in q.select("type").distinct().collect()} == set(GQ.TYPES)


def test_types_of_names(spark):
    got = spark.createDataFrame([(n,) for n in GQ.NAMES], "name string").select(E.entity_type(F.col("name"))).collect()
    assert [r[0] for r in got] == GQ.TYPES


def test_file_paths_reads_part(spark, sf):
    q = catalog.QUERIES["file_paths"](spark, sf)
    assert scanned(q) == {"part.parquet"} and q.count() == 200


def test_paths_of_texts(spark):
    t = spark.createDataFrame([("see src/App.tsx and lib/x.py, lib/x.py",), (".js",)], "t string")
    assert [r[0] for r in t.select(X.file_paths(t["t"])).collect()] == [["src/App.tsx", "lib/x.py"], []]


def test_formatted_figures_reads_events(spark, sf):
    q = catalog.QUERIES["formatted_figures"](spark, sf)
    assert scanned(q) == {"events.parquet"} and q.count() == 1000


def test_figures_of_numbers(spark):
    v = spark.createDataFrame([(5, 12.0), (1500, 75.0), (2_500_000, 7200.0), (999, 3599.0)], "n long, secs double")
    got = v.select(X.format_number(F.col("n")), X.format_duration(F.col("secs")), X.format_cost(F.col("n") / 1000)).collect()
    assert list(map(tuple, got)) == [("5", "12 sec", "$0.01"), ("1.5K", "1 min", "$1.50"), ("2.5M", "2.0 hrs", "$2500.00"), ("999", "60 min", "$1.00")]
