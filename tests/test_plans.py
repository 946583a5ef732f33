"""Physical plans: what reaches the scan, what shuffles, what stays in the JVM."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from lodestore.operators import graph, maintain, requests, search, sessions
from lodestore.plans import catalog, data


PYTHON = "EvalPython|InPandas|InArrow|PythonUDF"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def schemas(text):
    return re.findall(r"ReadSchema: struct<([^\n]*)>", text)


def test_search_tokenises_once_and_shuffles_matches_only(spark, sf):
    docs = data.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    text = plan(search.bm25(docs, {0: "the of"}))
    assert all(s in ("id:bigint,dl:bigint,hits:array<string>", "dl:bigint", "id:bigint,hits:array<string>") for s in schemas(text))  # the corpus isn't tokenised again
    assert "text" not in text


def test_filters_reach_the_scan(spark, sf):
    part = data.table(spark, sf, "part").withColumnRenamed("p_name", "file_path").withColumnRenamed("p_partkey", "line_start").withColumnRenamed("p_brand", "qualified_name")
    assert "EqualTo(p_name,x)" in plan(graph.file_structure(part, "x"))
    assert "StringStartsWith(p_name,a)" in plan(graph.module_hierarchy(part.withColumn("kind", F.lit("File")), "a"))


def test_log_analytics_aggregate_before_they_shuffle(spark, sf):
    text = plan(requests.dashboard(data.requests(spark, sf)))
    assert text.count("HashAggregate") >= 2 and "Exchange" in text and "SinglePartition" in text
    assert "user_id" in schemas(text)[0] and "event_id" in schemas(text)[0]
    assert len(schemas(plan(requests.endpoint_breakdown(data.requests(spark, sf))))[0].split(",")) <= 4


def test_windows_are_partitioned_by_owner(spark, sf):
    h = data.history(spark, sf)
    for df in (sessions.retry_success(h), sessions.exploration_success(h), sessions.chains(h), sessions.checkpoints(h), sessions.rolling_last(h)):
        text = plan(df)
        assert "SinglePartition" not in text and "hashpartitioning(user_id" in text
        assert text.count("\nArguments: hashpartitioning(") == 1  # one shuffle serves all windows


def test_anti_and_semi_joins(spark, sf):
    d = data.findings(spark, sf)
    text = plan(maintain.missing(d.select("id"), d.select("id").filter("id > 5")))
    assert "LeftAnti" in text and "text:string" not in "".join(schemas(text))


@pytest.mark.parametrize("name", ["bm25_search", "request_dashboard", "khop_expand", "complexity_score", "hybrid_classify", "retry_success", "workflow_chains", "cached_answers", "tag_clusters", "transcript_condense", "dedup_probe"])
def test_core_queries_run_no_python(spark, sf, name):
    assert not re.search(PYTHON, plan(catalog.QUERIES[name](spark, sf)))


def test_pairs_meet_on_keys_not_in_nested_loops(spark, sf):
    v = data.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    for df in (maintain.similar_pairs(v, 0.9), maintain.dedup_probe(data.findings(spark, sf), data.findings(spark, sf)), maintain.topic_duplicates(data.findings(spark, sf))):
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(df))
