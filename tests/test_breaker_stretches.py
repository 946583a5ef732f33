"""Breaker states by independent stretches against one automaton per provider."""

import random

import pytest
from pyspark.sql import functions as F

from lodestore.operators import requests as R


def calls(seed, fail):
    rnd = random.Random(seed)
    out = []
    for p in ("a", "b", None):
        ts = 0
        for _ in range(800):
            ts += rnd.choice((0, 1, 5, 20, 120))
            out.append((p, len(out), ts, rnd.random() > fail * (1 + 6 * (ts // 1500 % 4 == 0))))
    return out


@pytest.mark.parametrize("fail", [0.02, 0.1, 0.5])
def test_stretches_give_what_one_automaton_gives(spark, fail):
    rows = calls(7, fail)
    want = {}
    for p in ("a", "b", None):
        b = R.Breaker(3, 100)
        for _, seq, ts, ok in sorted((r for r in rows if r[0] == p), key=lambda r: (r[2], r[1])):
            want[seq] = b.step(ts, ok)
    got = R.breaker_states(spark.createDataFrame(rows, "provider string, seq long, ts_ms long, ok boolean"), limit=3, rest_ms=100)
    assert {r.seq: (r.state, r.allowed) for r in got.collect()} == want
    assert {s for s, _ in want.values()} >= {"CLOSED"} and (fail < 0.1 or any(not a for _, a in want.values()))


def test_a_healthy_provider_is_dealt_to_several_stretches(spark):
    rows = [("a", i, i * 60, i % 50 != 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "provider string, seq long, ts_ms long, ok boolean")
    plan = R.breaker_states(df, rest_ms=100)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(provider" in plan and "stretch" in plan
    assert R.breaker_states(df, rest_ms=100).filter(F.col("state") != "CLOSED").count() == 0


def test_no_outcome_is_a_failure_and_no_time_is_no_call(spark):
    df = spark.createDataFrame([("a", 1, 5, None), ("a", 2, None, True)], "provider string, seq long, ts_ms long, ok boolean")
    assert [tuple(r) for r in R.breaker_states(df, limit=1).collect()] == [("a", 1, "OPEN", True)]


def test_exact_answers_are_the_latest_within_the_time_to_live(spark):
    rows = [(1, "h", "t", 0, None), (2, "h", "t", 5, None), (3, "h", "t", 5, None), (4, "h", "t", 20, None), (5, None, "t", 21, None), (6, "h", "t", 25, None)]
    df = spark.createDataFrame(rows, "id long, hash string, tenant string, ts_ms long, vec array<double>")
    assert {(r.id, r.hit, r.by) for r in R.cached_answers(df, 10).collect()} == {(2, "exact", 1), (3, "exact", 1), (6, "exact", 4)}
