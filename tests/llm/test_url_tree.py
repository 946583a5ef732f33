"""The path-template tree against its SQL on random trees, and on paths of very many segments."""

import random

import pytest

from lodestore.llm import url_filter
from tests import oracle


@pytest.mark.parametrize("seed", [1, 2])
def test_random_trees_match_the_sql(spark, tmp_path, seed):
    rng = random.Random(seed)
    urls = []
    for host in ("a.net", "b.net", "c.example.com", "d.org"):
        chain = [f"c{i}" for i in range(rng.randrange(1, 12))]
        for _ in range(400):
            path = chain[: rng.randrange(len(chain) + 1)] if rng.random() < 0.3 else [rng.choice(["es", "fr", "en", "de"])] + chain[: rng.randrange(3)]
            while rng.random() < 0.6 and len(path) < 15:
                path = [*path, rng.choice(["x", "y", "z", f"u{rng.randrange(4000)}q{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"])]
            urls.append(f"http://{host}/" + "/".join(path))
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = url_filter.op2(spark, str(tmp_path))
    assert {"*", "~"} <= {s for r in got.select("template").distinct().collect() if r[0] for s in r[0].split("/")[1:]}
    assert oracle.spark_rows(got) == oracle.sql_rows(con, url_filter.OP2_SQL)


def test_shared_segments_take_one_step(spark, monkeypatch):
    """2,000 shared segments, with URLs that end at every tenth of them, are two steps."""
    written = []
    whole = url_filter.materialize
    monkeypatch.setattr(url_filter, "materialize", lambda df, name="t": written.append(name) or whole(df, name))
    deep = [f"s{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(2000)]
    urls = ["http://h.org/" + "/".join([*deep, chr(97 + i)]) for i in range(12)] + ["http://h.org/" + "/".join(deep[: 10 * i]) for i in range(1, 200)]
    got = {r.id: r.template for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert {got[i] for i in range(12)} == {"h.org/" + "/".join([*deep, "*"])} and got[12] == "h.org/" + "/".join(deep[:10])
    assert len(written) <= 10


def test_an_only_child_keeps_its_name(spark):
    with pytest.raises(ValueError, match="min_children"):
        url_filter.judge_urls(spark.createDataFrame([(1, "http://a/b")], "page_id long, url string"), min_children=1)
