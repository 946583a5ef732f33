import hashlib

import corpus_pipeline
import duckdb
import pytest

from lodestore.llm import crf, secrets
from tests.llm.test_shingles import brute_representatives


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        out.append(docs)
    return out


def table(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality_keeps_what_the_model_keeps(spark, sf, stages):
    model = crf.train(stages[0], spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(table(stages[1])) == {i for i, r in table(stages[0]).items() if model.score(r.text) >= 0.5}


def test_one_document_of_each_group(stages):
    before = table(stages[1])
    kept = brute_representatives({i: r.text for i, r in before.items()})
    assert table(stages[2]) == {i: before[i] for i in kept}


def test_secrets_are_gone_and_the_rest_is_kept(stages):
    before, after = table(stages[2]), table(stages[3])
    assert set(before) == set(after)
    for i, r in after.items():
        assert r.text == secrets.redact(before[i].text) and r.n_chars == len(r.text)


def test_mixture_matches_plain_sql(stages):
    from lodestore.llm.mixing import OP4_SQL

    con = duckdb.connect()
    con.register("documents", stages[3].toPandas())
    taken = con.execute(f"SELECT doc_id, size, taken FROM ({OP4_SQL})").fetchall()
    times = {}
    for r in stages[4].collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {i: -(-t // n) for i, n, t in taken if t}


def test_tokens_decode_to_the_texts(stages):
    want = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in stages[4].collect())
    assert sorted((r.doc_id, r.decoded_sha256) for r in stages[5].collect()) == want


def test_run_gives_the_last_stage(spark, sf, stages):
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(stages[5])


def test_stages_of_odd_tables(spark, sf, docs, empty):
    """Extra columns whose names clash with internal ones stay, up to the last stage."""
    for df in (docs, empty):
        columns = df.columns
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            df = stage(spark, df, sf).cache()
            assert i == 4 or df.columns == columns
            df.count()
        assert df.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
