import re

import pytest

from lodestore.llm import bpe, chat, crf, html_text, licenses, mixing, resample, secrets, url_filter
from tests.test_plans import PYTHON, plan, schemas


@pytest.mark.parametrize("query", [url_filter.op2, chat.op3, mixing.op4, licenses.op11, resample.op13])
def test_native_operators_run_no_python(spark, sf, query):
    assert not re.search(PYTHON + "|CartesianProduct", plan(query(spark, sf)))


def test_scans_read_what_they_need_and_nothing_shuffles(spark, sf):
    docs, pages = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages"))
    model = crf.fit([])
    for df, columns in (
        (bpe.bpe_encode(docs), "doc_id:bigint,text:string"),
        (crf.quality_scores(docs, model), "doc_id:bigint,text:string"),
        (secrets.secret_spans(docs), "doc_id:bigint,text:string"),
        (html_text.page_texts(pages), "page_id:bigint,url:string,html:string"),
    ):
        text = plan(df)
        assert schemas(text) == [columns] and "Exchange" not in text


@pytest.mark.parametrize(("query", "columns"), [(bpe.op5, "doc_id:bigint,text:string"), (html_text.op7, "page_id:bigint,url:string,html:string")])
def test_queries_prune_columns_below_a_small_tables_deal(spark, sf, query, columns):
    assert schemas(plan(query(spark, sf))) == [columns]


def test_turns_are_dealt_once(spark, sf):
    """Numbering, gathering and measuring the parts of dialogues read one shuffle of the texts."""
    df = chat.op3(spark, sf)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = re.findall(r"(Reused)?Exchange (?:\[[^\]]*\], )?(?:Exchange )?hashpartitioning\(conv_id#\d+L, part#\d+L, \d+\), REPARTITION_BY_COL", final)
    assert sorted(dealt) == ["", "Reused"]
