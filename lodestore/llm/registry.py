"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestore.llm import bpe, chat, crf, html_text, licenses, maxscore, mixing, mtree, resample, secrets, simhash, url_filter, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vectors": vectors.op1,
    "op2_urls": url_filter.op2,
    "op3_chat": chat.op3,
    "op4_mixing": mixing.op4,
    "op5_bpe": bpe.op5,
    "op6_quality": crf.op6,
    "op7_html": html_text.op7,
    "op8_mtree": mtree.op8,
    "op9_simhash": simhash.op9,
    "op10_secrets": secrets.op10,
    "op11_licenses": licenses.op11,
    "op12_maxscore": maxscore.op12,
    "op13_resample": resample.op13,
}
ORACLES: dict[str, str] = {
    "op1_vectors": vectors.OP1_SQL,
    "op2_urls": url_filter.OP2_SQL,
    "op3_chat": chat.OP3_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op8_mtree": mtree.OP8_SQL,
    "op11_licenses": licenses.OP11_SQL,
    "op12_maxscore": maxscore.OP12_SQL,
    "op13_resample": resample.OP13_SQL,
}


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
