"""Every registered query of the library's own operators against its SQL, and that the others give rows."""

import pytest

from lodestore.plans import catalog
from tests import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    assert oracle.spark_rows(catalog.QUERIES[name](spark, sf)) == oracle.sql_rows(con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() >= 0


def test_nothing_imports_the_llm_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "lodestore"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "lodestore.llm" not in p.read_text(), p
