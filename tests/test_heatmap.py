"""The heatmap takes its tags from the data."""

from lodestore.operators import maintain
from lodestore.plans import catalog
from tests import oracle


def test_heatmap_picks_its_tags_from_the_data(spark):
    rows = [(f"p{i % 2}", [f"t{j:02}" for j in range(14) if i >= j // 2]) for i in range(8)]
    got = maintain.top_heatmap(spark.createDataFrame(rows, "source string, tags array<string>"), "source")
    want = {}
    for source, tags in rows:
        for t in tags:
            if t <= "t11":
                want[source, t] = want.get((source, t), 0) + 1
    assert {(r.source, r.tag): r.n for r in got.collect()} == want


def test_heatmap_of_documents_leaves_no_frequent_tag_out(spark):
    sf = "/root/testdata/sf0.1"
    got = catalog.QUERIES["tag_heatmap_top"](spark, sf)
    assert oracle.spark_rows(got) == oracle.sql_rows(oracle.connect(sf), catalog.ORACLES["tag_heatmap_top"])
    assert "es" in {r.tag for r in got.collect()} and len({r.tag for r in got.collect()}) == 12
