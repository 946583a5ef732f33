"""Every vector takes part in the re-ranking by the graph."""

import math

from lodestore.plans import catalog, data
from tests import oracle


def test_graph_reranked_uses_every_vector(spark):
    sf = "/root/testdata/sf0.1"
    con = oracle.connect(sf)
    vecs = dict(con.execute("SELECT vec_id, embedding FROM embeddings").fetchall())
    assert len(vecs) > 500
    norm = {i: math.sqrt(sum(x * x for x in v)) for i, v in vecs.items()}
    score = {i: round(sum(x * y for x, y in zip(v, vecs[0], strict=True)) / norm[i] / norm[0], 6) for i, v in vecs.items()}
    lead = sorted(score, key=lambda i: (-score[i], i))[:5]
    assert max(lead) >= 500
    seeds = ", ".join(f"'cust_{i}'" for i in lead)
    found = {r[0] for r in con.execute(f"WITH {data.TRIPLES} SELECT DISTINCT src FROM triples WHERE s IN ({seeds}) OR o IN ({seeds})").fetchall()}
    got = catalog.QUERIES["graph_reranked"](spark, sf).collect()
    assert {r.id for r in got} == set(vecs) | found and len(got) == len(set(vecs) | found)
    assert {r.id for r in got if r.from_graph} == found - set(vecs)
