"""Topics that hold one another, found by pieces, against a comparison of all."""

import random

from lodestore.operators import maintain


def test_pieces_miss_no_pair(spark):
    rnd = random.Random(3)
    whole = "".join(rnd.choice("ab é😀") for _ in range(40))
    tags = [["x", "y"], ["Y", "x", "z"], ["x"], ["x", "x"], None, []]
    rows = []
    for i in range(150):
        a = rnd.randrange(30)
        rows.append((i, whole[a : a + rnd.choice((0, 1, 2, 3, 4, 7, 8, 9, 20))], rnd.choice(tags)))
    rows += [(900, None, ["x", "y"]), (901, "", ["x", "y"])]
    new, store = rows[::2], rows[1::2]
    key = lambda t: (t or "").strip(" ").lower()
    low = lambda t: {x.lower() for x in t or []}
    want = {}
    for i, t, g in new:
        hits = [j for j, u, h in store if key(t) and key(u) and len(low(g) & low(h)) >= 2 and (key(t) in key(u) or key(u) in key(t))]
        if hits:
            want[i] = min(hits)
    frame = lambda r: spark.createDataFrame(r, "id long, topic string, tags array<string>")
    assert {r.new_id: r.id for r in maintain.dedup_probe(frame(store), frame(new)).collect()} == want and len(want) > 10
    assert maintain.dedup_probe(frame([]), frame(new)).count() == 0
