import collections

from lodestore.llm import chat, mixing, url_filter
from tests import oracle


def test_queries_match_their_sql(spark, sf):
    con = oracle.connect(sf)
    for query, sql in ((url_filter.op2, url_filter.OP2_SQL), (chat.op3, chat.OP3_SQL), (mixing.op4, mixing.OP4_SQL)):
        assert oracle.spark_rows(query(spark, sf)) == oracle.sql_rows(con, sql)


def with_table(spark, tmp_path, name, df):
    df.write.parquet(str(tmp_path / f"{name}.parquet"))
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return con


def test_odd_urls(spark, tmp_path):
    urls = [
        None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/1", "http://example.com/en/2", "http://a.example.com/en/", "http://x.net/es/1", "http://x.net/es", "http://x.net/fr/7#a", "http://x.com", "http://x.com?q=/en/", "http://İx.com/",
        "a://b://c/d", "http://notcom/", "http://xnet/es/", "http://x.net//es/", "http://h.org/" + "/".join(f"s{i}" for i in range(50)), "http://h.org/a/b\nc", "ftp://x.net/es/1",
    ]
    urls += [f"http://t.org/u/{c}" for c in "abcdefghijkl"] + ["http://t.org/es/1"] * 5 + [f"http://y.net/{'es' if i % 2 else 'en'}/{i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://x.net/es/1"), (3, "://")], "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS id", "'t' AS t1", "2 AS n")
    con = with_table(spark, tmp_path, "pages", df)
    got = url_filter.op2(spark, str(tmp_path))
    assert oracle.spark_rows(got) == oracle.sql_rows(con, url_filter.OP2_SQL)
    by = {r.page_id: r for r in got.collect()}
    assert (by[5].host, by[5].path, by[5].rule, by[5].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert by[6].verdict == by[7].verdict == by[8].verdict == "block" and by[9].rule is None and by[0].host == ""
    assert by[21].template == "t.org/u/*" and by[18].template == "h.org/" + "/".join(["s#"] * 50)
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_templates_are_rejected_by_their_labels(spark):
    rows = [(i, f"http://s.net/{'es' if i < 60 else 'en'}/{i}") for i in range(90)] + [(100 + i, f"http://s.net/es//{i}") for i in range(3)] + [(200, "http://s.net/x/es/1")]
    got = {r.id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[0].verdict == "block" and got[0].rule == "net/es/"
    assert got[70].rule is None and got[70].verdict == "allow"


def test_a_method_verdict_can_block(spark):
    rules = (("bad.org/a/", False),)
    rows = [(i, f"http://bad.org/a/p{i}") for i in range(40)] + [(50, "http://bad.org//a/p7")]
    got = {r.id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert got[50].rule is None and got[50].template == got[0].template and got[50].verdict == "block"


def test_deep_segments_and_similar_branches_make_templates(spark):
    """Below four segments too; branches merge on evidence only."""
    rules = (("s.org/ok/", True), ("s.org/x/y/z/w/v/bad", False), ("s.org/x/y/z/w/v/worse", False))
    urls = [f"http://s.org/x/y/z/w/v/bad/{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + [f"http://s.org/x/y/z/w/v/worse/{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50)]
    urls += ["http://s.org/x/y/z/w/v/new/aa"] + [f"http://s.org/ok/{i}" for i in range(60)] + [f"http://s.org//x/y/z/w/v/bad/q{i}" for i in range(1)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r for r in url_filter.judge_urls(rows, rules=rules).orderBy("id").collect()]
    assert got[0].template == got[70].template == "s.org/x/y/z/w/v/~/*"  # like each other
    assert got[110].template == "s.org/x/y/z/w/v/new/aa" and got[110].verdict == "allow"  # one URL is no evidence
    assert got[130].template == "s.org/ok/#" and got[130].verdict == "allow"
    assert {(r.rule, r.template, r.verdict) for r in got[-1:]} == {(None, "s.org/x/y/z/w/v/~/*", "block")}  # by the tree, no rule fits "//x"


def test_every_participant_is_the_assistant_once(spark, tmp_path):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé"), (1, 3, "cat", None), (1, 3, "cat", None), (2, 0, "system", "alone"), (3, None, None, "x"), (None, 1, "user", "y"), (None, 1, "user", "y"), (4, 40, "user", ""), (4, 2, "user", "z" * 5000),
    ] + [(5, 7, "user", "same")] * 11
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "'s' AS speaker", "2 AS copy")
    con = with_table(spark, tmp_path, "conversations", df)
    got = chat.op3(spark, str(tmp_path))
    assert oracle.spark_rows(got) == oracle.sql_rows(con, chat.OP3_SQL)
    all_rows = got.collect()
    one = {r.assistant: r for r in all_rows if r.conv_id == 1}
    assert sorted(one) == ["ann", "bob", "cat"] and not any(r.conv_id == 2 for r in all_rows)
    a, b = map(int, one["bob"].mask.split(":"))
    assert one["bob"].rendered[a:b] == "hé<|im_end|>" and "user name=ann\nhi" in one["bob"].rendered
    assert sum(r.n_messages for r in all_rows if r.conv_id == 5) == 11 and max(r.n_messages for r in all_rows if r.conv_id == 5) == 4
    assert chat.rotate(df.limit(0)).count() == 0


def test_long_dialogues_are_one_text_however_cut(spark):
    rows = [(1, i, ("ann", "bob\neve", "system", "<|im_start|>x")[i % 4], f"turn {i} <|im_end|>\n" * (i % 3)) for i in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def whole(**how):
        out = {}
        for r in sorted(chat.rotate(df, **how).collect(), key=lambda r: (r.assistant, r.offset)):
            text, mask = out.get(r.assistant, ("", []))
            assert r.offset == len(text)
            out[r.assistant] = text + r.rendered, mask + [r.mask] * bool(r.mask)
        return {k: (t, ",".join(m)) for k, (t, m) in out.items()}

    got = whole()
    assert got == whole(part_turns=1000) == whole(part_turns=7)
    assert sorted(got) == ["< |im_start|>x", "ann", "bob eve"]
    for who, (text, mask) in got.items():
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == 150
        spans = [tuple(map(int, m.split(":"))) for m in mask.split(",")]
        assert all(text[a:b].endswith("<|im_end|>") and text[:a].endswith("<|im_start|>assistant\n") for a, b in spans), who


def test_mixture_of_odd_documents(spark, docs, empty, tmp_path):
    con = with_table(spark, tmp_path, "documents", docs)
    got = mixing.op4(spark, str(tmp_path))
    assert oracle.spark_rows(got) == oracle.sql_rows(con, mixing.OP4_SQL)
    rows = got.collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r.size for r in rows)
    plan, pieces = mixing.mix(empty)
    assert mixing.taken_words(plan, pieces).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_targets_are_met_and_spread(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan, pieces = mixing.mix(docs, block_words=64)
    by = mixing.taken_words(plan, pieces).groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 3 * 64 and r["max(target)"] <= 3 * r["max(source_size)"] for r in by)
    slots = pieces.select("slot", "sid").distinct().toPandas().sort_values("slot")
    share = slots.sid.value_counts(normalize=True)
    early = slots.head(len(slots) // 4).sid.value_counts(normalize=True)
    assert (share - early.reindex(share.index).fillna(0)).abs().max() < 0.03  # any stretch has the shares of the whole


def test_capped_shares_go_to_the_rest(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30.0 and got[None] == 0.0 and abs(got["b"] + got["c"] - 1980) < 1e-9 and abs(got["c"] / got["b"] - 1.5) < 1e-9


def test_mixed_documents_follow_the_plan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan, pieces = mixing.mix(docs)
    rows = mixing.taken_words(plan, pieces).collect()
    taken = {r.id: (r.taken, r["size"]) for r in rows}
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 8  # a few blocks of a word or two
    mixed = mixing.mixed_documents(docs).collect()
    times = collections.Counter(r.doc_id for r in mixed)
    for i, (t, n) in taken.items():
        assert times.get(i, 0) == (-(-t // n) if n else 0)
    # every prefix of the mixture holds the sources in their shares, up to the document at its end and the sequence's discrepancy
    total, at, so_far = sum(t for t, _ in taken.values()), 0, collections.Counter()
    share = {r.source: r.target / total for r in rows}
    longest = max(n for _, n in taken.values())
    for r in mixed:
        n = taken[r.doc_id][1]
        at += n
        so_far[r.source] += n
        assert all(abs(so_far[s] - p * at) <= longest + 64 for s, p in share.items())


def test_rows_without_or_with_repeated_ids_meet_their_targets(spark):
    rows = [(None, "a " * 100, "x") for _ in range(20)] + [(None, f"w{i} " * 100, "y") for i in range(20)] + [(7, f"v{i} " * 50, "z") for i in range(40)] + [(8, "", "z"), (9, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan, pieces = mixing.mix(docs)
    got = mixing.taken_words(plan, pieces).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    for source, target in (("x", 1000), ("y", 2000), ("z", 3000)):
        assert abs(sum(r.taken for r in got if r.source == source) - target) <= 8
    mixed = mixing.mixed_documents(docs).collect()
    by = collections.Counter(r.source for r in mixed)
    assert abs(by["x"] - 10) <= 1 and abs(by["y"] - 20) <= 1 and abs(by["z"] - 60) <= 1 and not any(r.doc_id in (8, 9) for r in mixed)
    first = sorted((r.id or 0, r["size"], r.taken, r.first_slot or -1) for r in got)
    plan, pieces = mixing.mix(docs.repartition(3))
    assert sorted((r.id or 0, r["size"], r.taken, r.first_slot or -1) for r in mixing.taken_words(plan, pieces).collect()) == first
