"""Licence scan by a positional index of rare words, in DataFrame operations only.

Licence notices are templates: words at positions, some of them mandatory key phrases. The index
maps a licence word to the templates and positions that hold it. Of the licence words that a file
has, each template's rarest (by their document frequency in the whole corpus) are looked up; a
word at p in the file and at o in the template proposes the place p - o. Places on which at least
half of the looked-up positions agree are verified: every word of the key phrases must stand at
its position. The others may differ; the share of the template's rarity that is in place is the
match's score.

Everything about a file is decided in its row: no text and no posting is shuffled, and a file of
any length is one pass over its words and its own matches. The corpus gives one count for each
licence word, whatever its size.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.words import SQL_WORDS, words
from lodestore.session import read_table


class Template(NamedTuple):
    label: str
    notice: str
    keys: tuple[str, ...]
    base: bool = False


#: Phrases whose places are counted one by one; each is mandatory as a whole.
BASE = (
    Template("mit", "under the mit license", ("under the mit license",), True),
    Template("apache-2", "apache license version 2", ("apache license version 2",), True),
    Template("cc-by-nc", "cc by nc", ("cc by nc",), True),
)

#: Usual notices of public licences, with what must stand in each as it is.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("mit", "spdx license identifier mit", ("spdx license identifier mit",)),
    Template("mit", "this software is released under the terms of the mit license", ("mit license",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0",)),
    Template("apache-2", "spdx license identifier apache 2 0", ("spdx license identifier apache 2 0",)),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "either version 2 of the license")),
    Template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "either version 3 of the license")),
    Template("lgpl-3", "this work is licensed under the gnu lesser general public license version 3", ("gnu lesser general public license version 3",)),
    Template("lgpl-2", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ("gnu lesser general public license", "either version 2 1 of the license")),
    Template("agpl-3", "this work is licensed under the gnu affero general public license version 3", ("gnu affero general public license version 3",)),
    Template("gpl-2", "spdx license identifier gpl 2 0", ("spdx license identifier gpl 2 0",)),
    Template("gpl-3", "spdx license identifier gpl 3 0", ("spdx license identifier gpl 3 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "are permitted provided that the following conditions are met")),
    Template("bsd-3", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software without specific prior written permission",)),
    Template("bsd-3", "spdx license identifier bsd 3 clause", ("spdx license identifier bsd 3 clause",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "for any purpose with or without fee is hereby granted")),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("mpl-2", "licensed under the mozilla public license version 2 0", ("mozilla public license version 2 0",)),
    Template("epl-2", "made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    Template("boost-1", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty", "in no event will the authors be held liable for any damages")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    Template("cc0-1", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0 international",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0 international",)),
    Template("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ("creative commons attribution noderivatives 4 0 international",)),
    Template("cc-by-sa", "licensed under cc by sa", ("licensed under cc by sa",)),
)
TEMPLATES = BASE + NOTICES
#: how many of a template's words a file is looked up by
RARE = 4

_SCHEMA = "array<struct<label: string, base: boolean, words: array<string>, must: array<int>, idf: array<double>, total: double, first: string>>"


def mandatory(template: Template) -> list[int]:
    """Positions of the key phrases' words in the notice."""
    ws = template.notice.split()
    out: set[int] = set()
    for key in template.keys:
        k = key.split()
        at = next((i for i in range(len(ws) - len(k) + 1) if ws[i : i + len(k)] == k), None)
        if at is None:
            raise ValueError(f"key phrase {key!r} is not in its notice")
        out.update(range(at, at + len(k)))
    return sorted(out)


def licence_words(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.notice.split()})


def word_counts(docs: DataFrame, text_col: str, templates: tuple[Template, ...]) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that hold each licence word: a row per word comes to the driver."""
    all_words = F.array(*(F.lit(w) for w in licence_words(templates)))
    held = F.concat(F.array(F.lit("")), F.array_intersect(all_words, words(text_col)))
    found = {r["w"]: r["count"] for r in docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()}
    return found.pop("", 0), found


def licence_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, rare: int = RARE) -> DataFrame:
    """(id, n_words, matches array<struct<label, base, start, end, score>>) of every row; places count words from 0, end is exclusive.

    Null, empty and wordless texts have no matches. Every place of a template is a match of its own.
    Rows don't depend on each other but for the counts of licence words; rows that repeat an id are
    each a row, null ids keep theirs, other columns don't matter, and an empty table gives none.
    """
    n, df = word_counts(docs, text_col, templates)
    idf = {w: math.log((2 * n + 2) / (2 * df.get(w, 0) + 1)) for w in licence_words(templates)}
    order = sorted(idf, key=lambda w: (df.get(w, 0), w))  # rarest first
    place = {w: i for i, w in enumerate(order)}
    table = []
    for t in templates:
        ws, must = t.notice.split(), mandatory(t)
        table.append({"label": t.label, "base": t.base, "words": ws, "must": must, "idf": [idf[w] for w in ws], "total": sum(idf[w] for w in ws), "first": min((ws[o] for o in must), key=place.get)})
    index = F.from_json(F.lit(json.dumps(table)), _SCHEMA)  # folded to a constant

    d = docs.select(F.col(id_col).cast("long").alias("id"), words(text_col).alias("ws"))
    d = d.withColumn("held", F.array_intersect(F.array(*(F.lit(w) for w in order)), "ws"))
    # templates whose rarest mandatory word the file has, with the file's rarest words of each
    d = d.withColumn("live", F.transform(F.filter(index, lambda t: F.array_contains("held", t["first"])), lambda t: F.struct(t.alias("t"), F.slice(F.filter("held", lambda w: F.array_contains(t["words"], w)), 1, rare).alias("look"))))
    wanted = F.array_distinct(F.flatten(F.col("live.look")))
    places = F.when(F.size("live") > 0, F.filter(F.transform("ws", lambda w, i: F.when(F.array_contains("wanted", w), i)), lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("wanted", wanted).withColumn("places", places)

    def offsets(x: Column) -> Column:
        """Positions of the looked-up words in the template."""
        return F.filter(F.transform(x["t"]["words"], lambda w, o: F.when(F.array_contains(x["look"], w), o)), lambda o: o.isNotNull())

    def proposals(x: Column) -> Column:
        """A place for each pair of a looked-up position and the same word in the file, sorted."""
        return F.array_sort(F.flatten(F.transform(x["at"], lambda o: F.transform(F.filter("places", lambda p: F.get("ws", p) == F.get(x["t"]["words"], o)), lambda p: p - o))))

    def verified(x: Column) -> Column:
        """Places that half of the looked-up positions propose and where the key phrases stand."""
        half = F.ceil(F.size(x["at"]) / 2).cast("int")
        agreed = F.filter(x["v"], lambda a, i: (a >= 0) & ~F.coalesce(F.get(x["v"], i - 1) == a, F.lit(False)) & F.coalesce(F.get(x["v"], i + half - 1) == a, F.lit(False)))
        return F.filter(agreed, lambda a: F.forall(x["t"]["must"], lambda o: F.coalesce(F.get("ws", a + o) == F.get(x["t"]["words"], o), F.lit(False))))

    def match(x: Column, a: Column) -> Column:
        here = F.aggregate(F.transform(x["t"]["words"], lambda w, o: F.when(F.get("ws", a + o) == w, F.get(x["t"]["idf"], o)).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
        return F.struct(x["t"]["label"].alias("label"), x["t"]["base"].alias("base"), a.cast("long").alias("start"), (a + F.size(x["t"]["words"])).cast("long").alias("end"), F.round(here / x["t"]["total"], 6).alias("score"))

    d = d.withColumn("live", F.transform("live", lambda x: F.struct(x["t"].alias("t"), offsets(x).alias("at"))))
    d = d.withColumn("live", F.transform("live", lambda x: F.struct(x["t"].alias("t"), x["at"].alias("at"), proposals(x).alias("v"))))
    matches = F.flatten(F.transform("live", lambda x: F.transform(verified(x), lambda a: match(x, a))))
    return d.select("id", F.size("ws").cast("long").alias("n_words"), matches.alias("matches"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``licence_matches`` over ``documents``; nulls, empty and long texts, ties, repeated rows and empty tables as there."""
    found = licence_matches(read_table(spark, f"{sf_dir}/documents.parquet"))
    found = found.withColumn("base", F.filter("matches", lambda m: m["base"]))
    labels = lambda col: F.array_join(F.array_sort(F.array_distinct(F.col(f"{col}.label"))), ",")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        labels("base").alias("base_labels"), labels("matches").alias("labels"), F.coalesce(F.array_max("matches.score"), F.lit(0.0)).alias("score"),
    )


def _values() -> str:
    rows = []
    for n, t in enumerate(TEMPLATES):
        must = set(mandatory(t))
        rows += [f"({n}, '{t.label}', {t.base}, {o}, '{w}', {o in must})" for o, w in enumerate(t.notice.split())]
    return ", ".join(rows)


OP11_SQL = f"""
WITH tw(t, label, base, o, w, must) AS (VALUES {_values()}),
d AS (SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS} AS ws FROM documents),
v AS (SELECT DISTINCT w FROM tw),
dw AS (SELECT r, w, p FROM (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d) SEMI JOIN v USING (w)),
f AS (SELECT v.w, count(DISTINCT r) AS df FROM v LEFT JOIN dw USING (w) GROUP BY v.w),
i AS (SELECT w, df, ln((2 * (SELECT count(*) FROM d) + 2)::DOUBLE / (2 * df + 1)) AS idf FROM f),
c AS (
  SELECT r, t, w FROM (SELECT DISTINCT r, w FROM dw) JOIN (SELECT DISTINCT t, w FROM tw) USING (w) JOIN i USING (w)
  QUALIFY row_number() OVER (PARTITION BY r, t ORDER BY df, w) <= {RARE}),
a AS (SELECT r, t, count(*) AS n FROM c JOIN tw USING (t, w) GROUP BY r, t),
s AS (SELECT r, t, p - o AS s FROM c JOIN tw USING (t, w) JOIN dw USING (r, w) WHERE p >= o GROUP BY r, t, s HAVING 2 * count(*) >= (SELECT n FROM a WHERE a.r = c.r AND a.t = c.t)),
m AS (
  SELECT s.r, s.t, s.s, any_value(label) AS label, any_value(base) AS base, round(sum(CASE WHEN dw.w = tw.w THEN idf ELSE 0 END) / sum(idf), 6) AS score
  FROM s JOIN tw ON tw.t = s.t JOIN i ON i.w = tw.w LEFT JOIN dw ON dw.r = s.r AND dw.p = s.s + tw.o
  GROUP BY s.r, s.t, s.s HAVING bool_and(NOT must OR coalesce(dw.w = tw.w, false))),
g AS (
  SELECT r, count(*) FILTER (WHERE base) AS n, min(s) FILTER (WHERE base) AS lo, max(s) FILTER (WHERE base) AS hi,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM m GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)
"""
