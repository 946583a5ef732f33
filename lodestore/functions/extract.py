"""Entities, types and relations in texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.functions.text import all_matches, blank, word
from lodestore.session import materialize

# fixed values: entity patterns (text, pattern, whether short and common words are dropped)
_PASCAL = r"(?<![A-Za-z0-9_])([A-Z][a-zA-Z]*[a-z][a-zA-Z]*[A-Z][a-zA-Z]*)(?![A-Za-z0-9_])"
_CAMEL = r"(?<![A-Za-z0-9_])([A-Z][a-z]{2,}(?:[A-Z][a-z]+)+)(?![A-Za-z0-9_])"
_FILE = r"(?<![A-Za-z0-9_])([\w.-]+\.(?:cs|js|ts|tsx|py|json|xml|jsonl|sh|ps1|md|yaml|yml|toml|csproj|sln|bat))(?![A-Za-z0-9_])"
_CALL = r"(?<![A-Za-z0-9_])([a-z][a-zA-Z]+)\s*\("
_ASYNC = r"(?<![A-Za-z0-9_])([A-Z][a-zA-Z]+Async)(?![A-Za-z0-9_])"
_NAMESPACE = r"(?<![A-Za-z0-9_])([A-Z][a-z]+(?:\.[A-Z][a-z]+)+)(?![A-Za-z0-9_])"
_TOOL = r"(?<![A-Za-z0-9_])(az|curl|git|node|npm|npx|dotnet|docker|python3?|pip|powershell|bash)(?![A-Za-z0-9_])"
_URL = r"""https?://[^\s"']+"""
# fixed values: words that are no entities
STOP = (
    "the this that with from into have been were will should could would does each when then than more also just only both after before between about which where while using true false null undefined error string "
    "number object array function const return async await import export require module class interface type enum void boolean default value result data item entry status message content name path file line found "
    "used like make take give need want know think"
).split()
# fixed values: verbs of relations, in order of precedence
VERBS = (
    ("uses", "uses"), ("depends_on", r"depends\s+on"), ("calls", "calls?"), ("implements", "implements?"), ("extends", "extends?"), ("returns", "returns?"), ("fixes", "fix(?:es|ed)?"),
    ("requires", "requires?"), ("produces", "produces?"), ("contains", "contains?"), ("consumes", "consumes?"), ("converts", "converts?"), ("serializes", "serializ(?:es|ed)?"), ("pipes_to", r"pipes?\s+to"),
)
# fixed values: extensions of files, roots of namespaces, tools
FILE_TYPES = "js ts py cs json xml md yml yaml sh ps1 css html jsx tsx jsonl toml rs go java c h cpp hpp rb vue bat sln csproj".split()
ROOTS = "system microsoft flaui appium newtonsoft nunit xunit moq".split()
TOOLS = "curl npm node git docker dotnet pip python powershell az grep find".split()


def _kept(found: Column) -> Column:
    return F.filter(found, lambda e: (F.length(e) > 3) & ~e.isin(*STOP))


def _kept_cased(found: Column) -> Column:
    return F.filter(found, lambda e: (F.length(e) > 3) & ~F.lower(e).isin(*STOP))


def typed_entities(text: Column) -> Column:
    """Array of (name, type): lower-case names, typed by how the text writes them; the first writing of a name counts."""
    m = lambda p: all_matches(text, p, 1)
    cased = F.concat(_kept_cased(m(_PASCAL)), _kept_cased(m(_CAMEL)), m(_FILE), _kept_cased(m(_CALL)), m(_ASYNC), m(_NAMESPACE), m(_TOOL))
    names = entities(text)

    def written(name: Column) -> Column:
        same = F.filter(cased, lambda c: F.lower(c) == name)
        return F.coalesce(F.get(same, F.lit(0)), name)

    return F.transform(names, lambda n: F.struct(n.alias("name"), entity_type(written(n)).alias("type")))


def entities(text: Column) -> Column:
    """Distinct lower-case entity names in order of discovery: by kind of pattern, then by place."""
    low = lambda p: F.transform(all_matches(text, p, 1), F.lower)
    urls = all_matches(text, _URL)
    host = F.filter(F.transform(urls, lambda u: F.lower(F.regexp_extract(u, r"^https?://(?:[^/?#@]*@)?([^/:?#]+)", 1))), lambda h: (h != "") & (h != "localhost"))

    def tail(u: Column) -> Column:
        parts = F.filter(F.split(F.regexp_extract(u, r"^https?://[^/?#]+([^?#]*)", 1), "/"), lambda p: (F.length(p) > 2) & ~p.rlike(r"^\d+$") & (p != "_apis"))
        return F.filter(F.transform(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), F.lower), lambda p: ~p.isin(*STOP))

    parts = F.flatten(F.transform(urls, tail))
    return F.array_distinct(F.concat(_kept(low(_PASCAL)), _kept(low(_CAMEL)), low(_FILE), _kept(low(_CALL)), low(_ASYNC), low(_NAMESPACE), low(_TOOL), host, parts))


def entity_type(name: Column) -> Column:
    """File, Class, Function, Namespace, Tool or Concept."""
    parts = F.split(name, r"\.")
    n, ext = F.size(parts), F.lower(F.element_at(parts, -1))
    return (
        F.when((n >= 3) | ((n == 2) & ~ext.isin(*FILE_TYPES)), "Namespace")
        .when((n == 2) & F.element_at(parts, 1).isin(*ROOTS), "Namespace")
        .when(n == 2, "File")
        .when(name.rlike("(?i)async$") | (name.rlike("^[a-z]") & name.rlike("[A-Z]")), "Function")
        .when(name.rlike("^[A-Z][a-z]"), "Class")
        .when(name.isin(*TOOLS), "Tool")
        .otherwise("Concept")
    )


def relations(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, s, p, o): of entities in order of first place, the first verb that stands between two.

    Pairs are within one text's entity array, in a flat map over it; no join.
    """
    return _relations(_discovered(texts, id_col, text_col))


def _discovered(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, low, es): lower-case texts with their entities."""
    return texts.select(F.col(id_col).alias("id"), F.lower(blank(F.col(text_col))).alias("low"), entities(F.col(text_col)).alias("es"))


def _relations(found: DataFrame) -> DataFrame:
    t = found.filter(F.size("es") > 1)
    pairs = F.flatten(F.transform("es", lambda a: F.transform(F.filter("es", lambda b: b != a), lambda b: F.struct(a.alias("s"), b.alias("o")))))
    t = t.select("id", "low", F.explode(pairs).alias("x")).select("id", "low", "x.s", "x.o")
    t = t.withColumn("i", F.expr("locate(s, low)")).withColumn("j", F.expr("locate(o, low)")).filter("i > 0 AND i < j")
    between = F.expr("trim(substring(low, i + length(s), greatest(0, j - i - length(s))))")
    verb = F.lit(None).cast("string")
    for p, pattern in reversed(VERBS):
        verb = F.when(F.col("b").rlike(word(pattern)), p).otherwise(verb)
    return t.withColumn("b", between).withColumn("p", verb).filter("p IS NOT NULL").select("id", "s", "p", "o")


def cooccurrences(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, s, o): pairs of entities that share a sentence, in order of discovery, unless a verb relates them; each sentence counts."""
    found = materialize(_discovered(texts, id_col, text_col), "entities")
    return _cooccurrences(found, _relations(found))


def _cooccurrences(found: DataFrame, r: DataFrame) -> DataFrame:
    t = found.select("id", "es", F.explode(F.filter(F.split("low", r"[.!?\n]+"), lambda x: F.length(F.trim(x)) > 5)).alias("sentence"))
    here = F.filter("es", lambda e: F.contains(F.col("sentence"), e))
    t = t.select("id", here.alias("h"))
    pairs = F.flatten(F.transform("h", lambda a, i: F.transform(F.filter("h", lambda b, j: j > i), lambda b: F.struct(a.alias("s"), b.alias("o")))))
    t = t.select("id", F.explode(pairs).alias("x")).select("id", "x.s", "x.o")
    either = r.select("id", "s", "o").unionByName(r.select("id", F.col("o").alias("s"), F.col("s").alias("o"))).distinct()
    return t.join(either, ["id", "s", "o"], "left_anti")


def triples(entries: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(s, p, o, src): mentions, verb relations and co-occurrences of entries."""
    found = materialize(_discovered(entries, id_col, text_col), "entities")  # read again by each of the three
    r = _relations(found)
    m = found.select(F.col("id").cast("string").alias("s"), F.lit("mentions").alias("p"), F.explode("es").alias("o"), F.col("id").alias("src"))
    c = _cooccurrences(found, r).select("s", F.lit("related_to").alias("p"), "o", F.col("id").alias("src"))
    return m.unionByName(r.select("s", "p", "o", F.col("id").alias("src"))).unionByName(c)
