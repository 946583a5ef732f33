"""Source files to code-graph nodes and edges: Python by its own grammar, C# and JavaScript by a subset of theirs."""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.session import python_path

LANGUAGES = {"py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "cs": "csharp"}
ROW = "what string, kind string, name string, qualified_name string, file_path string, line_start int, line_end int, language string, signature string, parent_name string, source_qualified string, target_qualified string, line int"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]


class _Rows(list):
    def node(self, kind, name, qualified, path, a, b, lang, signature=None, parent=None) -> None:
        self.append(("node", kind, name, qualified, path, a, b, lang, signature, parent, None, None, None))

    def edge(self, kind, source, target, path, line) -> None:
        self.append(("edge", kind, None, None, path, None, None, None, None, None, source, target, line))


def _callee(f: ast.expr) -> str | None:
    return ast.unparse(f) if isinstance(f, ast.Name | ast.Attribute) else None


def _python(path: str, text: str, out: _Rows) -> None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    testing = posixpath.basename(path).startswith("test_") or "/tests/" in path

    def calls(node: ast.AST, owner: str) -> None:
        for x in ast.walk(node):
            if isinstance(x, ast.Call) and (name := _callee(x.func)):
                out.edge("CALLS", owner, name, path, x.lineno)
                if testing and owner.rpartition(".")[2].rpartition("::")[2].startswith("test"):
                    out.edge("TESTED_BY", name, owner, path, x.lineno)

    def visit(body: list[ast.stmt], owner: str | None) -> None:
        for x in body:
            if isinstance(x, ast.ClassDef):
                q = f"{owner or path}{'.' if owner else '::'}{x.name}"
                out.node("Class", x.name, q, path, x.lineno, x.end_lineno, "python", None, owner)
                for b in x.bases:
                    if name := _callee(b):
                        out.edge("INHERITS", q, name, path, x.lineno)
                if owner:
                    out.edge("CONTAINS", owner, q, path, x.lineno)
                visit(x.body, q)
            elif isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                q = f"{owner or path}{'.' if owner else '::'}{x.name}"
                kind = ("Constructor" if x.name == "__init__" else "Method") if owner else "Function"
                out.node(kind, x.name, q, path, x.lineno, x.end_lineno, "python", f"{x.name}({ast.unparse(x.args)})", owner)
                if owner:
                    out.edge("CONTAINS", owner, q, path, x.lineno)
                calls(x, q)
            elif isinstance(x, ast.Import):
                for a in x.names:
                    out.edge("IMPORTS", path, a.name, path, x.lineno)
            elif isinstance(x, ast.ImportFrom):
                out.edge("IMPORTS", path, "." * x.level + (x.module or ""), path, x.lineno)

    visit(tree.body, None)


TYPE = re.compile(r"\b(class|interface|enum|struct)\s+([A-Za-z_]\w*)(?:\s*<[^>{]*>)?(?:\s*(?::|extends)\s*([\w.<>, ]+?))?(?:\s+implements\s+([\w.<>, ]+?))?\s*\{")
FUNCTION = re.compile(r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(([^)]*)\)|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b[^(]*)?\(([^)]*)\)\s*(?:=>|\{)")
METHOD = re.compile(r"^[ \t]+(?:(?:public|private|protected|internal|static|async|override|virtual|abstract|sealed|readonly|get|set)\s+)*(?:[\w<>\[\],.?]+\s+)?([A-Za-z_$][\w$]*)\s*\(([^)\n]*)\)\s*(?::\s*[\w<>\[\]. |]+)?\s*(?:\{|=>)", re.M)
CALL = re.compile(r"\b([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")
IMPORT = re.compile(r"""\bimport\s+(?:[\w${},*\s]+\s+from\s+)?["']([^"']+)["']|\brequire\(\s*["']([^"']+)["']\s*\)|^\s*using\s+([\w.]+)\s*;""", re.M)
NOT_CALLS = frozenset("if for while switch catch function return typeof new using lock foreach await require super import".split())


def _braces(path: str, text: str, lang: str, out: _Rows) -> None:
    clean = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    line = lambda i: clean.count("\n", 0, i) + 1

    def end_of(i: int) -> int:
        depth = 0
        for m in re.finditer(r"[{}]", clean[i:]):
            depth += 1 if m[0] == "{" else -1
            if depth <= 0:
                return i + m.end()
        return len(clean)

    types, members = [], []
    for m in TYPE.finditer(clean):
        stop = end_of(m.end() - 1)
        q = f"{path}::{m[2]}"
        types.append((m.start(), stop, q))
        out.node("Interface" if m[1] == "interface" else "Class", m[2], q, path, line(m.start()), line(stop), lang)
        for base in re.split(r"\s*,\s*", ",".join(x for x in (m[3], m[4]) if x)):
            if base.strip():
                out.edge("INHERITS", q, base.strip(), path, line(m.start()))
    for m in [*METHOD.finditer(clean), *FUNCTION.finditer(clean)]:
        groups = [g for g in m.groups() if g is not None] or [""]
        name = groups[0]
        if not name or name in NOT_CALLS:
            continue
        owner = max((t for t in types if t[0] < m.start() < t[1]), default=None)
        free = m.re is FUNCTION
        if not free and owner is None:
            continue
        q = f"{owner[2]}.{name}" if owner and not free else f"{path}::{name}"
        stop = end_of(clean.find("{", m.start())) if "{" in clean[m.start() : m.end() + 200] else m.end()
        kind = "Function" if free else "Constructor" if name == "constructor" or (owner and name == owner[2].rpartition("::")[2]) else "Method"
        out.node(kind, name, q, path, line(m.start()), line(stop), lang, f"{name}({groups[1] if len(groups) > 1 else ''})", owner[2] if owner and not free else None)
        if owner and not free:
            out.edge("CONTAINS", owner[2], q, path, line(m.start()))
        members.append((m.start(), stop, q, m.end()))
    for m in CALL.finditer(clean):
        if m[1] not in NOT_CALLS and (own := max((x for x in members if x[3] <= m.start() < x[1]), default=None)):
            out.edge("CALLS", own[2], m[1], path, line(m.start()))
    for m in IMPORT.finditer(text):
        out.edge("IMPORTS", path, next(g for g in m.groups() if g), path, text.count("\n", 0, m.start()) + 1)


def parse(path: str, text: str | None) -> list[tuple]:
    """Rows of a file: its own node, those within, and edges."""
    path = path.replace("\\", "/")
    lang = LANGUAGES.get(path.rpartition(".")[2].lower())
    out = _Rows()
    if lang and text is not None:
        out.node("File", posixpath.basename(path), path, path, 1, text.count("\n") + 1, lang)
        _python(path, text, out) if lang == "python" else _braces(path, text, lang, out)
    return out


def code_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in parse(p, c)], columns=COLUMNS).astype({"line_start": "Int32", "line_end": "Int32", "line": "Int32"})

    python_path(files.sparkSession)
    rows = files.select("path", "content").mapInPandas(run, ROW)
    return rows.filter("what = 'node'").select(*COLUMNS[1:10]), rows.filter("what = 'edge'").select("kind", "source_qualified", "target_qualified", "file_path", "line")


def resolve_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """IMPORTS edges with relative targets resolved to known files, trying extensions and index files; others stay as written."""
    path = F.regexp_replace("file_path", "/[^/]*$", "")
    steps = F.split(F.concat_ws("/", path, "target_qualified"), "/")
    norm = F.aggregate(steps, F.array().cast("array<string>"), lambda a, p: F.when((p == ".") | (p == ""), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)), lambda a: F.array_join(a, "/"))
    e = edges.filter("kind = 'IMPORTS'").withColumn("base", F.when(F.col("target_qualified").startswith("."), norm))
    e = e.withColumn("eid", F.xxhash64("file_path", "target_qualified", "line"))
    tries = e.filter("base IS NOT NULL").select("eid", "base", F.posexplode(F.array(*(F.lit(x) for x in ("", ".js", ".ts", ".jsx", ".tsx", ".py", "/index.js", "/index.ts")))).alias("ord", "ext"))
    known = files.select(F.regexp_replace("path", "^/+", "").alias("cand"), F.col("path").alias("found"))
    best = tries.withColumn("cand", F.regexp_replace(F.concat("base", "ext"), "^/+", "")).join(known, "cand").groupBy("eid").agg(F.min_by("found", "ord").alias("found"))
    return e.join(best, "eid", "left").select("kind", "source_qualified", F.coalesce("found", "target_qualified").alias("target_qualified"), "file_path", "line")
