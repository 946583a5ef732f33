"""Variable parts of commands as named parameters.

Names depend on what stands before a value and on the names a command has already used, which
column expressions can't carry along; Arrow batches do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.functions.text import blank
from lodestore.session import python_path

UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
# fixed values: what the text before an id says of it
BEFORE = ((r"repositor(?:y|ies)/?$", "repo_id"), (r"projects?/?$", "project_id"), (r"builds?/?$", "build_id"), (r"pullrequests?/?$", "pr_id"), (r"--resource\s+$", "resource_id"))
#: in order: ids, numbered resources, Windows and Unix paths, long JSON values
RULES = (
    ("uuid", re.compile(f"({UUID})", re.I)),
    ("resource", re.compile(r"/(build|log|run|pullrequest|workitem|iteration)s/(\d+)", re.I)),
    ("path", re.compile(r'"([A-Z]:\\[^"]{10,})"')),
    ("path", re.compile(r'"(/(?:tmp|home|var|usr|opt)/[^"]{10,})"')),
    ("json", re.compile(r'"(title|description|name|message|value)":\s*"([^"]{20,})"', re.I)),
)


class Value(NamedTuple):
    """A variable part of a command: where it is, what to call it, and the fewest characters that make one."""

    start: int
    end: int
    name: str
    description: str
    least: int = 0


def values(command: str) -> Iterator[Value]:
    """What each rule finds in the command as it is, rule by rule."""
    for kind, pattern in RULES:
        for m in pattern.finditer(command):
            if kind == "uuid":
                before = command[max(0, m.start() - 50) : m.start()]
                name = next((n for p, n in BEFORE if re.search(p, before, re.I)), "uuid")
                yield Value(*m.span(1), name, name.replace("_", " "))
            elif kind == "path":
                yield Value(*m.span(1), "file_path", "file path", 10)
            else:
                name, what = (f"{m[1]}_id", f"{m[1]} ID") if kind == "resource" else (m[1], f"{m[1]} text")
                yield Value(*m.span(2), name, what, 1 if kind == "resource" else 20)


def filled(command: str, start: int, end: int, named: list[tuple[Value, str]]) -> str:
    """command[start:end] with the outermost of the named values in it replaced by their names."""
    out, at = [], start
    for v, name in sorted(named, key=lambda x: (x[0].start, -x[0].end)):
        if at <= v.start and v.end <= end:
            out += [command[at : v.start], "{{", name, "}}"]
            at = v.end
    return "".join([*out, command[at:end]])


def parameterize(command: str) -> tuple[str, list[dict[str, str]]]:
    """(template, parameters in order); a name that is taken gets a number.

    A value may contain those of earlier rules, if enough of it is left; one that overlaps them otherwise is none.
    """
    named: list[tuple[Value, str]] = []
    params = []
    for v in values(command):
        clash = any(x.start < v.end and v.start < x.end and not (v.start <= x.start and x.end <= v.end) for x, _ in named)
        default = filled(command, v.start, v.end, named)
        if clash or len(default) < v.least:
            continue
        n = 1 + sum(x.name == v.name for x, _ in named)
        named.append((v, v.name if n == 1 else f"{v.name}_{n}"))
        params.append({"name": named[-1][1], "description": v.description, "default": default})
    return filled(command, 0, len(command), named), params


def parameterized(commands: DataFrame, id_col: str = "id", command_col: str = "command") -> DataFrame:
    """(id, template, parameters array<struct<name, description, default>>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [parameterize(c) for c in pdf["command"]]
            yield pd.DataFrame({"id": pdf["id"], "template": [t for t, _ in done], "parameters": [p for _, p in done]})

    python_path(commands.sparkSession)
    rows = commands.select(F.col(id_col).cast("long").alias("id"), blank(F.col(command_col)).alias("command"))
    return rows.mapInPandas(run, "id long, template string, parameters array<struct<name: string, description: string, default: string>>")
