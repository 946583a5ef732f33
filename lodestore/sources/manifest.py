"""Numbered manifests of a folder: what a table consists of, switched in one step.

A writer puts its files under names of their own, then publishes a manifest that lists them under
the next number. Publishing renames a finished file and fails if that number is taken, so readers
see all of a change or nothing, and of two writers one loses. Files that no manifest lists are
leftovers of writers that failed; ``sweep`` deletes them.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class ConflictError(RuntimeError):
    """Another writer has published this version."""


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def latest(spark: SparkSession, root: str) -> int:
    """The newest version; 0 if there is none."""
    fs, p = _fs(spark, f"{root}/_manifest")
    if not fs.exists(p):
        return 0
    names = (f.getPath().getName() for f in fs.listStatus(p))
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)


def load(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict]:
    """(version, manifest); (0, {}) where nothing is published."""
    version = latest(spark, root) if version is None else version
    if version == 0:
        return 0, {}
    text = spark.read.text(f"{root}/_manifest/{version:08d}.json", wholetext=True).first()[0]
    return version, json.loads(text)


def publish(spark: SparkSession, root: str, version: int, manifest: dict) -> None:
    """Make ``manifest`` the given version, or raise ``ConflictError`` if there is one."""
    fs, part = _fs(spark, f"{root}/_manifest/.{version:08d}-{uuid.uuid4().hex}")
    out = fs.create(part, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    never_overwrite = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(part).toUri(), hadoop)
    try:
        files.rename(fs.makeQualified(part), fs.makeQualified(_fs(spark, f"{root}/_manifest/{version:08d}.json")[1]), never_overwrite)
    except Py4JJavaError as e:
        fs.delete(part, False)
        if "AlreadyExists" in str(e.java_exception.getClass().getName()):
            raise ConflictError(f"version {version} of {root} is taken") from e
        raise


def sweep(spark: SparkSession, root: str, used: set[str], keep: int = 2) -> list[str]:
    """Delete manifests but the newest ``keep`` and the folders of ``root`` that ``used`` doesn't name; run it while nobody writes."""
    fs, p = _fs(spark, root)
    newest = latest(spark, root)
    for f in fs.listStatus(_fs(spark, f"{root}/_manifest")[1]):
        name = f.getPath().getName()
        if name.startswith(".") or int(name.removesuffix(".json")) <= newest - keep:
            fs.delete(f.getPath(), False)
    gone = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName() != "_manifest" and f.getPath().getName() not in used]
    for g in gone:
        fs.delete(g, True)
    return [g.getName() for g in gone]
