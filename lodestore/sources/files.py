"""File sources and sinks: JSON lines, whole-JSON maps, file walks, versioned tables, text outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_FILE_BYTES = 50 * 1024 * 1024
SKIPPED_DIRS = ("node_modules", "bin", "obj", "dist", "build", "__pycache__", "venv", "packages", "target", "coverage")
SOURCE_TYPES = ("cs", "js", "mjs", "cjs", "jsx", "ts", "tsx", "py")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def jsonl_lines(spark: SparkSession, path: str | list[str], schema: T.StructType, max_bytes: int | None = None) -> DataFrame:
    """(file, value, row): each line and what it parses to; row.__bad tells of malformed lines. A missing path is an empty table.

    Large files are split like others. With ``max_bytes`` (such as ``MAX_FILE_BYTES``) larger ones are left out; ``oversized`` names them.
    """
    full = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    paths = [p for p in ([path] if isinstance(path, str) else path) if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], T.StructType([T.StructField("file", T.StringType()), T.StructField("value", T.StringType()), T.StructField("row", full)]))
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).filter("trim(value) <> ''")
    if max_bytes is not None:
        lines = lines.filter(F.col("size") <= max_bytes)
    return lines.select("file", "value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("row"))


def oversized(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(file, bytes) of the files that a limit leaves out; contents aren't read."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, bytes long")
    files = spark.read.format("binaryFile").load(path)
    return files.filter(F.col("length") > max_bytes).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, max_bytes: int | None = None) -> DataFrame:
    """The well-formed rows."""
    return jsonl_lines(spark, path, schema, max_bytes).filter("row.__bad IS NULL").select(*(F.col("row")[f.name].alias(f.name) for f in schema.fields))


def corrupt_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, good, bad) lines by file."""
    return jsonl_lines(spark, path, schema).groupBy("file").agg(F.count_if(F.col("row.__bad").isNull()).alias("good"), F.count_if(F.col("row.__bad").isNotNull()).alias("bad"))


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_json_map(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """(key, value) of a file that is one JSON object; what can't be parsed is an empty map."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"key string, value {value_type}")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value_type}>")).alias("key", "value"))


def walk(spark: SparkSession, root: str, types: tuple[str, ...] = SOURCE_TYPES, skipped: tuple[str, ...] = SKIPPED_DIRS) -> DataFrame:
    """(path, content) of source files under a folder, without hidden and generated folders."""
    glob = "*.{" + ",".join(types) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    parts = F.split(F.regexp_replace("path", "^[a-z]+:/*", ""), "/")
    hidden = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.startswith(".") | p.isin(*skipped))
    return files.filter(~hidden).select("path", F.decode("content", "UTF-8").alias("content"))


def file_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, content) whose hash isn't the known one (path, hash)."""
    f = files.withColumn("hash", file_hash(F.col("content")))
    return f.join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def projects(spark: SparkSession, root: str, name: str, schema: T.StructType, depth: int = 5, skipped: tuple[str, ...] = ("node_modules", ".git")) -> DataFrame:
    """The store ``name`` (a file, or a folder of part files) of every project down to ``depth`` folders under ``root``, with ``_project``, the folder above the store's."""
    lines = jsonl_lines(spark, [f"{root}{'/*' * i}/{name}" for i in range(depth + 1)], schema).filter("row.__bad IS NULL")
    inside = F.substring_index("file", root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    kept = lines.filter(~F.exists(F.split(inside, "/"), lambda p: p.isin(*skipped)))
    return kept.select(*(F.col("row")[f.name].alias(f.name) for f in schema.fields), F.regexp_extract("file", rf"([^/]+)/{name}(?:/[^/]*)?$", 1).alias("_project"))


def save_version(df: DataFrame, base: str, table: str) -> str:
    """Write a new version of a table under a shared folder; readers of the old one aren't disturbed. Returns its path."""
    path = f"{base}/{table}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def replace_section(document: Column, start: str, end: str, body: Column) -> Column:
    """Text between two markers replaced, or the section appended where they are missing."""
    section = F.concat(F.lit(start + "\n"), body, F.lit("\n" + end))
    i, j = F.locate(start, document), F.locate(end, document)
    inside = F.concat(F.substring_index(document, start, 1), section, F.expr("''"), document.substr(j + len(end), F.length(document)))
    return F.when((i > 0) & (j > i), inside).otherwise(F.concat(document, F.lit("\n"), section))


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """One text file of ordered lines: a range partition per task keeps the order over part files."""
    lines.orderBy(*order).select("line").write.text(path)


def safe_url(url: Column) -> Column:
    """http or https, with a host and no credentials."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^\s/@?#]+(?:[/?#].*)?$"), F.lit(False))
