"""Folders of any file system that Spark reaches, through Hadoop's file system API; and local query files."""

from __future__ import annotations

from bisect import bisect_right
from pathlib import Path

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

from tessera.plans.sparql import SparqlSyntaxError, UnsupportedSparql, parse
from tessera.sources.ntriples import list_files


def _at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> bool:
    """Removes a file or a whole folder; False if there was none."""
    fs, where = _at(spark, path)
    return fs.delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    fs, where = _at(spark, path)
    return fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(to))


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is directly in a folder, sorted; none if there is no such folder."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def count_folders(spark: SparkSession, path: str) -> int:
    fs, where = _at(spark, path)
    return sum(s.isDirectory() for s in fs.listStatus(where)) if fs.exists(where) else 0


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    fs, where = _at(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def is_valid_query(text: str) -> bool:
    """Whether the parser takes it. Quotes need no care: constants never become part of SQL text that runs."""
    try:
        parse(text)
    except (SparqlSyntaxError, UnsupportedSparql):
        return False
    return True


def queries_by_size(folder: str) -> dict[int, list[str]]:
    """Number of patterns -> query files of a local folder; files that aren't queries come under 0."""
    out: dict[int, list[str]] = {}
    for f in list_files(folder):
        text = Path(f).read_text(errors="replace")
        out.setdefault(len(parse(text).patterns) if is_valid_query(text) else 0, []).append(f)
    return out


def range_of(bounds: list[str], key: str) -> int:
    """The range that a key is in: the number of the first bound above it, or that of the last range."""
    return bisect_right(bounds, key)
