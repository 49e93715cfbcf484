"""Text sources and sinks: N-Triples, schema triples, and the small tab-separated tables of class statistics."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TERM = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
_TRIPLE = rf"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+{_TERM}\s*\.\s*(?:#.*)?$"


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o), a set: comments, blank and malformed lines are skipped, literals keep their spaces, tags and types."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)") & F.col("value").rlike(_TRIPLE))
    part = lambda k: F.regexp_extract("value", _TRIPLE, k)
    return lines.select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o")).dropDuplicates()


def read_schema(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of a schema file: three terms a line, white space between, without angle brackets; # starts a comment."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    terms = F.split(F.regexp_replace("v", r"\s*\.$", ""), r"\s+", 3)
    lines = lines.select(terms.alias("t")).where(F.size("t") == 3)
    iri = lambda k: F.when(F.get("t", F.lit(k)).startswith("<"), F.get("t", F.lit(k))).otherwise(F.concat(F.lit("<"), F.get("t", F.lit(k)), F.lit(">")))
    return lines.select(iri(0).alias("s"), iri(1).alias("p"), iri(2).alias("o")).dropDuplicates()


def write_ntriples(triples: DataFrame, path: str) -> None:
    triples.select(F.concat_ws(" ", "s", "p", "o", F.lit("."))).write.mode("overwrite").text(path)


def write_pairs(table: DataFrame, path: str) -> None:
    """A two-column table as tab-separated text, such as class statistics or the class index."""
    table.write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def read_pairs(spark: SparkSession, path: str, names: tuple[str, str], value: str = "string") -> DataFrame:
    """The table back; lines that don't parse are dropped."""
    table = spark.read.option("sep", "\t").option("quote", "").schema(f"k string, v {value}").csv(path)
    return table.where("k is not null and v is not null").toDF(*names)


def class_index_text(index: DataFrame) -> DataFrame:
    """(class, part_id) -> (class, 'id,id'), the file form of the class index."""
    return index.groupBy("class").agg(F.array_join(F.array_sort(F.collect_set("part_id")), ",").alias("parts"))


def read_class_index(spark: SparkSession, path: str) -> DataFrame:
    """(class, part_id) from its file form."""
    parts = F.split("parts", ",").cast("array<int>")
    return read_pairs(spark, path, ("class", "parts")).select("class", F.explode(parts).alias("part_id"))


def list_files(base: str, recursive: bool = True) -> list[str]:
    """Query files below a local folder, in order of path."""
    found = Path(base).rglob("*") if recursive else Path(base).glob("*")
    return sorted(str(p) for p in found if p.is_file())
