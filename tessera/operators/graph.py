"""Graph views of triples: typed vertices, labels, edges, and the schema graph.

Triples are a set, as all sources give them, so the views of resources need no distinct of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.terms import RDF_TYPE, is_literal


def instance_types(triples: DataFrame) -> DataFrame:
    """(uri, class), a set."""
    return triples.where(F.col("p") == RDF_TYPE).select(F.col("s").alias("uri"), F.col("o").alias("class"))


def instance_edges(triples: DataFrame) -> DataFrame:
    """(s, p, o) between resources, types left out, a set."""
    return triples.where((F.col("p") != RDF_TYPE) & ~is_literal(F.col("o"))).select("s", "p", "o")


def literals(triples: DataFrame) -> DataFrame:
    return triples.where((F.col("p") != RDF_TYPE) & is_literal(F.col("o"))).select("s", "p", "o")


def instance_vertices(triples: DataFrame) -> DataFrame:
    """(uri, types array, labels array<struct<p, o>>): every subject, and every resource that is an object of an edge.

    A class doesn't become a vertex by being a type. One aggregation by uri, with each triple giving one or two rows.
    """
    kind = F.when(F.col("p") == RDF_TYPE, 0).when(is_literal(F.col("o")), 1).otherwise(2)
    label = F.struct("p", "o")
    subject = F.struct(F.col("s").alias("uri"), F.when(kind == 0, F.col("o")).alias("type"), F.when(kind == 1, label).alias("label"))
    target = F.struct(F.col("o").alias("uri"), F.lit(None).cast("string").alias("type"), F.when(F.lit(False), label).alias("label"))
    rows = triples.select(F.explode(F.when(kind == 2, F.array(subject, target)).otherwise(F.array(subject))).alias("v")).select("v.*")
    return rows.groupBy("uri").agg(F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_set("label")).alias("labels"))


def schema_vertices(schema: DataFrame) -> DataFrame:
    """(id, uri): ids from 0 in order of uri. Schemas have hundreds of vertices, so one task numbers them."""
    uris = schema.select(F.col("s").alias("uri")).union(schema.select("o")).distinct()
    return uris.select((F.row_number().over(Window.orderBy("uri")) - 1).cast("long").alias("id"), "uri")


def schema_edges(schema: DataFrame) -> DataFrame:
    """(src, dst, pred), distinct."""
    return schema.select(F.col("s").alias("src"), F.col("o").alias("dst"), F.col("p").alias("pred")).distinct()


def bidirectional(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, a bag."""
    return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "pred"))
