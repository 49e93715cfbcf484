"""Statistics of classes, predicates and partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import instance_edges, instance_types


def typed_edges(triples: DataFrame) -> DataFrame:
    """(src_class, p, dst_class, s, o): an edge for each pair of its ends' classes; both ends typed."""
    types = instance_types(triples)
    src = types.select(F.col("uri").alias("s"), F.col("class").alias("src_class"))
    dst = types.select(F.col("uri").alias("o"), F.col("class").alias("dst_class"))
    return instance_edges(triples).join(src, "s").join(dst, "o")


def class_cardinality(triples: DataFrame) -> DataFrame:
    """(src_class, p, dst_class, freq, distinct_objects).

    Edges are summed by object first, so that the count of distinct objects needs no second copy of the rows.
    """
    by_object = typed_edges(triples).groupBy("src_class", "p", "dst_class", "o").agg(F.count("*").alias("n"))
    return by_object.groupBy("src_class", "p", "dst_class").agg(F.sum("n").alias("freq"), F.count("*").alias("distinct_objects"))


def _endpoints(triples: DataFrame) -> DataFrame:
    """(uri, n): nodes with the number of edge ends there."""
    edges = instance_edges(triples)
    ends = edges.select(F.explode(F.array("s", "o")).alias("uri"))
    return ends.groupBy("uri").agg(F.count("*").alias("n"))


def class_endpoint_stats(triples: DataFrame) -> DataFrame:
    """(class, node_freq, node_count): typed nodes that an edge touches, and the edge ends at them."""
    return _endpoints(triples).join(instance_types(triples), "uri").groupBy("class").agg(F.count("*").alias("node_freq"), F.sum("n").alias("node_count"))


def class_node_freq(triples: DataFrame) -> DataFrame:
    return class_endpoint_stats(triples).select("class", "node_freq")


def class_node_count(triples: DataFrame) -> DataFrame:
    return class_endpoint_stats(triples).select("class", "node_count")


def table_stats(placed: DataFrame) -> DataFrame:
    """(part_id, p, rows, subjects, objects) of placed triples (s, p, o, part_id); distinct terms are approximate."""
    distinct = [F.approx_count_distinct(c).alias(n) for c, n in (("s", "subjects"), ("o", "objects"))]
    return placed.groupBy("part_id", "p").agg(F.count("*").alias("rows"), *distinct)


def set_stats(held: DataFrame) -> DataFrame:
    """table_stats of triples (s, p, o, part_ids) that are there once: sketches of distinct terms are merged by partition."""
    sketches = [F.hll_sketch_agg(c).alias(n) for c, n in (("s", "subjects"), ("o", "objects"))]
    by_set = held.groupBy("part_ids", "p").agg(F.count("*").alias("rows"), *sketches)
    each = by_set.withColumn("part_id", F.explode(F.split("part_ids", "-").cast("array<int>"))).groupBy("part_id", "p")
    merged = [F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in ("subjects", "objects")]
    return each.agg(F.sum("rows").alias("rows"), *merged)


def partition_stats(placed: DataFrame) -> DataFrame:
    return placed.groupBy("part_id").agg(F.count("*").alias("rows"))


def normalized(value: Column, least: Column, most: Column) -> Column:
    """Min-max normalization; 0 where all values are equal."""
    return F.when(most > least, (value - least) / (most - least)).otherwise(F.lit(0.0))
