"""Breadth-first levels, betweenness and class importance, as level-synchronous joins over edges.

Edges are taken undirected; parallel edges count for shortest paths each; loops have no effect.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import cut
from tessera.operators.stats import normalized


def adjacency(edges: DataFrame) -> DataFrame:
    """(a, b, mult) in both directions; mult counts parallel edges of any predicate."""
    own = edges.where("src <> dst")
    both = own.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(own.select("dst", "src"))
    return both.groupBy("a", "b").agg(F.count("*").alias("mult"))


def bfs_levels(edges: DataFrame, sources: DataFrame | None = None) -> list[DataFrame]:
    """For each level (root, v, sigma): the vertices at that distance, and how many shortest paths lead there.

    sources(v): the roots; all vertices if not given. A level is one join, one aggregation and one anti-join with the
    two levels before: in an undirected graph a neighbour of level k is in level k - 1, k or k + 1.
    """
    near = cut(adjacency(edges))
    roots = sources if sources is not None else edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct()
    level = cut(roots.select(F.col("v").alias("root"), "v", F.lit(1.0).alias("sigma")))
    levels = [level]
    while True:
        step = level.join(near, level.v == near.a).groupBy("root", F.col("b").alias("v")).agg(F.sum(F.col("sigma") * F.col("mult")).alias("sigma"))
        known = reduce(DataFrame.union, [x.select("root", "v") for x in levels[-2:]])
        level = cut(step.join(known, ["root", "v"], "left_anti"))
        if level.isEmpty():
            return levels
        levels.append(level)


def bfs_distances(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(root, v, distance) of all reachable pairs."""
    return reduce(DataFrame.union, [x.select("root", "v", F.lit(k).alias("distance")) for k, x in enumerate(bfs_levels(edges, sources))])


def betweenness(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(v, bc): exact normalized betweenness of all components. vertices(v) adds isolated ones.

    Dependencies flow back level by level: a vertex gives each predecessor on shortest paths its share
    sigma(pred) * mult / sigma(v) * (1 + delta(v)).
    """
    every = edges.select(F.col("src").alias("v")).union(edges.select("dst"))
    every = cut((every if vertices is None else every.union(vertices.select("v"))).distinct())
    near = cut(adjacency(edges))
    levels = bfs_levels(edges)
    given: DataFrame | None = None
    sums: list[DataFrame] = []
    for k in range(len(levels) - 1, 0, -1):
        own = levels[k]
        own = own.withColumn("delta", F.lit(0.0)) if given is None else own.join(given, ["root", "v"], "left").fillna(0.0, ["delta"])
        own = cut(own)
        sums.append(own.groupBy("v").agg(F.sum("delta").alias("delta")))
        before = levels[k - 1].select("root", F.col("v").alias("u"), F.col("sigma").alias("sigma_u"))
        back = own.join(near, own.v == near.a).select("root", F.col("b").alias("u"), (F.col("mult") / F.col("sigma") * (1 + F.col("delta"))).alias("x"))
        back = back.join(before, ["root", "u"]).groupBy("root", F.col("u").alias("v")).agg(F.sum(F.col("x") * F.col("sigma_u")).alias("delta"))
        given = back
    n = every.count()
    pairs = (n - 1) * (n - 2) / 2
    total = every.select("v", F.lit(0.0).alias("delta"))
    total = reduce(DataFrame.unionByName, sums, total).groupBy("v").agg(F.sum("delta").alias("delta"))
    return total.select("v", (F.col("delta") / 2 / pairs if pairs > 0 else F.lit(0.0)).alias("bc"))


def class_importance(schema_vertices: DataFrame, bc: DataFrame, freq: DataFrame) -> DataFrame:
    """(class, bc, node_freq, importance): normalized betweenness plus normalized frequency over the schema's vertices."""
    own = schema_vertices.select(F.col("uri").alias("class"))
    joined = own.join(bc.withColumnRenamed("v", "class"), "class", "left").join(freq, "class", "left").fillna(0, ["bc", "node_freq"])
    ends = joined.agg(*[f(c).alias(f"{n}_{c}") for c in ("bc", "node_freq") for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    joined = joined.crossJoin(F.broadcast(ends))
    score = sum(normalized(F.col(c).cast("double"), F.col(f"lo_{c}").cast("double"), F.col(f"hi_{c}").cast("double")) for c in ("bc", "node_freq"))
    return joined.select("class", "bc", "node_freq", score.alias("importance"))


def top_k(importance: DataFrame, k: int, blacklist: tuple[str, ...] = ()) -> DataFrame:
    """The k most important classes whose IRI has 'http'; ties by IRI. blacklist leaves classes out by IRI."""
    own = importance.where(F.col("class").contains("http"))
    return (own.where(~F.col("class").isin(*blacklist)) if blacklist else own).orderBy(F.desc("importance"), "class").limit(k)
