"""The weighted schema graph, shortest paths from centroids, and the dependence of classes on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import bidirectional
from tessera.operators.lineage import cut
from tessera.operators.stats import normalized

_STEP = "struct<src:string,dst:string,pred:string>"


def weighted_edges(schema_edges: DataFrame, cardinality: DataFrame, importance: DataFrame) -> DataFrame:
    """(src, dst, pred, closeness, weight) in both directions.

    closeness = (1 + c) / c + distinct / freq of the edge's statistics, those of the reverse edge if it has none, and
    (1 + c) / c if neither has; c counts the schema's vertices. weight = importance(dst) / closeness.
    """
    edges = bidirectional(schema_edges).distinct()
    c = importance.count()
    own = cardinality.select(F.col("src_class").alias("src"), F.col("p").alias("pred"), F.col("dst_class").alias("dst"), (F.col("distinct_objects") / F.col("freq")).alias("ratio"))
    back = own.select(F.col("dst").alias("src"), "pred", F.col("src").alias("dst"), F.col("ratio").alias("ratio_back"))
    joined = edges.join(own, ["src", "pred", "dst"], "left").join(back, ["src", "pred", "dst"], "left")
    closeness = F.lit((1 + c) / c if c else 1.0) + F.coalesce("ratio", "ratio_back", F.lit(0.0))
    to = importance.select(F.col("class").alias("dst"), "importance")
    return joined.join(to, "dst").select("src", "dst", "pred", closeness.alias("closeness"), (F.col("importance") / closeness).alias("weight"))


def shortest_paths(edges: DataFrame, sources: DataFrame, max_rounds: int = 1_000) -> DataFrame:
    """(root, v, dist, path array<struct<src, dst, pred>>) from the sources(v) along edges(src, dst, pred, weight >= 0).

    Rounds of relaxation, each a join and an aggregation, from vertices whose entry got better in the round before.
    Of paths with one distance, that with fewer steps wins, then the smaller path.
    """
    lightest = cut(edges.groupBy("src", "dst").agg(F.min_by(F.struct("pred", "weight"), F.struct("weight", "pred")).alias("e")).select("src", "dst", "e.*"))
    best = cut(sources.select(F.col("v").alias("root"), "v", F.lit(0.0).alias("dist"), F.array().cast(f"array<{_STEP}>").alias("path")))
    changed = best
    rank = F.struct("dist", F.size("path").alias("hops"), "path")
    for _ in range(max_rounds):
        step = changed.join(lightest, changed.v == lightest.src).where("dst <> root")
        step = step.select("root", F.col("dst").alias("v"), (F.col("dist") + F.col("weight")).alias("dist"), F.concat("path", F.array(F.struct("src", "dst", "pred"))).alias("path"))
        both = best.withColumn("new", F.lit(False)).unionByName(step.withColumn("new", F.lit(True)))
        merged = both.groupBy("root", "v").agg(F.min_by(F.struct("dist", "path", "new"), F.struct(*[rank[x] for x in ("dist", "hops", "path")], "new")).alias("b"))
        merged = cut(merged.select("root", "v", "b.*"))
        best, changed = merged.drop("new"), merged.where("new").drop("new")
        if changed.isEmpty():
            return best
    raise RuntimeError("shortest paths did not settle; is a weight negative?")


def _span(root_importance: Column, dist: Column) -> Column:
    return root_importance - dist


def dependence(paths: DataFrame, importance: DataFrame) -> DataFrame:
    """(root, v, dist, hops, dependence): 1 / hops^2 times the min-max normalized importance(root) - dist.

    The extremes are taken over all pairs, a centroid's own included; targets that are centroids themselves are left
    out of the result.
    """
    scored = paths.join(importance.select(F.col("class").alias("root"), "importance"), "root").withColumn("diff", _span(F.col("importance"), F.col("dist")))
    ends = scored.agg(F.min("diff").alias("lo"), F.max("diff").alias("hi"))  # one row
    roots = paths.select(F.col("root").alias("v")).distinct()
    own = scored.join(roots, "v", "left_anti").crossJoin(F.broadcast(ends))
    value = normalized(F.col("diff"), F.col("lo"), F.col("hi")) / F.pow(F.size("path").cast("double"), 2)
    return own.select("root", "v", "dist", F.size("path").cast("long").alias("hops"), value.alias("dependence"), "path")


def ranked_dependence(dependent: DataFrame) -> DataFrame:
    """With rank: each root's classes by descending dependence, then IRI."""
    w = Window.partitionBy("root").orderBy(F.desc("dependence"), "v")
    return dependent.withColumn("rank", F.row_number().over(w).cast("long"))
