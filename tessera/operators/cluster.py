"""Balanced clustering of classes round centroids.

The greedy choice is sequential, and a schema has at most some thousands of classes, so it runs on the driver over rows
that are collected behind a check of their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Rows of ranked dependence (classes times centroids) that may be collected.
MOST_ROWS = 1_000_000


@dataclass(frozen=True)
class Ranked:
    node: str
    path: tuple[str, ...]  # the vertices on the path, ends included


def assign_classes(centroids: list[str], ranked: dict[str, list[Ranked]], counts: dict[str, int], total: int, max_sweeps: int = 200) -> dict[str, set[str]]:
    """centroid -> classes. A class may be in several clusters.

    Sweeps over the ranks: each centroid in turn takes its next class together with the classes on the path to it, if
    they fit below total / k instances, or the cluster is empty, or they fit within the tolerance. A sweep that leaves
    classes with instances over widens the tolerance, which always grows; after max_sweeps the rest goes to the
    smallest clusters. A cluster that stays empty gets its centroid, and centroids without any cluster get their own.
    """
    k = len(centroids)
    threshold = total / k
    slack = threshold / k
    clusters: dict[str, set[str]] = {c: set() for c in centroids}
    size = lambda c: sum(counts.get(x, 0) for x in clusters[c])
    pending = {r.node for rs in ranked.values() for r in rs} - set(centroids)
    for _ in range(max_sweeps):
        if not any(counts.get(x, 0) for x in pending):
            break
        for rank in range(max((len(rs) for rs in ranked.values()), default=0)):
            for c in centroids:
                if rank >= len(ranked.get(c, [])):
                    continue
                item = ranked[c][rank]
                if item.node not in pending:
                    continue
                new = set(item.path) - clusters[c]
                grown = size(c) + sum(counts.get(x, 0) for x in new)
                if not new or grown < threshold + slack or not clusters[c]:
                    clusters[c] |= new
                    pending.discard(item.node)
        slack = max(slack + 1, slack * (1 + 1 / k))
    every = set(counts) | {r.node for rs in ranked.values() for r in rs} | set(centroids)
    for c in centroids:
        if not clusters[c]:
            clusters[c].add(c)
    placed = set().union(*clusters.values())
    for c in centroids:
        if c not in placed:
            clusters[c].add(c)
    placed |= set(centroids)
    for node in sorted(every - placed):
        clusters[min(centroids, key=lambda c: (size(c), c))].add(node)
    return clusters


def class_index(spark: SparkSession, ranked: DataFrame, centroids: DataFrame, node_counts: DataFrame, total: int) -> DataFrame:
    """(class, part_id): partitions count from 0 in order of the centroids' importance."""
    n = ranked.count()
    if n > MOST_ROWS:
        raise ValueError(f"{n} ranked classes are more than the driver clusters; use fewer centroids")
    heads = [r["class"] for r in centroids.collect()]
    rows: dict[str, list[Ranked]] = {}
    for r in ranked.orderBy("root", "rank").collect():
        stops = tuple(dict.fromkeys(x for step in r.path for x in (step.src, step.dst)))
        rows.setdefault(r.root, []).append(Ranked(r.v, stops))
    counts = {r["class"]: r.node_count for r in node_counts.collect()}
    clusters = assign_classes(heads, rows, counts, total)
    out = sorted((name, k) for k, c in enumerate(heads) for name in clusters[c])
    return spark.createDataFrame(out, "class string, part_id int")
