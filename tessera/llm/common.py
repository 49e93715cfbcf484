"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, once for each application; the driver's file server hands it out.

    Operators whose functions run in workers call it, so that they don't depend on the workers' path.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        top = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="tessera-package-")) / "tessera.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for f in sorted(top.rglob("*.py")):
                out.write(f, f"{top.name}/{f.relative_to(top)}")
        context.addPyFile(str(archive))


def with_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; only on a local master, in tests, one is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, which survives the loss of executors."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more; it does so only once the
    driver's garbage is collected, which a driver with memory to spare may not do before the disks are full."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows of a narrow table (ids, hosts) up to which it is broadcast. They are counted; larger ones are joined by shuffles.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, checkpointed, and marked for a broadcast if it has at most that many rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of the caller can't clash with working names."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of edges(a long, b long): returns (node, root), root being the smallest node reachable.

    Alternating large-star and small-star rounds. Every round is one aggregation and joins on the node, with no
    group gathered in a task, and ends in a checkpoint. Nodes without edges aren't returned. Edges from a node to
    itself are ignored. Raises if the rounds don't converge.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: every larger neighbour of a node links to the least node of its neighbourhood
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        # small star: a node and its smaller neighbours link to the least of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small_least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(moved.unionByName(small_least.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now
    raise RuntimeError("connected components did not converge")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in the shared folder, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """df, written once as a table in the shared checkpoint folder and read again."""
    spark = df.sparkSession
    with_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
