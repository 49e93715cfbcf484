"""The partitioned store: replicating placement of triples, vertical partitions, indexes and statistics."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.functions.terms import RDF_TYPE, is_literal
from tessera.operators.graph import instance_types
from tessera.operators.keyed import KeyedGraph
from tessera.operators.lineage import cut, exists, tidy
from tessera.operators.stats import set_stats
from tessera.operators.wide import WideGraph, from_rows, tables_of, to_rows

#: Rows of the class index up to which it is broadcast; beyond, it is joined like any table.
BROADCAST_ROWS = 100_000
#: Terms are written as differences from the term before, compressed: sorted terms share most of their characters.
FORMAT = {"parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}


def _small(index: DataFrame) -> DataFrame:
    return F.broadcast(index) if index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else index


def node_partitions(triples: DataFrame, class_index: DataFrame) -> DataFrame:
    """(uri, parts array): the partitions of all classes of a node."""
    own = instance_types(triples).join(_small(class_index), "class")
    return own.groupBy("uri").agg(F.collect_set("part_id").alias("parts"))


def place(triples: DataFrame, class_index: DataFrame, residual: int) -> DataFrame:
    """(s, p, o, part_id), a set if triples are one: place_sets, with a row for each partition of a triple."""
    return spread(place_sets(triples, class_index, residual))


def spread(sets: DataFrame) -> DataFrame:
    """(s, p, o, part_id) of (s, p, o, part_ids)."""
    return sets.select("s", "p", "o", F.explode(F.split("part_ids", "-").cast("array<int>")).alias("part_id"))


def place_sets(triples: DataFrame, class_index: DataFrame, residual: int) -> DataFrame:
    """(s, p, o, part_ids): a row for each triple, with its partitions in order, joined by '-'.

    An edge goes to every partition of either end, a literal and a type to every partition of the subject. What has
    no partition that way (untyped nodes) goes to the residual one, so no triple is lost. Every triple that touches an
    instance of a class is then in each partition that has the class. The partitions of a triple are joined as arrays,
    so no distinct over the copies is needed.
    """
    where = cut(node_partitions(triples, class_index))
    subject = where.select(F.col("uri").alias("s"), F.col("parts").alias("parts_s"))
    target = where.select(F.col("uri").alias("o"), F.col("parts").alias("parts_o"))
    is_edge = (F.col("p") != RDF_TYPE) & ~is_literal(F.col("o"))
    none = F.array().cast("array<int>")
    own = triples.select("s", "p", "o")
    edges = own.where(is_edge).join(subject, "s", "left").join(target, "o", "left")
    both = F.array_union(F.coalesce("parts_s", none), F.coalesce("parts_o", none))
    rest = own.where(~is_edge).join(subject, "s", "left")
    placed = edges.select("s", "p", "o", both.alias("parts")).unionByName(rest.select("s", "p", "o", F.coalesce("parts_s", none).alias("parts")))
    parts = F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.array(F.lit(residual)))
    return placed.select("s", "p", "o", F.array_join(F.array_sort(parts), "-").alias("part_ids"))


def node_index(triples: DataFrame) -> DataFrame:
    """(uri, class)."""
    return instance_types(triples)


def vertical_index(placed: DataFrame) -> DataFrame:
    """(part_id, uri, role, p): the predicates of which a node is subject (s) or object (o), within a partition.

    Resources only; a class is the object of rdf:type.
    """
    subjects = placed.select("part_id", F.col("s").alias("uri"), F.lit("s").alias("role"), "p")
    objects = placed.where(~is_literal(F.col("o"))).select("part_id", F.col("o").alias("uri"), F.lit("o").alias("role"), "p")
    return subjects.unionByName(objects).distinct()


def vertical_index_text(index: DataFrame) -> DataFrame:
    """(part_id, uri, preds): role and predicate run together, sorted, comma-joined."""
    preds = F.array_join(F.array_sort(F.collect_set(F.concat("role", "p"))), ",")
    return index.groupBy("part_id", "uri").agg(preds.alias("preds"))


def vertical_marks(sets: DataFrame) -> DataFrame:
    """(uri, marks array<struct<part_id, role, p>>): the vertical index of place_sets' rows, with a row for each node."""
    ends = F.array(F.struct(F.col("s").alias("uri"), F.lit("s").alias("role")), F.when(~is_literal(F.col("o")), F.struct(F.col("o").alias("uri"), F.lit("o").alias("role"))))
    each = sets.select(F.explode(ends).alias("e"), "p", "part_ids").where("e is not null").select("e.*", "p", "part_ids").distinct()
    each = each.select("uri", "role", "p", F.explode(F.split("part_ids", "-").cast("array<int>")).alias("part_id"))
    return each.groupBy("uri").agg(F.collect_set(F.struct("part_id", "role", "p")).alias("marks"))


def marks_text(marks: DataFrame) -> DataFrame:
    """(part_id, uri, preds): vertical_index_text of the index with a row for each node, without gathering rows."""
    each = marks.select("uri", "marks", F.explode(F.array_distinct(F.transform("marks", lambda m: m["part_id"]))).alias("part_id"))
    own = F.transform(F.filter("marks", lambda m: m["part_id"] == F.col("part_id")), lambda m: F.concat(m["role"], m["p"]))
    return each.select("part_id", "uri", F.array_join(F.array_sort(own), ",").alias("preds"))


def replication(placed: DataFrame, triples: DataFrame) -> DataFrame:
    """One row: (stored, distinct_triples, replication_factor)."""
    stored = placed.agg(F.count("*").alias("stored"))
    own = triples.agg(F.count("*").alias("distinct_triples"))  # triples are a set
    return stored.crossJoin(own).withColumn("replication_factor", F.round(F.col("stored") / F.col("distinct_triples"), 6))


@dataclass
class Store:
    """A written store: folders placed, class_index, node_index, vertical_index, stats.

    Triples are placed by part_ids and p: partitions that hold the same triples share their files, part_ids names all
    partitions of a folder's triples, and a partition is the folders that name it. So a triple is written once, however many
    partitions have it. Those of a virtual graph are placed as tables by class (`wide`), which the folder `layout` describes;
    their node index is the tables' keys.
    """

    spark: SparkSession
    path: str

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @cached_property
    def graph(self) -> WideGraph | None:
        """The tables by class, if the store has such."""
        if not exists(self.spark, f"{self.path}/layout/_SUCCESS"):
            return None
        return WideGraph(self.spark, self.path, from_rows(json.loads(self._read("layout").first()[0])))

    @property
    def placed(self) -> DataFrame:
        """(s, p, o, part_id): every partition's triples."""
        return spread(self.held)

    @property
    def held(self) -> DataFrame:
        """(s, p, o, part_ids): every triple once."""
        if self.graph:
            return self.graph.held()
        return self.spark.read.schema("s string, o string, part_ids string, p string").parquet(f"{self.path}/placed").select("s", "p", "o", "part_ids")

    def partition(self, part: int) -> DataFrame:
        """held, of the folders of one partition alone."""
        return self.held.where(F.array_contains(F.split("part_ids", "-"), str(part)))

    @property
    def class_index(self) -> DataFrame:
        return self._read("class_index")

    @property
    def node_index(self) -> DataFrame:
        return self.graph.node_index() if self.graph else self._read("node_index")

    def classes_of(self, terms: list[str]) -> dict[str, set[str]]:
        """The classes of some nodes."""
        if self.graph:
            return self.graph.classes_of(terms)
        out: dict[str, set[str]] = {}
        for r in self.node_index.where(F.col("uri").isin(terms)).collect():
            out.setdefault(r.uri, set()).add(r["class"])
        return out

    @property
    def vertical_marks(self) -> DataFrame:
        """(uri, marks): a row for each node."""
        return self.graph.marks() if self.graph else self._read("vertical_index")

    @property
    def vertical_index(self) -> DataFrame:
        """(part_id, uri, role, p)."""
        return self.vertical_marks.select("uri", F.explode("marks").alias("m")).select("m.part_id", "uri", "m.role", "m.p")

    def predicates_of(self, term: str, role: str, part: int) -> list[str]:
        """The predicates that the vertical index has for a node in a role, in one partition."""
        marks = self.graph.marks(term) if self.graph else self.vertical_marks.where(F.col("uri") == term)
        own = marks.select(F.explode("marks").alias("m")).select("m.*").where((F.col("role") == role) & (F.col("part_id") == part))
        return sorted(r.p for r in own.select("p").distinct().collect())

    @property
    def stats(self) -> DataFrame:
        """(part_id, p, rows, subjects, objects)."""
        return self._read("stats")

    def exists(self) -> bool:
        try:
            self._read("complete")
            return True
        except AnalysisException:
            return False

    def write(self, df: DataFrame, name: str, *folders: str) -> None:
        df.write.mode("overwrite").options(**FORMAT).partitionBy(*folders).parquet(f"{self.path}/{name}")


def write_store(spark: SparkSession, path: str, triples: DataFrame, class_index: DataFrame, residual: int) -> Store:
    """Writes a store unless a complete one is there.

    One job writes all vertical partitions: rows are rebalanced by partitions and predicate, so that Spark splits large
    tables over several files and gathers small ones, and files are sorted by subject so that row groups can be skipped.
    """
    store = Store(spark, path)
    if store.exists():
        return store
    placed = place_sets(triples, class_index, residual).hint("rebalance", "part_ids", "p").sortWithinPartitions("part_ids", "p", "s", "o")
    store.write(placed, "placed", "part_ids", "p")
    del placed
    tidy(spark)
    store.write(node_index(store.held).sortWithinPartitions("uri"), "node_index")
    store.write(vertical_marks(store.held).repartitionByRange("uri").sortWithinPartitions("uri"), "vertical_index")
    tidy(spark)
    return _finish(store, class_index, set_stats(store.held))


def write_keyed(spark: SparkSession, path: str, own: KeyedGraph, class_index: DataFrame, residual: int) -> Store:
    """write_store of a virtual graph: its nodes go from the tables' rows to a table for each class, which has all triples of
    a node in one row; the indexes and statistics are read from these tables."""
    store = Store(spark, path)
    if store.exists():
        return store
    tables = []
    for n, (table, rows) in enumerate(tables_of(own, class_index, residual)):
        store.write(rows, f"placed/{n}")
        tables.append(replace(table, named=store._read(f"placed/{n}").limit(1).count() > 0))
    del rows
    tidy(spark)
    store.write(spark.createDataFrame([(json.dumps(to_rows(tables)),)], "layout string").coalesce(1), "layout")
    store = Store(spark, path)
    for n in range(len(tables)):
        keys = store.graph.indexed(n)
        if keys is not None:
            store.write(keys.sortWithinPartitions("key"), f"vertical_index/{n}")
            del keys
            tidy(spark)
    return _finish(store, class_index, store.graph.stats())


def _finish(store: Store, class_index: DataFrame, stats: DataFrame) -> Store:
    store.write(class_index, "class_index")
    store.write(stats.coalesce(1), "stats")
    store.write(store.stats.groupBy("part_id").agg(F.sum("rows").alias("rows")), "complete")
    return store
