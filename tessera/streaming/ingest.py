"""N-Triples files as a stream: new files of a folder are parsed and appended to a triple table by predicate.

Batch ingest reads a folder once; this keeps a table up to date as files arrive. Each micro-batch drops its own
duplicates and the triples that the table has, so the table stays a set and a batch may run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tessera.sources.ntriples import _TRIPLE


def triples_of(lines: DataFrame) -> DataFrame:
    part = lambda k: F.regexp_extract("value", _TRIPLE, k)
    return lines.where(F.col("value").rlike(_TRIPLE)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Starts the query over what is there now and ends when it is done (availableNow)."""

    def append(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates()
        try:
            known = spark.read.schema("s string, o string, p string").parquet(table)
            new = new.join(known, ["s", "p", "o"], "left_anti")
        except AnalysisException:
            pass  # the first batch: there is no table yet
        new.select("s", "o", "p").repartition("p").write.mode("append").partitionBy("p").parquet(table)

    stream = triples_of(spark.readStream.text(folder))
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
