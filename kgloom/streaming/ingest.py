"""Append-only ingest of relation rows with first-wins keys, as a Structured Streaming sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.session import small

KEY = ["start", "end", "rel", "weight"]


def ingest_relations(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Starts a query that appends relations of new keys to the Parquet folder path, partitioned by rel.

    A batch keeps the least source of a key, and drops keys that the folder holds in the batch's own relations only
    (partition pruning). A batch that is run again after a failure finds its rows written and adds none.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.where(F.col("start") != F.col("end")).groupBy(*KEY).agg(F.min("source").alias("source"))
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(hadoop) and len(fs.listStatus(hadoop)) > 0:
            held = spark.read.schema(new.schema).parquet(path).join(small(new.select("rel").distinct()), "rel", "left_semi")
            new = new.join(held.select(*KEY), KEY, "left_anti")
        new.write.mode("append").partitionBy("rel").parquet(path)

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
