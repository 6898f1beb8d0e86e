"""Incremental index: micro-batches of symbol documents merged into the current table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweir.operators.store import current


def start(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, buckets: int = 64):
    """Follow a folder of Parquet deliveries. The table is partitioned by a hash of the id, and a batch rewrites only
    the partitions of the ids it brings, so its cost follows the batch and not the table."""

    def merge(batch: DataFrame, number: int) -> None:
        own = batch.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # at most buckets values
        if not touched:
            return
        held = spark.read.parquet(table).where(F.col("bucket").isin(touched)) if _exists(spark, table) else None
        rows = own if held is None else held.unionByName(own)
        merged = current(rows).checkpoint()
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
