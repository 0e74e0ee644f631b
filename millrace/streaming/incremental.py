"""Ingestion of a folder into which files are dropped, each id once. An extension: batch runs that resume do the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.resume import first_of


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, schema: str, key: str, order: str, fmt: str = "parquet", files: int = 64) -> int:
    """Add the new files' records to ``target`` (Parquet), of which the first of each key that is not there yet; rows now there.

    Micro-batches of at most ``files`` files; the checkpoint tells which files are done. A batch that is run again after a
    failure overwrites its own folder and sees the others only, so that it adds nothing twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        fresh = first_of(batch, [key], F.col(order))
        if number:  # the batches before this one have written their folders; only their keys are read
            there = spark.read.parquet(target).where(F.col("batch") != number).select(key)
            fresh = fresh.join(there, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(folder)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).count()
