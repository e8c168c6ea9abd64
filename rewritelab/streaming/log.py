"""Incremental processing of append-only logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> None:
    """Run ``work`` on lines that have come since the last call and whose keys the sink lacks; safe to run again.

    The checkpoint tells which files are read; the anti-join against the sink makes a repeated batch harmless.
    """

    def batch(df: DataFrame, _: int) -> None:
        new = df.dropDuplicates(keys)
        try:
            done = spark.read.parquet(sink).select(*keys)
            new = new.join(done, keys, "left_anti")
        except Exception as e:  # only the first batch finds no sink
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        work(new).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).json(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def versioned(df: DataFrame, prompt: str) -> DataFrame:
    """Partition column of a verdict cache: a changed prompt leaves the old entries behind."""
    return df.withColumn("prompt_hash", F.left(F.md5(F.lit(prompt)), F.lit(8)))


def running_counters(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str) -> None:
    """Counters by step of a reward log, kept up to date in a memory table."""
    log = spark.readStream.schema(schema).json(source)
    sums = log.groupBy("step").agg(F.count("*").alias("n"), F.avg("reward").alias("mean_reward"), F.sum("critical").alias("critical"), F.sum("minor").alias("minor"))
    sums.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
