"""Aggregates kept up as results arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a streaming aggregate after all that is there now; its rows are groups, few by nature."""
    name = f"drained_{uuid.uuid4().hex}"
    running = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    running.awaitTermination()
    return stream.sparkSession.table(name)


def running_matrix(results: DataFrame) -> DataFrame:
    """Counts for each variant and model over a stream of judged results; the state is one row a group."""
    return results.groupBy("variant", "model").agg(F.count("*").cast("long").alias("cases"), F.count_if("passed").cast("long").alias("passed"))


def matrix_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as arriving results, read as a stream and drained."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/event[s].parquet")
    arrived = events.select(F.col("event_type").alias("variant"), (F.col("user_id") % 3).cast("string").alias("model"), (F.col("value") > 50).alias("passed"))
    return drained(running_matrix(arrived))
