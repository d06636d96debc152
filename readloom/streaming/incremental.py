"""Structured Streaming: additive tables that grow with each micro-batch, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readloom.operators import intervals, kmers


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """Running k-mer counts of a stream of reads; state is one row a k-mer."""
    return kmers.count(reads, k)


def depth_deltas(spans: DataFrame) -> DataFrame:
    """Running depth changes of a stream of placed spans."""
    return intervals.depth_changes(spans)


def append_counts(reads: DataFrame, path: str, checkpoint: str, k: int) -> StreamingQuery:
    """Write each micro-batch's k-mer counts under its number, so that a batch that is run again replaces itself.

    Counts of the whole stream are the sums over the batches: ``total_counts``.
    """

    def write(batch: DataFrame, number: int) -> None:
        kmers.count(batch, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_counts(stored: DataFrame) -> DataFrame:
    return stored.groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
