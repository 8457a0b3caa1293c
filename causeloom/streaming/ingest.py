"""Streams of pages, sentences and events through the batch operators.

State is bounded by a watermark: a URL or text that comes again after it counts as new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import curation


def unseen(rows: DataFrame, column: str, time: str, within: str) -> DataFrame:
    """The first row of each value of a column within a time."""
    keyed = rows.where(F.col(column).isNotNull()).withColumn("__key", F.sha2(F.col(column).cast("string"), 256))
    return keyed.withWatermark(time, within).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def good_sentences(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, place, sentence, quality) of a stream of documents (doc_id, text), without state."""
    return curation.split_sentences(docs).withColumn("quality", curation.quality(F.col("sentence"))).where(F.col("quality") >= least)


def transitions(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(begins, src, dst, n): how often one event type follows another for a user within a window.

    A window's events of a user are gathered until the watermark passes it, then put in order.
    """
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    runs = stamped.groupBy(F.window("ts", window).alias("w"), "user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    pairs = F.transform(F.filter(F.sequence(F.lit(1), F.size("e") - 1), lambda k: k > 0), lambda k: F.struct(
        F.element_at("e", k)["event_type"].alias("src"), F.element_at("e", k + 1)["event_type"].alias("dst")))
    return runs.where(F.size("e") > 1).select(F.col("w.start").alias("begins"), F.inline(pairs))


def append(rows: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stream to a folder; begun again with the same checkpoint it goes on where it ended."""
    writer = rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
