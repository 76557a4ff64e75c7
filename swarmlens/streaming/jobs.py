"""Structured Streaming: micro-batched ingest, incremental near-duplicate edges, windows, sinks."""

from __future__ import annotations

import time

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmlens.operators.clustering import Clusters
from swarmlens.operators.index import SignatureIndex
from swarmlens.sources.adapters import parse_stream


def stream_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Event files as a stream with zoned event times; files a trigger bound the batch instead of dropping rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str = "6 minutes", late: str = "10 hours") -> DataFrame:
    """Counts by sliding window and type; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def incremental_pairs(posts: DataFrame, store: str, checkpoint: str, hashes: int = 128, bands: int = 16, threshold: float = 0.7):
    """Start a query that indexes each batch of posts (id, text) and appends its links (a, b, similarity), to earlier posts and to each other.

    A batch reads the buckets that its posts fall into, and the signatures of those it meets
    there.  A batch that is run again overwrites its own part, so a restart neither loses
    nor doubles rows.
    """
    index = SignatureIndex(posts.sparkSession, f"{store}/index", hashes, bands)

    def batch(df: DataFrame, n: int) -> None:
        near = index.similar(index.add(df.select("id", "text"), n), threshold)
        near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").distinct().write.mode("overwrite").parquet(f"{store}/edges/batch={n}")

    return posts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_clusters(posts: DataFrame, clusters: Clusters, checkpoint: str):
    """Start a query that adds each batch of posts (id, text) to ``clusters``; batches are numbered by the stream, so one that is run again replaces itself."""
    return posts.writeStream.foreachBatch(lambda df, n: clusters.add(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, size: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Counts by window and type in append mode: a window is given out once, when the watermark has passed it, and rows for windows that it has passed are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def without_repeats(events: DataFrame, key: str, late: str = "2 days") -> DataFrame:
    """The first row of each key; a key is remembered until the watermark is past its row's time and the delay, and later rows than the watermark are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def followed(left: DataFrame, right: DataFrame, key: str, within: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(key, left_id, right_id): rows of two streams (key, ts, id) with the same key, the right one at most ``within`` after the left one.

    Both sides have a watermark and the times bound each other, so Spark can forget rows that nothing can follow any more.
    """
    x = left.withWatermark("ts", late).select(F.col(key).alias("x_key"), F.col("ts").alias("x_ts"), F.col("id").alias("left_id"))
    y = right.withWatermark("ts", late).select(F.col(key).alias("y_key"), F.col("ts").alias("y_ts"), F.col("id").alias("right_id"))
    return x.join(y, F.expr(f"x_key = y_key AND y_ts >= x_ts AND y_ts <= x_ts + INTERVAL {within}")).select(F.col("x_key").alias(key), "left_id", "right_id")


def replayed(spark: SparkSession, parts: list[DataFrame], folder: str, start) -> None:
    """Write each of some tables to a folder and let ``start(stream)`` drain it before the next comes: every part is a run of its own that goes on from the checkpoint of the one before."""
    for n, part in enumerate(parts):
        part.write.parquet(f"{folder}/part={n}")
        start(spark.readStream.schema(part.schema).parquet(f"{folder}/part=*")).awaitTermination()


def appended(df: DataFrame, path: str, checkpoint: str):
    """Start a query that appends what a stream gives out to a table, and ends when all is drained."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_sink(df: DataFrame, sink, checkpoint: str, every: str | None = None, attempts: int = 3, wait_s: float = 0.5, mode: str = "append"):
    """Start a query that hands each micro-batch (DataFrame, number) to ``sink``, a callable, and tries again where it raises, after ``wait_s`` seconds and twice as long each time.

    ``every`` is the tick ("30 seconds"); without one the query drains what is there and
    ends.  A restart with the same checkpoint goes on after the last batch that the sink
    took; a sink that is called twice for one number has to overwrite.
    """

    def batch(rows: DataFrame, number: int) -> None:
        for attempt in range(attempts):
            try:
                return sink(rows, number)
            except Exception:
                if attempt + 1 == attempts:
                    raise
                time.sleep(wait_s * 2**attempt)

    writer = df.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_wire(spark: SparkSession, folder: str, lines_per_trigger: int = 100) -> DataFrame:
    """A folder of newline-delimited API messages as a stream of posts; blank and malformed lines are skipped."""
    return parse_stream(spark.readStream.option("maxFilesPerTrigger", lines_per_trigger).text(folder))


def restarted(start, attempts: int = 3, wait_s: float = 0.5) -> None:
    """Run a query that ends by itself (``start()`` gives it) and, where it fails, start it again from its checkpoint, after ``wait_s`` seconds and twice as long each time."""
    for attempt in range(attempts):
        try:
            return start().awaitTermination()
        except StreamingQueryException:
            if attempt + 1 == attempts:
                raise
            time.sleep(wait_s * 2**attempt)


def drained(start) -> None:
    """Run a query (``start()`` gives it) until it has taken all that its source has now, then stop it."""
    running = start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
