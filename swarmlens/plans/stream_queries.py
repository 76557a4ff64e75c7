"""Queries that drain a stream, fold a baseline or run plugins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from swarmlens.operators import graphs, temporal
from swarmlens.plans.plugins import Registry
from swarmlens.plans.register import query, table
from swarmlens.sources.adapters import POSTS_SQL, events, posts
from swarmlens.streaming import jobs


def _latest(spark, counts, name: str, keys: list[str]):
    """The last count of each key that a stream in update mode gave out, batch by batch."""
    graphs.ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}_{uuid.uuid4().hex}"
    jobs.to_sink(counts, lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}"), f"{folder}/checkpoint", mode="update").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


@query("T10_microbatch", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def microbatch(spark, sf_dir):
    """Events as a file stream, drained in update mode into a table of the latest counts."""
    # a file source wants a folder: the glob makes one of a single file
    stream = jobs.stream_events(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema)
    return _latest(spark, stream.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")), "drained", ["event_type", "day"])


@query("T6_ewma_baseline", """WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS rate FROM events WHERE ts IS NOT NULL)
SELECT user_id, round(coalesce(sum(rate * pow(0.9::DOUBLE, n - k) * CASE WHEN k = 10 THEN 1 ELSE 0.1::DOUBLE END) FILTER (k >= 10), 0), 6) AS average, coalesce(max(rate) FILTER (k >= 10), 0)::DOUBLE AS highest, coalesce(min(rate) FILTER (k >= 10), 0)::DOUBLE AS lowest FROM r GROUP BY user_id""")
def baseline(spark, sf_dir):
    return temporal.rate_baseline(events(spark, sf_dir), "user_id", "ts", "event_id").withColumn("average", F.round("average", 6))


@query("T7_watermark_counts", "SELECT event_type, epoch_us(ts) // 360000000 * 360000000 - i * 360000000 AS start_us, count(*) AS n FROM events, range(10) AS s(i) GROUP BY ALL")
def watermark_counts(spark, sf_dir):
    """Sliding windows under a watermark of ten windows, drained from a stream in update mode: state behind the watermark is let go."""
    counts = jobs.windowed_counts(jobs.stream_events(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema))
    return _latest(spark, counts, "windows", ["start", "event_type"]).select("event_type", F.unix_micros("start").alias("start_us"), "n")


@query("K3_batch_sink", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def batch_sink(spark, sf_dir):
    """Micro-batches given to a sink; the stream is started twice with one checkpoint and delivers every row once."""
    graphs.ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/sink_{uuid.uuid4().hex}"
    stream = jobs.stream_events(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema).select("event_id", "event_type")
    for _ in range(2):
        jobs.to_sink(stream, lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}"), f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("X4_plugin_union", f"WITH {POSTS_SQL} SELECT 'tags' AS algorithm, id, len(hashtags)::DOUBLE AS score FROM p WHERE len(hashtags) > 0 UNION ALL SELECT 'names', id, len(mentions)::DOUBLE FROM p WHERE len(mentions) > 0")
def plugins(spark, sf_dir):
    registry = Registry()
    registry.register("tags", lambda p: p.where(F.size("hashtags") > 0).select("id", F.size("hashtags").alias("score")))
    registry.register("names", lambda p: p.where(F.size("mentions") > 0).select("id", F.size("mentions").alias("score")))
    return registry.detect(posts(spark, sf_dir))
