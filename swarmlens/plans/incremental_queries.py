"""Queries of what grows batch by batch: the index, clusters, late rows, repeats, joins of streams, and reputation as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from swarmlens.operators import graphs
from swarmlens.operators.clustering import Clusters
from swarmlens.operators.index import SignatureIndex
from swarmlens.plans.analytics_queries import fold_sql
from swarmlens.plans.register import query, table
from swarmlens.plans.similarity_queries import B, H, MINHASH, MINHASH_OF_TEXTS, T, texts
from swarmlens.sources import paged
from swarmlens.sources.adapters import events
from swarmlens.streaming import jobs, reputation


def _folder(spark, name: str) -> str:
    graphs.ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _top(edges: str) -> str:
    return f"""bo AS (SELECT a AS id, b AS other, similarity FROM {edges} UNION ALL SELECT b, a, similarity FROM {edges})
SELECT id, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other)::INT AS rank, other, similarity FROM bo WHERE id % 10 = 0 QUALIFY rank <= 10"""


@query("L20_find_similar", f"WITH {MINHASH}, {_top('me')}")
def find_similar(spark, sf_dir):
    """The ten most similar texts of every tenth id, out of an index on disk."""
    index = SignatureIndex(spark, _folder(spark, "index"), H, B)
    index.add(texts(spark, sf_dir), 0)
    return index.find_similar(table(spark, sf_dir, "documents").where("doc_id % 10 = 0").select(F.col("doc_id").alias("id")), 10, T)


_UPKEPT = "t0 AS (SELECT min(doc_id) AS id, text FROM documents WHERE text IS NOT NULL GROUP BY text),\nt AS (SELECT id, CASE WHEN id % 10 = 3 THEN concat('seen again ', text) ELSE text END AS text FROM t0 WHERE id % 10 <> 7 OR id % 20 = 7)"


@query("L18_index_upkeep", f"WITH {_UPKEPT},\n{MINHASH_OF_TEXTS}, n AS (SELECT count(*) AS n FROM sig), q AS ({_top('me').replace('bo AS', 'WITH bo AS', 1)}) SELECT q.*, n AS living FROM q, n")
def index_upkeep(spark, sf_dir):
    """An index whose texts are replaced (ids that end in 3), deleted (in 7) and partly added again (every second of them), then searched."""
    index = SignatureIndex(spark, _folder(spark, "index"), H, B)
    docs = texts(spark, sf_dir)
    index.add(docs, 0)
    index.add(docs.where("id % 10 = 3").withColumn("text", F.concat(F.lit("seen again "), "text")), 1)
    index.delete(docs.where("id % 10 = 7").select("id"), 2)
    index.add(docs.where("id % 20 = 7"), 3)
    found = index.find_similar(table(spark, sf_dir, "documents").where("doc_id % 10 = 0").select(F.col("doc_id").alias("id")), 10, T)
    return found.withColumn("living", F.lit(index.count()).cast("bigint"))


@query("T11_incremental_clusters", f"""WITH RECURSIVE {MINHASH}, e AS (SELECT a, b FROM me UNION ALL SELECT b, a FROM me), c(id, r) AS (SELECT a, a FROM e UNION SELECT c.id, e.b FROM c JOIN e ON c.r = e.a),
co AS (SELECT id, min(r) AS component FROM c GROUP BY id), d AS (SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS rep FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, coalesce(component, rep) AS component FROM d LEFT JOIN co ON co.id = rep""")
def incremental_clusters(spark, sf_dir):
    """Near-duplicate components of all documents, which come in three batches of a stream: each meets the buckets it falls into, and clusters are joined as they grow."""
    folder = _folder(spark, "clusters")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    clusters = Clusters(spark, f"{folder}/store", H, B, T)
    parts = [docs.where(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(3)) == n) for n in range(3)]
    jobs.replayed(spark, parts, f"{folder}/in", lambda stream: jobs.incremental_clusters(stream.drop("part"), clusters, f"{folder}/progress"))
    return clusters.clusters().select(F.col("id").alias("doc_id"), "component")


#: Rows come in two parts, by whether their number is odd; the watermark is behind the newest row of the first one by two days.
_LATE_MS = 2 * 86_400_000
_MARK = f"wm AS (SELECT (max(epoch_us(ts)) // 1000 - {_LATE_MS}) * 1000 AS wm FROM events WHERE event_id % 2 = 0)"


def _parts(spark, sf_dir):
    """Even rows, then the odd ones: most of these are late by then."""
    rows = events(spark, sf_dir).select("event_id", "event_type", "user_id", "ts")
    return [rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")]


@query("T16_late_rows", f"""WITH {_MARK}, la AS (SELECT (max(epoch_us(ts)) // 1000 - {_LATE_MS}) * 1000 AS last FROM events),
w AS (SELECT event_type, epoch_us(ts) // 21600000000 * 21600000000 AS start_us FROM events, wm WHERE event_id % 2 = 0 OR epoch_us(ts) // 21600000000 * 21600000000 + 21600000000 > wm)
SELECT event_type, start_us, count(*) AS n FROM w, la WHERE start_us + 21600000000 <= last GROUP BY ALL""")
def late_rows(spark, sf_dir):
    """Six-hour counts in append mode: rows of the second part whose window the watermark has passed are dropped, and windows it has not passed are not given out yet."""
    folder = _folder(spark, "late")
    jobs.replayed(spark, _parts(spark, sf_dir), f"{folder}/in", lambda stream: jobs.appended(jobs.late_counts(stream), f"{folder}/out", f"{folder}/progress"))
    return spark.read.parquet(f"{folder}/out").select("event_type", F.unix_micros("start").alias("start_us"), "n")


@query("T16_deduplicated", f"WITH {_MARK} SELECT event_id, event_type FROM events, wm WHERE event_id % 2 = 0 OR epoch_us(ts) > wm")
def deduplicated(spark, sf_dir):
    """Even rows, then all rows: repeats inside the watermark are dropped as such, and what is later than it as late."""
    folder, (even, odd) = _folder(spark, "repeats"), _parts(spark, sf_dir)
    jobs.replayed(spark, [even, even.union(odd)], f"{folder}/in", lambda stream: jobs.appended(jobs.without_repeats(stream, "event_id"), f"{folder}/out", f"{folder}/progress"))
    return spark.read.parquet(f"{folder}/out").select("event_id", "event_type")


@query("T16_stream_join", f"""WITH m AS (SELECT event_type, (max(epoch_us(ts)) // 1000 - {_LATE_MS}) * 1000 AS m FROM events WHERE event_id % 2 = 0 AND event_type IN ('view', 'click') GROUP BY event_type), wm AS (SELECT min(m) AS wm FROM m),
k AS (SELECT * FROM events, wm WHERE event_id % 2 = 0 OR epoch_us(ts) > wm)
SELECT x.user_id, x.event_id AS left_id, y.event_id AS right_id FROM k x JOIN k y ON x.user_id = y.user_id AND y.ts BETWEEN x.ts AND x.ts + INTERVAL 12 HOUR WHERE x.event_type = 'view' AND y.event_type = 'click'""")
def stream_join(spark, sf_dir):
    """Clicks at most half a day after a view of the same user, as a join of two streams; late rows of the second part are dropped."""
    folder = _folder(spark, "followed")

    def start(stream):
        side = lambda kind: stream.where(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias("id"))
        return jobs.appended(jobs.followed(side("view"), side("click"), "user_id", "12 hours"), f"{folder}/out", f"{folder}/progress")

    jobs.replayed(spark, _parts(spark, sf_dir), f"{folder}/in", start)
    return spark.read.parquet(f"{folder}/out")


@query("R8_reputation_stream", f"WITH RECURSIVE ev AS (SELECT user_id AS id, ts, event_type AS factor, CASE WHEN event_type = 'error' THEN -0.05::DOUBLE ELSE 0.01::DOUBLE END AS impact, 0.8::DOUBLE AS confidence FROM events), {fold_sql('ev')} SELECT id, round(score, 6) AS score, round(w, 6) AS effective_weight, n FROM fd WHERE k = n")
def reputation_stream(spark, sf_dir):
    """R4's events in three runs of a stream, by time; each goes on from the state that the one before left."""
    folder = _folder(spark, "reputation")
    e = events(spark, sf_dir).select(F.col("user_id").alias("id"), "ts", F.col("event_type").alias("factor"), F.when(F.col("event_type") == "error", -0.05).otherwise(0.01).alias("impact"), F.lit(0.8).alias("confidence"))
    low, high = e.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    third = F.least(F.lit(2), F.floor((F.unix_micros("ts") - F.lit(low or 0)) * 3 / F.lit(max(1, (high or 0) - (low or 0)))))
    scores = reputation.ScoreTable(spark, f"{folder}/scores")
    jobs.replayed(spark, [e.where(third == n) for n in range(3)], f"{folder}/in", lambda stream: jobs.to_sink(reputation.scores(stream.drop("part")), scores.take, f"{folder}/progress", mode="update"))
    return scores.latest().withColumns({c: F.round(c, 6) for c in ("score", "effective_weight")})


#: Posts of a page.
_PAGE = 100


def _answers(spark, sf_dir):
    """Documents as search answers, a hundred numbers a page."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    return d.select(F.expr(f"doc_id div {_PAGE}").alias("page"), F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("author_id"), "lang", F.lit(None).cast("string").alias("created_at"))


@query("S1_paged_search", "SELECT doc_id::VARCHAR AS id, md5(text) AS text_md5, lang, source AS author_id FROM documents WHERE lang IN ('en', 'de') AND doc_id IS NOT NULL")
def paged_search(spark, sf_dir):
    """All pages of an answer as a scan with a task for each page; languages are pushed into the tasks."""
    folder, answers = _folder(spark, "pages"), _answers(spark, sf_dir)
    paged.write_pages(answers, folder, 0, answers.agg(F.max("page")).first()[0] or 0)
    paged.register(spark)
    found = spark.read.format("paged_search").load(folder).where(F.col("lang").isin("en", "de"))
    return found.select("id", F.md5("text").alias("text_md5"), "lang", "author_id")


@query("S2_stream_offsets", "SELECT doc_id::VARCHAR AS id, md5(text) AS text_md5, count(*) OVER (PARTITION BY doc_id) AS n FROM documents WHERE doc_id IS NOT NULL")
def stream_offsets(spark, sf_dir):
    """Pages as a stream that is stopped half-way and started again, when more pages are there: every post comes once."""
    folder, answers = _folder(spark, "feed"), _answers(spark, sf_dir)
    last = answers.agg(F.max("page")).first()[0] or 0
    paged.register(spark)
    for first, end in ((0, last // 2), (last // 2 + 1, last)):
        if first <= end:
            paged.write_pages(answers, f"{folder}/pages", first, end)
        stream = spark.readStream.format("paged_search").load(f"{folder}/pages")
        jobs.drained(lambda: stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).option("checkpointLocation", f"{folder}/progress").start())
    posts = spark.read.parquet(f"{folder}/out")
    return posts.withColumn("n", F.count("*").over(Window.partitionBy("id"))).select("id", F.md5("text").alias("text_md5"), "n")
