"""Queries of reads and filters, list views, recorded accuracies, counters, conversions and SQL functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from swarmlens.functions import scores
from swarmlens.functions.text import fnv32, stable_id
from swarmlens.operators import similarity as S
from swarmlens.operators.graphs import written
from swarmlens.operators.ordering import running
from swarmlens.plans.analytics_queries import _MARKED, marked, rates
from swarmlens.plans.detection_queries import _LEVEL, _STATS, clusters
from swarmlens.plans.plugins import Registry
from swarmlens.plans.register import query, table
from swarmlens.plans.similarity_queries import CONFIG, H, MINHASH, SIMHASH, B, T, texts
from swarmlens.plans.sql_functions import register
from swarmlens.sources.adapters import POSTS_SQL, account_rows, accounts, events, parse_stream, posts, upserted


@query("P11_clusters_by_severity", f"WITH {_STATS} SELECT cluster_id, size FROM s WHERE {_LEVEL} = 'low'")
def by_severity(spark, sf_dir):
    return clusters(spark, sf_dir).where("suspicion_level = 'low'").select("cluster_id", "size")


@query("P11_spam_only", f"WITH {_MARKED} SELECT id, round(spam_score, 9) AS spam_score FROM mk WHERE spam_score IS NOT NULL")
def spam_only(spark, sf_dir):
    return marked(spark, sf_dir).where("spam_score IS NOT NULL").select("id", F.round("spam_score", 9).alias("spam_score"))


@query("P16_text_filter", "SELECT doc_id FROM documents WHERE contains(lower(text), lower('LICENSE'))")
def text_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.lower("text").contains(F.lower(F.lit("LICENSE")))).select("doc_id")


@query("P19_post_list", f"WITH {_MARKED} SELECT id, '[' || CASE WHEN spam_score IS NULL THEN 'Clean' ELSE 'SPAM' END || '] ' || text AS line FROM mk")
def post_list(spark, sf_dir):
    mark = F.when(F.col("spam_score").isNull(), "[Clean] ").otherwise("[SPAM] ")
    return marked(spark, sf_dir).select("id", F.concat(mark, "text").alias("line"))


@query("P19_cluster_list", f"WITH {_STATS} SELECT cluster_id, 'Cluster ' || substr(md5(cluster_id::VARCHAR), 1, 8) || ': ' || size || ' posts, confidence ' || printf('%.2f', round(confidence, 2)) AS line FROM s")
def cluster_list(spark, sf_dir):
    line = F.format_string("Cluster %s: %d posts, confidence %.2f", F.substring(F.md5(F.col("cluster_id").cast("string")), 1, 8), "size", F.round("confidence", 2))
    return clusters(spark, sf_dir).select("cluster_id", line.alias("line"))


@query("P20_cluster_cards", f"""WITH {_STATS} SELECT cluster_id, size, printf('%.2f', round(confidence, 2)) AS confidence, {_LEVEL} AS suspicion_level, swarm OR few AS is_coordinated, strftime(first_seen, '%Y-%m-%dT%H:%M:%SZ') AS first_seen, strftime(last_seen, '%Y-%m-%dT%H:%M:%SZ') AS last_seen,
printf('%.2f', round(tpm, 2)) AS tweets_per_minute, unique_accounts, 'minhash' AS detection_method FROM s""")
def cluster_cards(spark, sf_dir):
    """What a cluster's card shows, for each cluster."""
    when = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    two = lambda c: F.format_string("%.2f", F.round(c, 2)).alias(c)
    return clusters(spark, sf_dir).select("cluster_id", "size", two("confidence"), "suspicion_level", "is_coordinated", when("first_seen"), when("last_seen"), two("tweets_per_minute"), "unique_accounts", F.lit("minhash").alias("detection_method"))


@query("L16_exact_similarity", f"""WITH t AS (SELECT min(doc_id) AS id, text FROM documents WHERE text IS NOT NULL GROUP BY text),
{SIMHASH}, q(a, b) AS (VALUES (0, 1), (2, 3), (0, -1)) SELECT a::BIGINT AS a, b::BIGINT AS b, coalesce(1 - bit_count(xor(x.v, y.v)) / 64.0::DOUBLE, 0) AS similarity FROM q LEFT JOIN sim x ON x.id = a LEFT JOIN sim y ON y.id = b""")
def exact_similarity(spark, sf_dir):
    """The similarity of two ids, 0 if one of them is missing."""
    hashes = S.kept(S.simhash(texts(spark, sf_dir)))
    pairs = [S.exact_similarity(hashes, a, b).select(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"), "similarity") for a, b in ((0, 1), (2, 3), (0, -1))]
    return pairs[0].union(pairs[1]).union(pairs[2])


_JUDGED = f"""{MINHASH},
{SIMHASH}, fo AS (SELECT 'minhash' AS algorithm, a AS id FROM me UNION SELECT 'minhash', b FROM me UNION SELECT 'simhash', a FROM se UNION SELECT 'simhash', b FROM se),
dr AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents WHERE text IS NOT NULL),
ju AS (SELECT al.algorithm, (toxic = 1 OR quality = 0) AS truth, fo.id IS NOT NULL AS found FROM labels JOIN dr USING (doc_id) CROSS JOIN (VALUES ('minhash'), ('simhash')) AS al(algorithm) LEFT JOIN fo ON fo.algorithm = al.algorithm AND fo.id = rep),
ac AS (SELECT algorithm, count(*) FILTER (truth AND found) AS tp, count(*) FILTER (NOT truth AND found) AS fp, count(*) FILTER (NOT truth AND NOT found) AS tn, count(*) FILTER (truth AND NOT found) AS fn, avg((truth = found)::INT) AS accuracy FROM ju GROUP BY algorithm)"""


def recorded(spark, sf_dir, minhash, simhash):
    """Each algorithm's accuracy on the labels: found are the texts in one of its pairs."""
    docs = table(spark, sf_dir, "documents")
    ends = [p.select(F.lit(n).alias("algorithm"), F.explode(F.array("a", "b")).alias("rep")).distinct() for n, p in (("minhash", minhash), ("simhash", simhash))]
    truth = table(spark, sf_dir, "labels").join(S.membership(docs), "doc_id").select("rep", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("truth"))
    each = truth.withColumn("algorithm", F.explode(F.array(F.lit("minhash"), F.lit("simhash"))))
    judged = each.join(ends[0].union(ends[1]).withColumn("found", F.lit(True)), ["algorithm", "rep"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return S.accuracies(judged)


@query("L28_accuracies", f"WITH {_JUDGED} SELECT algorithm, tp, fp, tn, fn, round(accuracy, 9) AS accuracy FROM ac")
def accuracies(spark, sf_dir):
    docs = texts(spark, sf_dir)
    return recorded(spark, sf_dir, *S.both_pairs(docs, H, B, T)).withColumn("accuracy", F.round("accuracy", 9))


@query("L24_recorded_weights", f"""WITH {_JUDGED}, r AS (SELECT max(accuracy) FILTER (algorithm = 'minhash') AS m, max(accuracy) FILTER (algorithm = 'simhash') AS s FROM ac), wg AS (SELECT m / (m + s) * 0.6::DOUBLE AS m, s / (m + s) * 0.4::DOUBLE AS s FROM r),
j AS (SELECT coalesce(me.a, se.a) AS a, coalesce(me.b, se.b) AS b, coalesce(me.similarity, 0) AS m, coalesce(se.similarity, 0) AS s FROM me FULL JOIN se ON me.a = se.a AND me.b = se.b)
SELECT a, b, round(j.m * wg.m / (wg.m + wg.s) + j.s * wg.s / (wg.m + wg.s), 6) AS similarity FROM j, wg WHERE j.m * wg.m / (wg.m + wg.s) + j.s * wg.s / (wg.m + wg.s) >= 0.3""")
def recorded_weights(spark, sf_dir):
    """Adaptive weights by the accuracies that the labels give."""
    docs = texts(spark, sf_dir)
    both = written(S.joint_pairs(docs, H, B, T))
    m, s = (both.where(f"{x} IS NOT NULL").select("a", "b") for x in ("m", "s"))
    found = {r["algorithm"]: r["accuracy"] for r in recorded(spark, sf_dir, m, s).collect()}  # two rows
    weights = S.adaptive_weights(found.get("minhash", 0.0), found.get("simhash", 0.0))
    return S.combined(both, "weighted", 0.3, weights).withColumn("similarity", F.round("similarity", 6))


@query("L26_length_weights", f"""WITH {MINHASH},
{SIMHASH}, j AS (SELECT coalesce(me.a, se.a) AS a, coalesce(me.b, se.b) AS b, coalesce(me.similarity, 0) AS m, coalesce(se.similarity, 0) AS s FROM me FULL JOIN se ON me.a = se.a AND me.b = se.b),
wg AS (SELECT id, 0.6::DOUBLE * CASE WHEN length(text) > 200 THEN 1.2 WHEN length(text) < 50 THEN 0.8 ELSE 1 END::DOUBLE AS wm, 0.4::DOUBLE * CASE WHEN length(text) > 200 THEN 0.8 WHEN length(text) < 50 THEN 1.2 ELSE 1 END::DOUBLE AS ws FROM t)
SELECT a, b, round(m * wm / (wm + ws) + s * ws / (wm + ws), 9) AS similarity FROM j JOIN wg ON wg.id = a WHERE m * wm / (wm + ws) + s * ws / (wm + ws) >= 0.3""")
def length_weights(spark, sf_dir):
    """Weights by the length of the first text of a pair."""
    docs = texts(spark, sf_dir)
    sized = S.joint_pairs(docs.withColumn("n", F.length("text")), H, B, T, size="n")
    wm, ws = S.length_weights(F.col("size"))
    value = F.coalesce("m", F.lit(0.0)) * wm + F.coalesce("s", F.lit(0.0)) * ws
    return sized.select("a", "b", value.alias("similarity")).where("similarity >= 0.3").withColumn("similarity", F.round("similarity", 9))


@query("O2_best_first", f"WITH {MINHASH} SELECT a, b, similarity, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b)::INT AS nth FROM me")
def best_first(spark, sf_dir):
    """Each text's later near duplicates, the most similar first."""
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return S.minhash_pairs(texts(spark, sf_dir), H, B, T).withColumn("nth", F.row_number().over(order))


@query("O5_scan_limit", "SELECT least(100, count(*)) AS n FROM documents")
def scan_limit(spark, sf_dir):
    """A scan that stops at a number of rows."""
    return table(spark, sf_dir, "documents").limit(100).agg(F.count("*").alias("n"))


@query("U6_sources_together", "SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN 'search' ELSE 'stream' END AS origin FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def sources_together(spark, sf_dir):
    """Posts of a search and of a stream's messages as one table."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    post = F.struct(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("author_id"))
    message = F.to_json(F.struct(F.array(post).alias("data"), F.struct(F.array(F.struct(F.col("source").alias("id"), F.col("source").alias("username"))).alias("users")).alias("includes")))
    stream = parse_stream(docs.where("doc_id % 2 = 1").select(message.alias("value"))).select("id", F.lit("stream").alias("origin"))
    return docs.where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("id"), F.lit("search").alias("origin")).unionByName(stream)


@query("S7_last_write_wins", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def last_write(spark, sf_dir):
    return upserted(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@query("F5_fnv", "SELECT c_custkey, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, strlen(c_name) + 1), lambda i: ascii(substr(c_name, i, 1))::HUGEINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)::BIGINT AS hash FROM customer")
def fnv(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", fnv32(F.col("c_name")).alias("hash"))


_USERS = "u AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' - to_hours((c_custkey * 37 % 30000)::INT) END AS made, (c_custkey * 13 % 500)::INT AS following, floor(greatest(c_acctbal, 0))::INT AS followers, (c_custkey % 4000)::INT AS posted FROM customer)"


@query("F18_account_rows", f"WITH {_USERS}, a AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-01') - epoch_us(made)) // 86400000000 AS days FROM u) SELECT id::VARCHAR AS id, coalesce(days, 0)::INT AS account_age_days, round(CASE WHEN days > 0 THEN posted / days::DOUBLE ELSE 0 END, 9) AS tweets_per_day, round(CASE WHEN following > 0 THEN followers / following::DOUBLE ELSE 0 END, 9) AS follower_ratio FROM a")
def wire_accounts(spark, sf_dir):
    """Wire users with RFC 3339 times, a tenth of them unreadable."""
    key = F.col("c_custkey")
    made = F.lit("2024-01-01 00:00:00").cast("timestamp") - F.make_dt_interval(hours=(key * 37 % 30000).cast("int"))
    numbers = F.struct(F.floor(F.greatest("c_acctbal", F.lit(0.0))).cast("int").alias("followers_count"), (key * 13 % 500).cast("int").alias("following_count"), (key % 4000).cast("int").alias("tweet_count"))
    users = table(spark, sf_dir, "customer").select(key.cast("string").alias("id"), F.col("c_name").alias("username"), F.when(key % 10 == 0, "yesterday").otherwise(F.date_format(made, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("created_at"), numbers.alias("public_metrics"))
    return account_rows(users, "2024-01-01 00:00:00").select("id", "account_age_days", F.round("tweets_per_day", 9).alias("tweets_per_day"), F.round("follower_ratio", 9).alias("follower_ratio"))


@query("F20_numbers", "SELECT doc_id, try_cast(split_part(text, ' ', 1) AS DOUBLE) AS value FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id / 4.0::DOUBLE)::VARCHAR || ' x' WHEN doc_id % 3 = 1 THEN doc_id::VARCHAR ELSE 'none ' || doc_id END AS text FROM documents)")
def numbers(spark, sf_dir):
    """Whatever can be read as a number, else null."""
    d = F.col("doc_id")
    raw = F.when(d % 3 == 0, (d / 4.0).cast("string")).when(d % 3 == 1, d.cast("string")).otherwise("none")
    return table(spark, sf_dir, "documents").select("doc_id", scores.number(raw).alias("value"))


@query("F24_stable_ids", "SELECT event_id, 'event_' || substr(sha256(event_type || '|' || event_id), 1, 16) AS id FROM events")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", stable_id("event", F.col("event_type"), F.col("event_id")).alias("id"))


@query("F27_highest_rate", "WITH k AS (SELECT event_type, max(n) AS n FROM (SELECT event_type, i, count(*) AS n FROM (SELECT event_type, unnest(range(greatest(0, (epoch_us(ts) - first - 3600000000) // 360000000 + CASE WHEN epoch_us(ts) - first >= 3600000000 THEN 1 ELSE 0 END), least((epoch_us(ts) - first + 359999999) // 360000000 - 1, (last - first - 1) // 360000000) + 1)) AS i FROM events JOIN (SELECT event_type, min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last FROM events GROUP BY 1) USING (event_type)) GROUP BY ALL) GROUP BY event_type) SELECT event_type, round(n / 60.0::DOUBLE, 9) AS rate FROM k")
def highest_rate(spark, sf_dir):
    return rates(spark, sf_dir).groupBy("event_type").agg(F.round(F.coalesce(F.max("rate"), F.lit(0.0)), 9).alias("rate"))


@query("F28_shown_names", """SELECT event_id, value, CASE WHEN value = 'slack' THEN 'Slack' ELSE 'Unknown' END AS channel, CASE WHEN value = 'flash_mob' THEN 'Flash Mob' ELSE 'Unknown' END AS pattern, CASE WHEN value = 'low' THEN 'LOW' ELSE 'Unknown' END AS severity
FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'slack' WHEN 'view' THEN 'flash_mob' WHEN 'error' THEN 'low' WHEN 'signup' THEN NULL ELSE event_type END AS value FROM events)""")
def shown_names(spark, sf_dir):
    """The shown names of every event's type, three of which stand for a channel, a pattern and a severity."""
    kind = F.col("event_type")
    value = F.when(kind == "click", "slack").when(kind == "view", "flash_mob").when(kind == "error", "low").when(kind == "signup", F.lit(None)).otherwise(kind)
    return table(spark, sf_dir, "events").select("event_id", value.alias("value")).select("event_id", "value", *[scores.shown(k, F.col("value")).alias(k) for k in scores.NAMES])


@query("A9_running_totals", "SELECT event_id, count(*) OVER w AS total, count(*) FILTER (event_type = 'error') OVER w AS errors FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_totals(spark, sf_dir):
    """Counters of each user as of each event: all events, and errors."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    e = running(e, "user_id", "ts", ["event_id"], F.lit(1).cast("bigint"), "total")
    return running(e, "user_id", "ts", ["event_id"], F.coalesce((F.col("event_type") == "error").cast("bigint"), F.lit(0)), "errors").select("event_id", "total", "errors")


@query("A21_key_stats", "SELECT count(*) AS n, count(*) FILTER (o_orderdate + INTERVAL 365 DAY >= TIMESTAMP '1997-01-01') AS active, count(*) FILTER (o_orderdate + INTERVAL 365 DAY < TIMESTAMP '1997-01-01') AS expired FROM orders")
def key_stats(spark, sf_dir):
    """Keys (orders) that are valid for a year: how many are active at a time."""
    ends = F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")
    now = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.count_if(ends >= now).alias("active"), F.count_if(ends < now).alias("expired"))


@query("A23_crawler_counters", "SELECT count(*) AS total, count(*) FILTER (ts >= date_trunc('hour', m)) AS this_hour, round(count(*) / ((epoch_us(m) - min(epoch_us(ts))) / 1e6::DOUBLE), 9) AS per_second FROM events, (SELECT max(ts) AS m FROM events) GROUP BY m")
def crawler_counters(spark, sf_dir):
    """Totals, this hour's posts and the rate since the start, as of the last event."""
    us = F.unix_micros(F.col("ts"))
    by_hour = events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.min(us).alias("first"), F.max(us).alias("last"))
    out = by_hour.agg(F.sum("n").alias("total"), F.max_by("n", "hour").alias("this_hour"), F.min("first").alias("first"), F.max("last").alias("last"))
    return out.select("total", "this_hour", F.round(F.try_divide(F.col("total"), (F.col("last") - F.col("first")) / 1e6), 9).alias("per_second"))


@query("A26_engine_health", "SELECT count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 3.6e9::DOUBLE, 6) AS uptime_h, count(*) FILTER (event_type = 'error') > 100 AS too_many_errors FROM events")
def engine_health(spark, sf_dir):
    us, errors = F.unix_micros("ts"), F.count_if(F.col("event_type") == "error")
    return events(spark, sf_dir).agg(F.count("*").alias("events"), errors.alias("errors"), F.round((F.max(us) - F.min(us)) / 3.6e9, 6).alias("uptime_h"), (errors > 100).alias("too_many_errors"))


@query("X4_cluster_plugins", f"WITH {_STATS} SELECT 'size' AS algorithm, cluster_id, size::DOUBLE AS score FROM s UNION ALL SELECT 'crowd', cluster_id, unique_accounts::DOUBLE FROM s")
def cluster_plugins(spark, sf_dir):
    """Plugins that judge clusters; one that fails is counted and left out."""
    registry = Registry()
    none = lambda p: p.select("id", F.lit(0).alias("score"))
    registry.register("size", none, lambda c: c.select("cluster_id", F.col("size").alias("score")))
    registry.register("crowd", none, lambda c: c.select("cluster_id", F.col("unique_accounts").alias("score")))
    registry.register("broken", none, lambda c: c.select("cluster_id", F.col("no_such_column").alias("score")))
    return registry.analyse(clusters(spark, sf_dir))


@query("X10_sql_functions", f"""WITH t AS (SELECT min(doc_id) AS id, text FROM documents WHERE text IS NOT NULL GROUP BY text),
{SIMHASH} SELECT x.id, bit_count(xor(x.v, y.v))::INT AS distance FROM sim x, sim y WHERE y.id = (SELECT min(id) FROM sim)""")
def sql_functions(spark, sf_dir):
    """The engine's functions in plain SQL: the distance of every text's SimHash from the first text's."""
    register(spark)
    hashes = S.simhash(texts(spark, sf_dir))
    first = hashes.agg(F.min_by("simhash", "id").alias("h0"))  # one row
    view = f"hashes_{uuid.uuid4().hex}"
    hashes.join(F.broadcast(first), F.lit(True)).createOrReplaceTempView(view)
    return spark.sql(f"SELECT id, simhash_distance(simhash, h0) AS distance FROM {view}")


@query("X10_sql_scores", f"WITH {POSTS_SQL} SELECT id, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+'), lambda w: true)) AS n_words, round(exp(-0.1::DOUBLE * (id % 30)) * 0.9 + 0.5::DOUBLE * (1 - exp(-0.1::DOUBLE * (id % 30))), 9) AS decayed, CASE WHEN strlen(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END AS short FROM p WHERE text IS NOT NULL")
def sql_scores(spark, sf_dir):
    register(spark)
    view = f"posts_{uuid.uuid4().hex}"
    posts(spark, sf_dir).where("text IS NOT NULL").createOrReplaceTempView(view)
    return spark.sql("SELECT id, cast(word_count(text) AS bigint) AS n_words, round(decayed_score(0.9D, cast(id % 30 AS double)), 9) AS decayed, shortened(text) AS short FROM " + view)
