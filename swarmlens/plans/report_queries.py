"""Queries of sources, exports, reads, hybrid unions, alert records and the remaining scalar functions."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swarmlens.functions import scores
from swarmlens.operators import alerts as A
from swarmlens.operators import detection as D
from swarmlens.operators import graphs
from swarmlens.operators import privacy as N
from swarmlens.operators import temporal as T
from swarmlens.plans.analytics_queries import _MARKED, _REGION, marked, noise_sql, scrub_sql, shape_sql
from swarmlens.plans.detection_queries import _LEVEL, _STATS, CONFIG, _nested, clusters, members
from swarmlens.plans.register import query, table
from swarmlens.plans.similarity_queries import MINHASH_OF_TEXTS, SIMHASH
from swarmlens.operators.engine import near_clusters
from swarmlens.sources import sample, sinks
from swarmlens.sources.adapters import ACCOUNTS_SQL, POSTS_SQL, accounts, events, parse_stream, posts


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query("S6_sample_posts", f"WITH s AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in sample.sample_rows())}) AS s(campaign, username, text)), d AS (SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text) SELECT s.*, coalesce(n, 0) AS n_documents FROM s LEFT JOIN d USING (text)")
def sample_posts(spark, sf_dir):
    """The sample posts, each with the number of documents of the very same text."""
    rows = spark.createDataFrame(sample.sample_rows(), "campaign string, username string, text string")
    same = table(spark, sf_dir, "documents").join(F.broadcast(rows.select("text").distinct()), "text").groupBy("text").agg(F.count("*").alias("n"))  # thirty rows
    return rows.join(same, "text", "left").select("campaign", "username", "text", F.coalesce("n", F.lit(0)).alias("n_documents"))


@query("S8_wire_posts", """SELECT doc_id::VARCHAR AS id, 'u' || source AS username, md5(text) AS text_md5, (doc_id % 7)::INT AS retweet_count FROM documents WHERE text IS NOT NULL""")
def wire_posts(spark, sf_dir):
    """Documents written as messages of the wire format, with heartbeats between, and read back."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    post = F.struct(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("author_id"), F.struct((F.col("doc_id") % 7).cast("int").alias("retweet_count")).alias("public_metrics"))
    user = F.struct(F.col("source").alias("id"), F.concat(F.lit("u"), "source").alias("username"))
    message = F.to_json(F.struct(F.array(post).alias("data"), F.struct(F.array(user).alias("users")).alias("includes")))
    lines = docs.select(F.explode(F.array(message, F.lit(" "), F.lit("{cut"))).alias("value"))
    return parse_stream(lines).select("id", "username", F.md5("text").alias("text_md5"), "retweet_count")


@query("K1_export", f"""WITH {_STATS}, o AS (SELECT 'clusters' AS section, count(*) AS n FROM s UNION ALL SELECT 'tweets', count(*) FROM p UNION ALL SELECT 'accounts', count(*) FROM acc WHERE bot_score > 0.5 UNION ALL SELECT 'metadata', 1 UNION ALL SELECT 'statistics', 1) SELECT * FROM o""")
def exported_sections(spark, sf_dir):
    """The whole export, written as JSON lines and read again: how many rows each section has."""
    graphs.ready(spark)
    scored = clusters(spark, sf_dir).checkpoint()
    statistics = scored.agg(F.count("*").alias("clusters"), F.sum("size").alias("posts"))
    metadata = spark.createDataFrame([(CONFIG.minhash_threshold, CONFIG.min_cluster_size)], "threshold double, min_cluster_size int")
    sections = {"metadata": metadata, "statistics": statistics, "clusters": scored, "tweets": posts(spark, sf_dir), "accounts": accounts(spark, sf_dir).where("is_suspicious")}
    folder = f"{spark.sparkContext.getCheckpointDir()}/export-{uuid.uuid4().hex}"
    sinks.export_results(folder, sections)
    counts = [spark.read.text(f"{folder}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n") for name in sections]
    return reduce(DataFrame.unionByName, counts)


@query("K2_read_clusters", f"WITH {_STATS} SELECT cluster_id, size FROM s ORDER BY size DESC, cluster_id LIMIT 50")
def read_clusters(spark, sf_dir):
    return clusters(spark, sf_dir).select("cluster_id", "size").orderBy(F.desc("size"), "cluster_id").limit(50)


@query("K5_metrics_json", """SELECT '{"name":"events","type":"counter","value":' || count(*) || ',"labels":{"type":"' || event_type || '"},"timestamp":"' || strftime(max(ts), '%Y-%m-%dT%H:%M:%S') || '"}' AS line FROM events GROUP BY event_type""")
def metrics_json(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("value"), F.max("ts").alias("last"))
    return sinks.metrics_json(counts.select(F.lit("events").alias("name"), F.lit("counter").alias("type"), "value", F.create_map(F.lit("type"), "event_type").alias("labels"), F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")))


@query("P8_confidence_filter", f"WITH {_STATS} SELECT cluster_id, confidence FROM s WHERE confidence >= 0.05")
def sure_clusters(spark, sf_dir):
    return clusters(spark, sf_dir).where(F.col("confidence") >= 0.05).select("cluster_id", "confidence")


@query("P10_posts_of_largest_cluster", f"WITH {_STATS} SELECT id FROM m WHERE cluster_id = (SELECT cluster_id FROM s ORDER BY size DESC, cluster_id LIMIT 1)")
def largest_cluster(spark, sf_dir):
    """O7 and P10: the largest cluster's posts."""
    found = members(spark, sf_dir).select("id", "cluster_id")
    largest = found.groupBy("cluster_id").count().orderBy(F.desc("count"), "cluster_id").limit(1)
    return found.join(F.broadcast(largest), "cluster_id", "left_semi").select("id")  # one row


@query("P15_reputation_verdicts", f"WITH {ACCOUNTS_SQL} SELECT id, 1 - bot_score < 0.3 AND least(1, tweet_count / 10.0::DOUBLE) > 0.6 AS is_spammy, 1 - bot_score > 0.7 AND least(1, tweet_count / 10.0::DOUBLE) > 0.6 AS is_trusted FROM acc")
def verdicts(spark, sf_dir):
    score, sure = 1 - F.col("bot_score"), F.least(F.lit(1.0), F.col("tweet_count") / 10.0) > 0.6
    return accounts(spark, sf_dir).select("id", ((score < 0.3) & sure).alias("is_spammy"), ((score > 0.7) & sure).alias("is_trusted"))


@query("J6_cluster_accounts", f"WITH {_STATS} SELECT DISTINCT cluster_id, author_id, username FROM m JOIN acc ON acc.id = author_id")
def cluster_accounts(spark, sf_dir):
    pairs = members(spark, sf_dir).select("cluster_id", "author_id").distinct()
    return pairs.join(accounts(spark, sf_dir).select(F.col("id").alias("author_id"), "username"), "author_id").select("cluster_id", "author_id", "username")


@query("U2_near_union", f"""WITH p AS (SELECT doc_id AS id, text FROM documents),
{_nested('mh', MINHASH_OF_TEXTS, 'me', 2)},
{_nested('sh', SIMHASH, 'se', 2)},
few AS (SELECT sh.cluster_id FROM sh LEFT JOIN mh ON mh.id = sh.id GROUP BY sh.cluster_id HAVING count(mh.id) / count(*)::DOUBLE < 0.5)
SELECT 'minhash' AS algorithm, cluster_id, id FROM mh UNION ALL SELECT 'simhash', cluster_id, id FROM sh SEMI JOIN few USING (cluster_id)""")
def near_union(spark, sf_dir):
    """J7 and U2: MinHash clusters, and the SimHash clusters that overlap them by less than half."""
    docs = table(spark, sf_dir, "documents")
    return D.hybrid_union(near_clusters(docs, "minhash"), near_clusters(docs, "simhash"))


@query("T17_retention", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 72 HOUR")
def retention(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    newest = e.agg(F.max("ts").alias("newest"))
    return e.join(F.broadcast(newest), F.col("ts") > F.col("newest") - F.expr("INTERVAL 72 HOURS")).select("event_id")  # one row


@query("T7_window_retention", "SELECT event_id FROM events JOIN (SELECT event_type, max(ts) AS newest FROM events GROUP BY 1) USING (event_type) WHERE ts > newest - INTERVAL 10 HOUR")
def window_retention(spark, sf_dir):
    """Of each key the events of its last ten windows of an hour."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return e.join(e.groupBy("event_type").agg(F.max("ts").alias("newest")), "event_type").where("ts > newest - INTERVAL 10 HOURS").select("event_id")


_DAYS = "d AS (SELECT event_type, ts::DATE AS day, count(*)::DOUBLE AS n FROM events GROUP BY ALL), x AS (SELECT event_type, day, n - avg(n) OVER (PARTITION BY event_type) AS v FROM d), y AS (SELECT event_type, v, lead(v) OVER (PARTITION BY event_type ORDER BY day) AS w FROM x)"


@query("W2_autocorrelation", f"WITH {_DAYS} SELECT event_type, round(CASE WHEN sum(v * v) = 0 THEN 0 ELSE sum(v * w) / sum(v * v) END, 6) AS correlation FROM y WHERE w IS NOT NULL GROUP BY event_type")
def autocorrelation(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    return T.autocorrelation(days, ["event_type"], "day", "n").withColumn("correlation", F.round("correlation", 6))


@query("A22_moving_average", """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(value * pow(0.5::DOUBLE, CASE WHEN k = n THEN n - 1 ELSE k END)), 6) AS average FROM r GROUP BY user_id""")
def moving_average(spark, sf_dir):
    """(old + new) / 2 in order of time, as a sum weighted by powers of a half."""
    w = Window.partitionBy("user_id")
    r = table(spark, sf_dir, "events").select("user_id", "value", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))).alias("k"), F.count("*").over(w).alias("n"))
    power = F.when(F.col("k") == F.col("n"), F.col("n") - 1).otherwise(F.col("k"))
    return r.groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.pow(F.lit(0.5), power)), 6).alias("average"))


_DIGEST = "substr(sha256('salt-1' || {}), 1, 16)"


def _tier(kind, value):
    limits, last = scores.TIERS[kind]
    return "CASE " + " ".join(f"WHEN {value} < {x} THEN '{n}'" for x, n in limits) + f" ELSE '{last}' END"


@query("N10_anonymous_posts", f"""WITH {_MARKED} SELECT {_DIGEST.format('id')} AS id, 'USER_' || upper(substr(sha256('salt-1' || author_id), 1, 8)) AS author, date_trunc('hour', created_at) AS hour, {shape_sql(scrub_sql('text'))} AS text, {_tier('engagement', '(retweet_count + like_count + reply_count)')} AS engagement,
CASE WHEN len(urls) > 0 THEN 'contains_links' WHEN len(mentions) > 3 THEN 'social' WHEN len(hashtags) > 2 THEN 'promotional' WHEN contains(lower(text), 'buy') OR contains(lower(text), 'sell') THEN 'commercial' WHEN contains(lower(text), 'follow') OR contains(lower(text), 'like') THEN 'engagement' ELSE 'general' END AS category,
{_tier('spam', 'coalesce(spam_score, 0)')} AS spam_confidence, {_DIGEST.format('cluster_id')} AS cluster_id FROM (SELECT mk.*, CASE WHEN spam_score IS NOT NULL THEN m.cluster_id END AS cluster_id FROM mk LEFT JOIN m ON m.id = mk.id)""")
def anonymous_posts(spark, sf_dir):
    """N10, N15 and F16: digests, pseudonyms, hours, shapes of scrubbed texts, tiers and categories."""
    return N.anonymous_posts(marked(spark, sf_dir), "salt-1")


@query("N10_not_enabled", f"WITH {_MARKED} SELECT mk.id::VARCHAR AS id, mk.text, mk.author_id::VARCHAR AS author, mk.created_at AS hour, printf('%.2f', round(coalesce(spam_score, 0), 2)) AS spam_confidence, CASE WHEN spam_score IS NOT NULL THEN m.cluster_id END::VARCHAR AS cluster_id FROM mk LEFT JOIN m ON m.id = mk.id")
def plain_posts(spark, sf_dir):
    return N.anonymous_posts(marked(spark, sf_dir), "salt-1", enabled=False)


@query("N10_anonymous_accounts", f"""WITH {ACCOUNTS_SQL} SELECT {_DIGEST.format('id')} AS id, is_verified, (coalesce(bio, '') <> '')::INT + (coalesce(location, '') <> '')::INT + (website <> '')::INT + (profile_image_url <> '')::INT >= 2 AS profile_complete, {_tier('account_age', 'account_age_days')} AS age, {_tier('followers', 'followers_count')} AS followers,
CASE WHEN tweets_per_day = 0 THEN 'inactive' WHEN tweets_per_day < 1 THEN 'low' WHEN tweets_per_day < 10 THEN 'moderate' WHEN tweets_per_day < 50 THEN 'high' ELSE 'extreme' END AS activity, {_tier('bot', 'bot_score')} AS bot, CASE WHEN coalesce(location, '') <> '' THEN {_REGION.replace('$', 'lower(location)')} END AS location FROM acc""")
def anonymous_accounts(spark, sf_dir):
    """N10 and N13: an account's digest, tiers, region, and whether its profile is complete."""
    return N.anonymous_accounts(accounts(spark, sf_dir), "salt-1")


_KIND = "CASE WHEN u > 0.5 THEN 'contains_urls' WHEN me > 0.5 THEN 'contains_mentions' WHEN h > 0.5 THEN 'contains_hashtags' ELSE 'text_similarity' END"


@query("N10_anonymous_clusters", f"""WITH {_STATS} SELECT {_DIGEST.format('cluster_id')} AS cluster_id, size, unique_accounts, {_LEVEL} AS suspicion_level, swarm OR few AS is_coordinated, date_trunc('hour', first_seen) AS first_hour, date_trunc('hour', last_seen) AS last_hour, {_KIND} AS pattern,
{shape_sql(scrub_sql("CASE WHEN strlen(shortest) > 100 THEN substr(shortest, 1, 97) || '...' ELSE shortest END"))} AS template, round({noise_sql('confidence', "('confidence-' || cluster_id)", 0.05, 0.5, 3, 'uniform')}, 6) AS confidence, round({noise_sql('tpm', "('rate-' || cluster_id)", 0.1, 0.5, 3, 'uniform')}, 6) AS tweets_per_minute FROM s""")
def anonymous_clusters(spark, sf_dir):
    """N9 and N10: clusters with the pattern's kind alone, the template's shape, and noise."""
    return N.anonymous_clusters(clusters(spark, sf_dir), "salt-1", 0.5, 3).withColumns({c: F.round(c, 6) for c in ("confidence", "tweets_per_minute")})


@query("N9_id_lists", f"WITH {_STATS} SELECT {_DIGEST.format('cluster_id')} AS cluster_id, {_DIGEST.format('id')} AS id FROM m")
def id_lists(spark, sf_dir):
    """Each cluster's posts by digest, a row for each post, as a list may be as long as the table."""
    return members(spark, sf_dir).select(N.field(F.col("cluster_id").cast("string"), "cluster_id", "salt-1").alias("cluster_id"), N.field(F.col("id").cast("string"), "tweet_id", "salt-1").alias("id"))


@query("N3_methods", "SELECT c_custkey, substr(sha256('salt-1' || c_name), 1, 16) AS hashed, 'USER_' || upper(substr(sha256('salt-1' || c_name), 1, 8)) AS named, '[REDACTED]' AS suppressed, substr(sha256('salt-1' || c_name), 1, 16) AS encrypted, c_name AS off FROM customer")
def methods(spark, sf_dir):
    """Every way to treat a field; what is not built falls back to the digest."""
    f = lambda method, enabled=True: N.field(F.col("c_name"), "account_id", "salt-1", method, enabled)
    return table(spark, sf_dir, "customer").select("c_custkey", f("hash").alias("hashed"), f("pseudonymize").alias("named"), f("suppress").alias("suppressed"), f("encrypt").alias("encrypted"), f("hash", False).alias("off"))


@query("M4_metric_alerts", "SELECT event_type, r AS rule FROM (SELECT event_type, unnest([CASE WHEN count(*) > 100 THEN 'busy' END, CASE WHEN avg(value) <= 50 THEN 'cheap' END]) AS r FROM events GROUP BY event_type) WHERE r IS NOT NULL")
def metric_alerts(spark, sf_dir):
    rules = spark.createDataFrame([("busy", "events", "gt", 100.0), ("cheap", "mean_value", "lte", 50.0), ("unknown", "no_such_metric", "gt", 0.0)], "rule string, metric string, operator string, threshold double")
    per = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("events"), F.avg("value").alias("mean_value"))
    facts = per.select("event_type", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("events", "mean_value")])).alias("f")).select("event_type", "f.metric", "f.value")
    return A.matches(facts, rules).select("event_type", "rule")


@query("M9_builtin_alerts", f"WITH {_STATS}, t AS (SELECT coalesce(sum(size) FILTER (confidence >= {CONFIG.spam_score_threshold}), 0) / (SELECT count(*) FROM p)::DOUBLE AS rate FROM s) SELECT 'cluster' AS source, cluster_id::VARCHAR AS name, confidence AS value, size > 10 AND confidence > 0.8 AS fires FROM s UNION ALL SELECT 'spam_rate', 'all', round(rate, 9), rate > 0.5 FROM t")
def builtin_alerts(spark, sf_dir):
    """The engine's own alerts with their fixed limits: clusters of more than 10 posts and over .8, and a spam rate over a half; and what does not fire."""
    found = clusters(spark, sf_dir).checkpoint()
    total = posts(spark, sf_dir).agg(F.count("*").alias("n"))
    spam = found.agg(F.coalesce(F.sum(F.when(F.col("confidence") >= CONFIG.spam_score_threshold, F.col("size"))), F.lit(0)).alias("spam"))
    return A.builtin(found, spam.join(total, F.lit(True)).select(F.try_divide(F.col("spam").cast("double"), F.col("n")).alias("rate")))  # a row each


@query("M16_alert_records", f"WITH {_STATS} SELECT cluster_id, 'Cluster alert: big' AS title, 'Cluster alert ' || cluster_id || ': ' || size || ' posts, confidence ' || printf('%.2f', round(confidence, 2)) AS message, {_LEVEL} AS severity, 'active' AS status FROM s WHERE size >= 3")
def alert_records(spark, sf_dir):
    fired = clusters(spark, sf_dir).where("size >= 3").select("cluster_id", F.lit("big").alias("rule"), F.col("suspicion_level").alias("severity"), "size", "confidence")
    return A.records(fired, "Cluster alert", "cluster_id").select("cluster_id", "title", "message", "severity", "status")


_BURSTS = "b AS (SELECT event_type, count(*) AS event_count, round(count(*) / 500.0::DOUBLE, 6) AS confidence, count(*) / 720.0::DOUBLE AS frequency FROM events GROUP BY event_type)"


@query("M3_pattern_alerts", f"WITH {_BURSTS} SELECT event_type, r AS rule FROM (SELECT event_type, unnest([CASE WHEN event_count > 1000 THEN 'many' END, CASE WHEN frequency >= 1.5 THEN 'often' END, CASE WHEN confidence >= 0.8 THEN 'unknown' END]) AS r FROM b) WHERE r IS NOT NULL")
def pattern_alerts(spark, sf_dir):
    """Rules on patterns; one on an unknown metric asks for a confidence of .8."""
    rules = spark.createDataFrame([("many", "event_count", "gt", 1000.0), ("often", "frequency", "gte", 1.5), ("unknown", "colour", "lt", 0.0)], "rule string, metric string, operator string, threshold double")
    n = F.count("*")
    b = table(spark, sf_dir, "events").groupBy("event_type").agg(n.cast("double").alias("event_count"), F.round(n / 500.0, 6).alias("confidence"), (n / 720.0).alias("frequency"))
    facts = b.select("event_type", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("event_count", "confidence", "frequency")])).alias("f")).select("event_type", "f.metric", "f.value")
    return A.evaluated(facts, rules, "pattern").select("event_type", "rule")


@query("M16_pattern_records", f"WITH {_BURSTS} SELECT event_type, 'Temporal pattern: ' || event_type AS title, 'A burst pattern of ' || event_count || ' events, confidence ' || printf('%.2f', round(confidence, 2)) || ', ' || printf('%.2f', round(frequency, 2)) || ' events an hour' AS message, 'active' AS status FROM b")
def pattern_records(spark, sf_dir):
    n = F.count("*")
    b = table(spark, sf_dir, "events").groupBy("event_type").agg(n.alias("event_count"), F.round(n / 500.0, 6).alias("confidence"), (n / 720.0).alias("frequency"))
    return A.pattern_records(b, "event_type", "burst").select("event_type", "title", "message", "status")


@query("M16_metric_records", "SELECT event_type, 'Metric threshold exceeded: mean_value' AS title, 'Metric mean_value has reached ' || printf('%.2f', round(avg(value), 2)) || ', over the threshold of 40.00' AS message FROM events GROUP BY event_type HAVING avg(value) > 40")
def metric_records(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("value")).where("value > 40")
    return A.metric_records(per, "event_type", "mean_value", 40.0).select("event_type", "title", "message")


@query("M1_rule_checks", "SELECT * FROM (VALUES ('good', NULL), ('', 'no name'), ('silent', 'no channel'), ('lost', 'unknown channel: pager'), (NULL, 'no name')) AS s(rule, fault)")
def rule_checks(spark, sf_dir):
    rules = spark.createDataFrame([("good", ["log", "chat"]), ("", ["log"]), ("silent", []), ("lost", ["log", "pager"]), (None, ["log"])], "rule string, channels array<string>")
    return A.checked(rules, ["log", "chat"]).select("rule", "fault")


@query("M6_alert_history", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'error') WHERE k <= 1000")
def alert_history(spark, sf_dir):
    return A.history(table(spark, sf_dir, "events").where("event_type = 'error'").withColumnRenamed("event_id", "id")).select(F.col("id").alias("event_id"))


@query("M8_fan_out", "SELECT event_id AS id, channel FROM events JOIN (VALUES ('error', 'log'), ('error', 'chat'), ('signup', 'log')) AS c(rule, channel) ON rule = event_type")
def fan_out(spark, sf_dir):
    rules = spark.createDataFrame([("error", ["log", "chat"]), ("signup", ["log"]), ("view", [])], "rule string, channels array<string>")
    return A.fanned_out(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("rule")), rules).select("id", "channel")


@query("M15_aggregations", "SELECT a AS aggregation, start_us, round(CASE a WHEN 'sum' THEN s WHEN 'avg' THEN s / n WHEN 'max' THEN hi WHEN 'min' THEN lo WHEN 'count' THEN n ELSE n / 86400.0::DOUBLE END, 9) AS value FROM (SELECT epoch_us(ts) // 86400000000 * 86400000000 AS start_us, sum(value) AS s, count(value) AS n, max(value) AS hi, min(value) AS lo FROM events GROUP BY 1), (VALUES ('sum'), ('avg'), ('max'), ('min'), ('count'), ('rate')) AS v(a)")
def aggregations(spark, sf_dir):
    """Every way a metric condition sums a day up."""
    e = events(spark, sf_dir)
    parts = [A.aggregated(e, "ts", "value", a, "1 day").select(F.lit(a).alias("aggregation"), F.unix_micros("start").alias("start_us"), F.round("value", 9).alias("value")) for a in (*A.AGGREGATIONS, "rate")]
    return reduce(DataFrame.unionByName, parts)


@query("M7_escalations", """SELECT event_id AS id, level FROM events, (VALUES (0, 300), (1, 3600), (2, 86400)) AS l(level, after_s) WHERE event_type = 'error' AND ts + to_seconds(after_s) <= least(CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 30 MINUTE ELSE TIMESTAMP '2024-01-20' END, TIMESTAMP '2024-01-20')""")
def escalated(spark, sf_dir):
    errors = events(spark, sf_dir).where("event_type = 'error'").select(F.col("event_id").alias("id"), "ts", F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("acknowledged_at"))
    return A.escalations(errors, [(0, 300), (1, 3600), (2, 86400)], "2024-01-20 00:00:00")


@query("F14_age_weights", "SELECT event_id, round(exp(-(epoch_us(max(ts) OVER (PARTITION BY user_id)) - epoch_us(ts)) / 3.6e9::DOUBLE / 168), 9) AS weight FROM events")
def age_weights(spark, sf_dir):
    us = F.unix_micros("ts")
    return events(spark, sf_dir).select("event_id", F.round(F.exp(-(F.max(us).over(Window.partitionBy("user_id")) - us) / 3.6e9 / 168), 9).alias("weight"))


@query("F15_severity", "SELECT event_type, i AS confidence_pct, CASE WHEN i / 100.0::DOUBLE * n / 100 > 0.8 THEN 'critical' WHEN i / 100.0::DOUBLE * n / 100 > 0.6 THEN 'high' WHEN i / 100.0::DOUBLE * n / 100 > 0.4 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT event_type, count(*) // 20 AS n FROM events GROUP BY event_type), range(0, 101, 7) AS s(i)")
def severities(spark, sf_dir):
    """Severity by confidence and number of events, over a grid of confidences."""
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.expr("count(*) div 20").alias("n"))
    grid = counts.withColumn("confidence_pct", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(100).cast("bigint"), F.lit(7).cast("bigint"))))
    return grid.select("event_type", "confidence_pct", scores.severity(F.col("confidence_pct") / F.lit(100.0), F.col("n")).alias("severity"))
