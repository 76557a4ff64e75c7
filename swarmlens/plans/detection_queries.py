"""Queries of accounts, filters and clusters."""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import Window
from pyspark.sql import functions as F

from swarmlens.operators import detection as D
from swarmlens.operators.engine import Engine, near_clusters, posts_of_cluster
from swarmlens.operators.graphs import written
from swarmlens.plans.register import query, table
from swarmlens.plans.similarity_queries import CONFIG, MINHASH_OF_TEXTS, SIMHASH, leaders_sql, placed_sql
from swarmlens.sources.adapters import ACCOUNTS_SQL, POSTS_SQL, WHITE, accounts, posts, text_facts

_MEMBERS = f"""{ACCOUNTS_SQL},
{POSTS_SQL},
g AS (SELECT text, min(id) AS cluster_id FROM p WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1),
m AS (SELECT cluster_id, p.*, coalesce(bot_score, 0) AS bot_score FROM p JOIN g USING (text) LEFT JOIN acc ON acc.id = author_id)"""
_SCORED = """a AS (SELECT cluster_id, count(*) AS size, min(created_at) AS first_seen, max(created_at) AS last_seen, sum(strlen(text)) // count(*) AS len, arg_min(text, (strlen(text), id)) AS shortest,
 avg((len(urls) > 0)::INT) AS u, avg((len(mentions) > 0)::INT) AS me, avg((len(hashtags) > 0)::INT) AS h, epoch_us(max(created_at)) / 1e6 - epoch_us(min(created_at)) / 1e6 AS duration_s FROM m GROUP BY cluster_id),
b AS (SELECT cluster_id, count(author_id) AS unique_accounts, avg(bs) AS avg_bot_score FROM (SELECT cluster_id, author_id, max(bot_score) AS bs FROM m GROUP BY ALL) GROUP BY cluster_id),
s0 AS (SELECT *, CASE WHEN duration_s > 0 THEN size / (duration_s / 60) ELSE 0 END AS tpm FROM a JOIN b USING (cluster_id)),
s AS (SELECT *, round(0.3::DOUBLE * least(1, size / 100.0::DOUBLE) + CASE WHEN duration_s < 3600 AND size > 5 THEN 0.3::DOUBLE WHEN duration_s < 3600 AND size > 3 THEN 0.2::DOUBLE ELSE 0 END + 0.2::DOUBLE * (1 - unique_accounts / size::DOUBLE) + 0.2::DOUBLE * avg_bot_score, 9) AS confidence,
 size >= 5 AND unique_accounts >= 3 AND tpm > 2 AS swarm, size >= 10 AND unique_accounts <= 3 AS few FROM s0)"""
_STATS = f"{_MEMBERS},\n{_SCORED}"


def _nested(name: str, edges: str, table: str, least: int) -> str:
    """CTE ``name`` (id, cluster_id): near-duplicate clusters of the posts p, in a scope of its own."""
    source = "t AS (SELECT min(id) AS id, text FROM p WHERE text IS NOT NULL GROUP BY text)"
    return f"{name} AS MATERIALIZED (WITH RECURSIVE {source},\n{edges},\n{leaders_sql(table, 'z_')},\n{placed_sql('p', 'id', 'text', 'z_')} SELECT id, cluster_id FROM z_nc QUALIFY count(*) OVER (PARTITION BY cluster_id) >= {least})"


_JOINED = "m AS (SELECT cluster_id, p.*, coalesce(bot_score, 0) AS bot_score FROM p JOIN placed USING (id) LEFT JOIN acc ON acc.id = author_id)"
_NEAR_MEMBERS = f"{ACCOUNTS_SQL},\n{POSTS_SQL},\n{_nested('placed', MINHASH_OF_TEXTS, 'me', 2)},\n{_JOINED}"
_HYBRID = f"""{ACCOUNTS_SQL},\n{POSTS_SQL},\n{_nested('mh', MINHASH_OF_TEXTS, 'me', CONFIG.min_cluster_size)},\n{_nested('sh', SIMHASH, 'se', CONFIG.min_cluster_size)},
few AS (SELECT sh.cluster_id FROM sh LEFT JOIN mh ON mh.id = sh.id GROUP BY sh.cluster_id HAVING count(mh.id) / count(*)::DOUBLE < 0.5),
placed AS (SELECT id, 'minhash-' || cluster_id AS cluster_id FROM mh UNION ALL SELECT id, 'simhash-' || cluster_id FROM sh SEMI JOIN few USING (cluster_id)),
{_JOINED},
{_SCORED}"""


def near_sql(sql: str) -> str:
    """The SQL of a query on clusters of equal texts, over clusters of near duplicates."""
    assert _MEMBERS in sql
    return sql.replace(_MEMBERS, _NEAR_MEMBERS)



#: Whether members() takes near duplicates; the queries X_near_... set it while they are planned.
NEAR = ContextVar("NEAR", default=False)


def members(spark, sf_dir, facts=None):
    """Posts of clusters of equal texts (of near-duplicate texts under NEAR), with their authors' scores.

    Under NEAR the posts are met with their events once and kept as ``text_facts``
    (``facts``, where that is done already); a text is read again for its signature alone.
    """
    if NEAR.get():
        all_posts = facts or written(text_facts(spark, sf_dir))
        placed = near_clusters(table(spark, sf_dir, "documents"), "minhash", keyed=all_posts.where("key IS NOT NULL").select("id", "key"))
    else:
        all_posts = posts(spark, sf_dir)
        keyed = all_posts.where(F.col("text").isNotNull()).select("id", F.md5("text").alias("key"))
        groups = keyed.groupBy("key").agg(F.min("id").alias("cluster_id"), F.count("*").alias("n")).where("n > 1")
        placed = keyed.join(groups, "key").select("id", "cluster_id")
    scores = accounts(spark, sf_dir).select(F.col("id").alias("author_id"), "bot_score")
    return all_posts.join(placed, "id").join(scores, "author_id", "left").withColumn("bot_score", F.coalesce("bot_score", F.lit(0.0)))


def clusters(spark, sf_dir):
    return D.scored(D.cluster_stats(members(spark, sf_dir)))


@query("F11_bot_score", f"WITH {ACCOUNTS_SQL} SELECT id, username, bot_score, bot_score > 0.5 AS is_suspicious FROM acc")
def bot_scores(spark, sf_dir):
    return accounts(spark, sf_dir).select("id", "username", "bot_score", "is_suspicious")


@query("O1_top_accounts", f"WITH {ACCOUNTS_SQL} SELECT id, bot_score FROM acc ORDER BY bot_score DESC, id LIMIT 50")
def top_accounts(spark, sf_dir):
    return accounts(spark, sf_dir).select("id", "bot_score").orderBy(F.desc("bot_score"), "id").limit(50)


_OBVIOUS = " OR ".join(f"contains(lower(coalesce(text, '')), '{x}')" for x in D.OBVIOUS) + " OR len(hashtags) > 5 OR len(mentions) > 3 OR coalesce(bot_score, 0) > 0.7"


def with_authors(spark, sf_dir):
    """Posts with their author's name and bot score (null without an account)."""
    return posts(spark, sf_dir).join(accounts(spark, sf_dir).select(F.col("id").alias("author_id"), "username", "bot_score"), "author_id", "left")


@query("P2_obvious_spam", f"WITH {ACCOUNTS_SQL},\n{POSTS_SQL} SELECT p.id FROM p LEFT JOIN acc ON acc.id = author_id WHERE {_OBVIOUS}")
def obvious(spark, sf_dir):
    return with_authors(spark, sf_dir).where(D.obvious_spam(F.col("bot_score"))).select("id")


@query("P3_watchlist", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'erent') OR list_has_any(list_transform(regexp_extract_all(text, '#[A-Za-z0-9_]+'), lambda h: lower(ltrim(h, '#'))), ['win', 'tag'])")
def watchlist(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("hashtags", F.regexp_extract_all("text", F.lit("#[A-Za-z0-9_]+"), F.lit(0)))
    return docs.where(D.watched(["License", "ERENT"], ["Win", "tag"])).select("doc_id")


@query("P3_watched_posts", f"WITH {ACCOUNTS_SQL},\n{POSTS_SQL} SELECT p.id FROM p LEFT JOIN acc ON acc.id = author_id WHERE contains(lower(coalesce(text, '')), 'thouin') OR lower(username) IN (SELECT lower(c_name) FROM customer WHERE c_custkey % 6 = 0)")
def watched_posts(spark, sf_dir):
    """A keyword in the text, or an author of a watch list of any length: a table of names, joined by the lowered name."""
    names = table(spark, sf_dir, "customer").where("c_custkey % 6 = 0").select(F.col("c_name").alias("username"))
    return D.watched_by(with_authors(spark, sf_dir), names, ["THOUIN"]).select("id")


@query("P1_include_filter", f"WITH {ACCOUNTS_SQL},\n{POSTS_SQL} SELECT p.id FROM p LEFT JOIN acc ON acc.id = author_id WHERE retweet_count >= 5 AND created_at >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 240 HOUR AND (contains(lower(text), 'the') OR {_OBVIOUS})")
def include(spark, sf_dir):
    return D.included(with_authors(spark, sf_dir), "2024-01-10 00:00:00", 5, 240, ["the"]).select("id")


@query("J1_author_join", f"WITH {ACCOUNTS_SQL},\n{POSTS_SQL} SELECT p.id, username, account_age_days FROM p JOIN acc ON acc.id = author_id")
def author_join(spark, sf_dir):
    return posts(spark, sf_dir).select("id", "author_id").join(accounts(spark, sf_dir).select(F.col("id").alias("author_id"), "username", "account_age_days"), "author_id").select("id", "username", "account_age_days")


@query("A1_cluster_stats", f"WITH {_STATS} SELECT cluster_id, size, first_seen, last_seen, unique_accounts, round(duration_s, 3) AS duration_s, round(tpm, 6) AS tweets_per_minute, round(avg_bot_score, 9) AS avg_bot_score FROM s")
def cluster_stats(spark, sf_dir):
    return clusters(spark, sf_dir).select("cluster_id", "size", "first_seen", "last_seen", "unique_accounts", F.round("duration_s", 3).alias("duration_s"), F.round("tweets_per_minute", 6).alias("tweets_per_minute"), F.round("avg_bot_score", 9).alias("avg_bot_score"))


_LEVEL = "CASE WHEN swarm THEN 'high' WHEN few THEN 'critical' WHEN confidence >= 0.8 THEN 'critical' WHEN confidence >= 0.6 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END"


@query("A2_confidence", f"WITH {_STATS} SELECT cluster_id, confidence, {_LEVEL} AS suspicion_level FROM s")
def confidence(spark, sf_dir):
    return clusters(spark, sf_dir).select("cluster_id", "confidence", "suspicion_level")


@query("A3_coordination", f"WITH {_STATS} SELECT cluster_id, swarm OR few AS is_coordinated FROM s")
def coordination(spark, sf_dir):
    return clusters(spark, sf_dir).select("cluster_id", "is_coordinated")


@query("A4_pattern", f"WITH {_STATS} SELECT cluster_id, 'Text similarity cluster (avg length: ' || len || ' chars)' || CASE WHEN u > 0.5 THEN ', contains URLs' ELSE '' END || CASE WHEN me > 0.5 THEN ', contains mentions' ELSE '' END || CASE WHEN h > 0.5 THEN ', contains hashtags' ELSE '' END AS pattern FROM s")
def pattern(spark, sf_dir):
    return clusters(spark, sf_dir).select("cluster_id", "pattern")


@query("A5_template", f"WITH {_STATS} SELECT cluster_id, CASE WHEN strlen(shortest) > 100 THEN substr(shortest, 1, 97) || '...' ELSE shortest END AS template FROM s")
def template(spark, sf_dir):
    return clusters(spark, sf_dir).select("cluster_id", "template")


_SPAM = CONFIG.spam_score_threshold


@query("A6_detection_result", f"WITH {_STATS}, k AS (SELECT * FROM s WHERE confidence >= {_SPAM}), n AS (SELECT count(*) AS total_tweets FROM p), q AS (SELECT coalesce(sum(size), 0)::BIGINT AS spam_tweets, count(*) AS spam_clusters, max(size) AS largest_cluster, round(avg(size), 6) AS avg_cluster_size, count(*) FILTER (swarm OR few) AS coordinated_clusters FROM k) SELECT *, round(spam_tweets / total_tweets::DOUBLE, 9) AS spam_rate FROM n, q")
def detection_result(spark, sf_dir):
    total = posts(spark, sf_dir).agg(F.count("*").alias("total_tweets"))
    found = clusters(spark, sf_dir).where(F.col("confidence") >= _SPAM).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("spam_tweets"), F.count("*").alias("spam_clusters"), F.max("size").alias("largest_cluster"), F.round(F.avg("size"), 6).alias("avg_cluster_size"), F.count_if("is_coordinated").alias("coordinated_clusters"))
    return total.join(found, F.lit(True)).withColumn("spam_rate", F.round(F.try_divide(F.col("spam_tweets").cast("double"), F.col("total_tweets")), 9))  # a row each


@query("A7_spam_marking", f"WITH {_STATS} SELECT m.id, m.cluster_id, confidence AS spam_score, confidence >= {_SPAM} AS is_spam FROM m JOIN s USING (cluster_id)")
def marking(spark, sf_dir):
    """Every post of a cluster with the cluster's confidence, and whether that makes it spam."""
    found = members(spark, sf_dir).checkpoint()
    score = D.scored(D.cluster_stats(found)).select("cluster_id", F.col("confidence").alias("spam_score"), (F.col("confidence") >= _SPAM).alias("is_spam"))
    return found.select("id", "cluster_id").join(score, "cluster_id")


@query("A8_account_spam", f"WITH {_STATS} SELECT author_id, count(DISTINCT m.cluster_id) FILTER (confidence >= {_SPAM}) AS spam_clusters, count(*) FILTER (confidence >= {_SPAM}) AS spam_tweets, count(*) AS clustered FROM m JOIN s USING (cluster_id) GROUP BY author_id")
def account_spam(spark, sf_dir):
    """Per author of clustered posts: how many spam clusters and spam posts, and all clustered posts."""
    found = members(spark, sf_dir).checkpoint()
    spam = D.scored(D.cluster_stats(found)).select("cluster_id", (F.col("confidence") >= _SPAM).alias("is_spam"))
    each = found.groupBy("author_id", "cluster_id").count().join(spam, "cluster_id")
    return each.groupBy("author_id").agg(F.count_if("is_spam").alias("spam_clusters"), F.sum(F.when(F.col("is_spam"), F.col("count")).otherwise(0)).alias("spam_tweets"), F.sum("count").alias("clustered"))


@query("P7_min_cluster_size", f"WITH {_STATS} SELECT cluster_id, size FROM s WHERE size >= 3")
def big_clusters(spark, sf_dir):
    return members(spark, sf_dir).groupBy("cluster_id").agg(F.count("*").alias("size")).where("size >= 3")


@query("P9_suspicious_accounts", f"WITH {_STATS}, c AS (SELECT author_id, count(DISTINCT cluster_id) AS n FROM m JOIN s USING (cluster_id) WHERE confidence >= {_SPAM} GROUP BY author_id) SELECT acc.id, bot_score, coalesce(n, 0) AS spam_tweet_count FROM acc LEFT JOIN c ON c.author_id = acc.id WHERE bot_score > 0.5 OR n > 0 ORDER BY bot_score DESC, acc.id")
def suspicious(spark, sf_dir):
    spam = account_spam(spark, sf_dir).select(F.col("author_id").alias("id"), F.col("spam_clusters").alias("spam_tweet_count"))
    return accounts(spark, sf_dir).join(spam, "id", "left").select("id", "bot_score", F.coalesce("spam_tweet_count", F.lit(0)).alias("spam_tweet_count"), "is_suspicious").where("is_suspicious OR spam_tweet_count > 0").drop("is_suspicious").orderBy(F.desc("bot_score"), "id")


@query("A10_app_stats", f"WITH {_STATS}, q AS (SELECT count(*) AS n_accounts, round(avg(bot_score), 9) AS avg_bot_score, count(*) FILTER (bot_score >= 0.7) AS high_risk FROM acc), r AS (SELECT count(*) AS n_clusters, max(size) AS largest, round(avg(size), 6) AS avg_size, count(*) FILTER (swarm OR few) AS coordinated, coalesce(sum(size) FILTER (confidence >= {_SPAM}), 0)::BIGINT AS spam_tweets FROM s), t AS (SELECT count(*) AS total_tweets FROM p) SELECT *, round(spam_tweets / total_tweets::DOUBLE, 9) AS spam_rate FROM q, r, t")
def app_stats(spark, sf_dir):
    a = accounts(spark, sf_dir).agg(F.count("*").alias("n_accounts"), F.round(F.avg("bot_score"), 9).alias("avg_bot_score"), F.count_if(F.col("bot_score") >= 0.7).alias("high_risk"))
    c = clusters(spark, sf_dir).agg(F.count("*").alias("n_clusters"), F.max("size").alias("largest"), F.round(F.avg("size"), 6).alias("avg_size"), F.count_if("is_coordinated").alias("coordinated"), F.coalesce(F.sum(F.when(F.col("confidence") >= _SPAM, F.col("size"))), F.lit(0)).alias("spam_tweets"))
    t = posts(spark, sf_dir).agg(F.count("*").alias("total_tweets"))
    return a.join(c, F.lit(True)).join(t, F.lit(True)).withColumn("spam_rate", F.round(F.try_divide(F.col("spam_tweets").cast("double"), F.col("total_tweets")), 9))  # a row each


@query("A11_account_activity", f"WITH {_MEMBERS} SELECT p.author_id, count(*) AS total, count(m.id) AS spam, round(count(m.id) / count(*)::DOUBLE, 9) AS spam_rate, count(DISTINCT m.cluster_id) AS clusters FROM p LEFT JOIN m ON m.id = p.id GROUP BY p.author_id")
def account_activity(spark, sf_dir):
    facts = written(text_facts(spark, sf_dir)) if NEAR.get() else None
    marked = (facts or posts(spark, sf_dir)).select("id", "author_id").join(members(spark, sf_dir, facts).select("id", "cluster_id"), "id", "left")
    return marked.groupBy("author_id").agg(F.count("*").alias("total"), F.count("cluster_id").alias("spam"), F.round(F.count("cluster_id") / F.count("*"), 9).alias("spam_rate"), F.count_distinct("cluster_id").alias("clusters"))


@query("O6_hourly_quota", "SELECT event_id, nth FROM (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id)::INT AS nth FROM events) WHERE nth <= 5")
def quota(spark, sf_dir):
    return D.hourly_quota(table(spark, sf_dir, "events"), "ts", "event_id", 5).select("event_id", "nth")


@query("O4_recent_posts", f"WITH {POSTS_SQL} SELECT id, created_at FROM p ORDER BY created_at DESC, id LIMIT 100")
def recent(spark, sf_dir):
    return posts(spark, sf_dir).select("id", "created_at").orderBy(F.desc("created_at"), "id").limit(100)


@query("W6_first_post_of_account", f"WITH {_MEMBERS} SELECT cluster_id, author_id, min(id) AS id FROM m GROUP BY ALL")
def first_post(spark, sf_dir):
    return members(spark, sf_dir).groupBy("cluster_id", "author_id").agg(F.min("id").alias("id"))


@query("W4_last_events", "SELECT user_id, event_id, nth FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id)::INT AS nth FROM events) WHERE nth <= 10")
def last_events(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("nth", F.row_number().over(order)).where("nth <= 10").select("user_id", "event_id", "nth")


@query("S5_lines", r"SELECT doc_id, i AS line, 'user_' || i AS username, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS i, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''")
def line_source(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    return cut.select("doc_id", (F.col("at") + 1).alias("line"), F.concat(F.lit("user_"), (F.col("at") + 1).cast("string")).alias("username"), F.btrim("raw", F.lit(WHITE)).alias("text")).where("text <> ''")


@query("D0_detect", f"WITH {_HYBRID}, k AS (SELECT * FROM s WHERE confidence >= {_SPAM}) SELECT 'hybrid' AS algorithm, {CONFIG.minhash_threshold}::DOUBLE AS threshold, {CONFIG.min_cluster_size} AS min_cluster_size, (SELECT count(*) FROM p) AS total_tweets, coalesce(sum(size), 0)::BIGINT AS spam_tweets, count(*) AS spam_clusters, max(size) AS largest_cluster, avg(size) AS avg_cluster_size, count(*) FILTER (swarm OR few) AS coordinated_clusters, coalesce(sum(size), 0) / (SELECT count(*) FROM p)::DOUBLE AS spam_rate FROM k")
def detect(spark, sf_dir):
    """The whole engine with its documented settings: hybrid clusters of near duplicates, scored, filtered and summed up."""
    return Engine(CONFIG).detect(posts(spark, sf_dir), accounts(spark, sf_dir)).result


@query("D0_clusters", f"WITH {_HYBRID} SELECT cluster_id, size, unique_accounts, first_seen, last_seen, confidence, swarm OR few AS is_coordinated, 'hybrid' AS detection_method, confidence >= {_SPAM} AS is_spam FROM s")
def detected_clusters(spark, sf_dir):
    found = Engine(CONFIG).detect(posts(spark, sf_dir), accounts(spark, sf_dir)).clusters
    return found.select("cluster_id", "size", "unique_accounts", "first_seen", "last_seen", "confidence", "is_coordinated", "detection_method", "is_spam")


@query("D0_low_threshold", f"WITH {_HYBRID} SELECT m.id, m.cluster_id, confidence AS spam_score FROM m JOIN s USING (cluster_id) WHERE confidence >= 0.05")
def detected_posts(spark, sf_dir):
    """Marked posts of an engine whose spam threshold was updated to .05."""
    return Engine(CONFIG).updated(spam_score_threshold=0.05).detect(posts(spark, sf_dir), accounts(spark, sf_dir)).marked
