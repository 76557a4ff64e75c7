"""Queries of temporal analysis, reputation, privacy, alerts and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from swarmlens.functions import scores
from swarmlens.operators import alerts as A
from swarmlens.operators import detection as D
from swarmlens.operators import graphs
from swarmlens.operators import privacy as N
from swarmlens.operators import reputation as R
from swarmlens.operators import temporal as T
from swarmlens.plans.detection_queries import clusters, members
from swarmlens.plans.detection_queries import _STATS
from swarmlens.plans.register import query, table
from swarmlens.sources.adapters import ACCOUNTS_SQL, POSTS_SQL, accounts, events, posts

_STEP = 360_000_000
#: A null type is named while the SQL joins on it.
_KEY, _OUT = "coalesce(event_type, '(null)') AS event_type", "nullif(event_type, '(null)') AS event_type"
_RATES = f"""tv AS MATERIALIZED (SELECT {_KEY}, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL),
sp AS (SELECT {_KEY}, min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last FROM events GROUP BY ALL),
gr AS (SELECT event_type, first, unnest(range(0, (last - first - 1) // {_STEP} + 1)) AS i FROM sp WHERE last > first),
rt AS (SELECT gr.event_type, i, first + i * {_STEP} AS start_us, (SELECT count(*) FROM tv WHERE tv.event_type = gr.event_type AND us > first + i * {_STEP} AND us < first + i * {_STEP} + {10 * _STEP}) AS n FROM gr)"""


def rates(spark, sf_dir):
    return T.sliding_rates(table(spark, sf_dir, "events"), "event_type", "ts", 3600)


@query("T1_sliding_rates", f"WITH {_RATES} SELECT {_OUT}, i, start_us, n, round(n / 60.0::DOUBLE, 9) AS rate FROM rt")
def sliding(spark, sf_dir):
    return rates(spark, sf_dir).withColumn("rate", F.round("rate", 9))


_CDF = "0.3989423::DOUBLE * exp(-z*z/2) * t * (0.3193815::DOUBLE + t*(-0.3565638::DOUBLE + t*(1.781478::DOUBLE + t*(-1.821256::DOUBLE + t*1.330274::DOUBLE))))"


@query("T2_burst", f"""WITH {_RATES}, st AS (SELECT event_type, avg(n / 60.0::DOUBLE) AS mean, stddev_pop(n / 60.0::DOUBLE) AS sigma, max(n) AS mx FROM rt GROUP BY event_type),
pk AS (SELECT event_type, min(i) AS peak_i FROM rt JOIN st USING (event_type) WHERE n = mx GROUP BY event_type),
eg AS (SELECT event_type, max(i + 1) FILTER (i <= peak_i) AS start_i, min(i) FILTER (i >= peak_i) AS end_i FROM rt JOIN st USING (event_type) JOIN pk USING (event_type) WHERE n < 0.3 * mx GROUP BY event_type),
z AS (SELECT event_type, (mx / 60.0::DOUBLE - mean) / sigma AS z FROM st), c AS (SELECT {_KEY}, count(*) AS n_events FROM events GROUP BY ALL),
q AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM z)
SELECT {_OUT}, n_events, round(z, 6) AS z, z > 2 AS is_burst, round(least(1, abs(z) / 5) * least(1, n_events / 10.0::DOUBLE), 6) AS confidence, round(2 * {_CDF}, 6) AS p_value, start_i, peak_i, end_i FROM q JOIN c USING (event_type) JOIN pk USING (event_type) LEFT JOIN eg USING (event_type)""")
def burst(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = T.bursts(T.sliding_rates(e, "event_type", "ts", 3600), e, "event_type")
    return out.withColumns({c: F.round(c, 6) for c in ("z", "confidence", "p_value")})


@query("T3_periodic", """WITH us AS (SELECT event_type, epoch_us(ts) AS us FROM events), sp AS (SELECT event_type, min(us) AS first, max(us) - min(us) AS len FROM us GROUP BY event_type),
g AS (SELECT event_type, first, p::INT AS period_min, len // (p::BIGINT * 60000000) AS nb FROM sp, range(20, 241) AS s(p) WHERE len // (p::BIGINT * 60000000) >= 2),
ce AS (SELECT event_type, period_min, unnest(range(0, nb)) AS b FROM g),
co AS (SELECT event_type, period_min, (us - first) // (period_min::BIGINT * 60000000) AS b, count(*) AS n FROM us JOIN g USING (event_type) GROUP BY ALL),
se AS (SELECT ce.event_type, ce.period_min, ce.b, coalesce(n, 0)::DOUBLE AS n FROM ce LEFT JOIN co ON ce.event_type = co.event_type AND ce.period_min = co.period_min AND ce.b = co.b),
x AS (SELECT event_type, period_min, n - avg(n) OVER (PARTITION BY event_type, period_min) AS d, b FROM se),
y AS (SELECT event_type, period_min, d, lead(d) OVER (PARTITION BY event_type, period_min ORDER BY b) AS e FROM x),
c AS (SELECT event_type, period_min, CASE WHEN sum(d * d) = 0 THEN 0 ELSE sum(d * e) / sum(d * d) END AS r FROM y WHERE e IS NOT NULL GROUP BY ALL),
n AS (SELECT event_type, count(*) AS n, (max(us) - min(us)) / 3.6e9::DOUBLE AS hours FROM us GROUP BY event_type HAVING count(*) >= 10)
SELECT event_type, period_min, round(r, 6) AS correlation, r > 0.7 AS is_periodic, round(n / hours, 6) AS frequency, CASE WHEN r * n / 100 > 0.8 THEN 'critical' WHEN r * n / 100 > 0.6 THEN 'high' WHEN r * n / 100 > 0.4 THEN 'medium' ELSE 'low' END AS severity FROM c JOIN n USING (event_type)""")
def periodic(spark, sf_dir):
    """Every period of 20 to 240 minutes, whether it is one, and how often a key's events come."""
    out = T.periodic_patterns(table(spark, sf_dir, "events"), "event_type", "ts", 20, 240)
    return out.withColumns({c: F.round(c, 6) for c in ("correlation", "frequency")})


_FIVE = f"""sp AS (SELECT event_type, min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last FROM events GROUP BY event_type),
gr AS (SELECT event_type, unnest(range(0, (last - first - 1) // 30000000 + 1)) AS i FROM sp WHERE last > first),
hi AS (SELECT event_type, (epoch_us(ts) - first) // 30000000 - j AS i, count(*) AS n FROM events JOIN sp USING (event_type), range(11) AS s(j)
 WHERE (epoch_us(ts) - first) // 30000000 - j >= 0 AND epoch_us(ts) - first > ((epoch_us(ts) - first) // 30000000 - j) * 30000000 AND epoch_us(ts) - first < ((epoch_us(ts) - first) // 30000000 - j) * 30000000 + 300000000 GROUP BY ALL),
rt AS (SELECT event_type, coalesce(n, 0) / 5.0::DOUBLE AS rate FROM gr LEFT JOIN hi USING (event_type, i))"""


@query("T5_enriched", f"""WITH {_FIVE}, r AS (SELECT event_type, max(rate) AS peak_intensity, round(avg(rate), 6) AS average_intensity, round(stddev_pop(rate), 6) AS variability FROM rt GROUP BY event_type),
a AS (SELECT event_type, count(DISTINCT user_id) AS accounts, count(*) AS events, round(count(DISTINCT user_id) / count(*)::DOUBLE, 9) AS account_diversity, count(DISTINCT event_id % 7) FILTER (event_id % 7 > 0) AS clusters FROM events GROUP BY event_type),
h AS (SELECT event_type, string_agg(h || '=' || n, ',' ORDER BY h) AS by_hour FROM (SELECT event_type, strftime(ts, '%H') AS h, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type) SELECT * FROM a JOIN r USING (event_type) JOIN h USING (event_type)""")
def enriched(spark, sf_dir):
    """Five-minute rates, diversity, accounts, clusters (six numbers here; 0 stands for none) and hours of each type's events."""
    e = table(spark, sf_dir, "events").withColumn("cluster_id", F.when(F.col("event_id") % 7 > 0, (F.col("event_id") % 7).cast("string")).otherwise(""))
    out = T.enriched(e, "event_type", "ts", "user_id", "cluster_id")
    hours = F.array_join(F.transform(F.map_entries("by_hour"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return out.withColumn("by_hour", hours).withColumns({c: F.round(c, d) for c, d in (("average_intensity", 6), ("variability", 6), ("account_diversity", 9))})


@query("T8_pattern_ttl", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, max(ts) AS end_time FROM events GROUP BY ALL HAVING max(ts) >= TIMESTAMP '2024-01-20' - INTERVAL 48 HOUR")
def pattern_ttl(spark, sf_dir):
    """A day's events of a type as a pattern; those that ended over two days before a time are dropped."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.max("ts").alias("end_time"))
    return T.without_old(days, "end_time", "2024-01-20 00:00:00", 48)


_INTERVALS = "i AS (SELECT event_type, event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id)) / 1e6 AS interval_s FROM events)"


@query("W1_intervals", f"WITH {_INTERVALS} SELECT event_type, event_id, round(interval_s, 6) AS interval_s FROM i")
def intervals(spark, sf_dir):
    return T.intervals(table(spark, sf_dir, "events"), "event_type", "ts", "event_id").select("event_type", "event_id", F.round("interval_s", 6).alias("interval_s"))


@query("T4_coordinated", f"WITH {_INTERVALS} SELECT event_type, count(*) AS n, round(var_pop(interval_s), 3) AS variance, round(1 / (1 + var_pop(interval_s)), 9) AS score, 1 / (1 + var_pop(interval_s)) >= 0.6 AS is_coordinated FROM i GROUP BY event_type")
def coordinated(spark, sf_dir):
    out = T.coordination(table(spark, sf_dir, "events"), "event_type", "ts", "event_id")
    return out.select("event_type", "n", F.round("variance", 3).alias("variance"), F.round("score", 9).alias("score"), "is_coordinated")


@query("A13_rate_statistics", f"WITH {_RATES} SELECT {_OUT}, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS sigma FROM rt GROUP BY ALL")
def rate_stats(spark, sf_dir):
    return rates(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("sigma"))


@query("A14_account_diversity", "SELECT event_type, count(DISTINCT user_id) AS accounts, round(count(DISTINCT user_id) / count(*)::DOUBLE, 9) AS diversity FROM events GROUP BY event_type")
def diversity(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").count().groupBy("event_type").agg(F.count("user_id").alias("accounts"), F.round(F.count("user_id") / F.sum("count"), 9).alias("diversity"))


@query("A15_hour_histogram", "SELECT strftime(ts, '%H') AS hour, count(*) AS n FROM events GROUP BY 1")
def hours(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "HH").alias("hour")).agg(F.count("*").alias("n"))


@query("T16_session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


#: The confidence from which on the engine of these queries marks posts: low, so that every factor is met.
MARK = 0.05
_FACTORS = f"""{_STATS}, fa AS (SELECT id, 'account_age' AS factor, least(1, account_age_days / 365.0::DOUBLE) * 0.2::DOUBLE AS impact FROM acc WHERE account_age_days > 0
UNION ALL SELECT id, 'follower_ratio', CASE WHEN followers_count / following_count::DOUBLE > 10 THEN 0.1::DOUBLE ELSE -0.2::DOUBLE END FROM acc WHERE following_count > 0 AND (followers_count / following_count::DOUBLE > 10 OR followers_count / following_count::DOUBLE < 0.1)
UNION ALL SELECT id, 'profile_completeness', ((coalesce(bio, '') <> '')::INT * 0.25::DOUBLE + (coalesce(location, '') <> '')::INT * 0.25::DOUBLE + (profile_image_url <> '')::INT * 0.25::DOUBLE - 0.5::DOUBLE) * 0.1::DOUBLE FROM acc
UNION ALL SELECT id, 'verification', 0.3::DOUBLE FROM acc WHERE is_verified UNION ALL SELECT id, 'bot_score', bot_score * -0.4::DOUBLE FROM acc
UNION ALL SELECT acc.id, 'spam_activity', n / tweet_count::DOUBLE * -0.5::DOUBLE FROM acc JOIN (SELECT author_id, count(DISTINCT cluster_id) AS n FROM m JOIN s USING (cluster_id) WHERE confidence >= {MARK} GROUP BY author_id) ON author_id = acc.id WHERE tweet_count > 0)"""


def marked(spark, sf_dir):
    """Posts with spam_score, is_coordinated and confidence of their cluster (null without one), by an engine that marks from MARK on."""
    found = members(spark, sf_dir).checkpoint()
    spam = D.scored(D.cluster_stats(found)).where(F.col("confidence") >= MARK).select("cluster_id", "confidence", "is_coordinated")
    each = found.select("id", "cluster_id").join(spam, "cluster_id").withColumn("spam_score", F.col("confidence"))
    return posts(spark, sf_dir).join(each, "id", "left")


def spam_accounts(spark, sf_dir):
    """Accounts with spam_tweet_count: in how many marked clusters they are."""
    counts = marked(spark, sf_dir).where("spam_score IS NOT NULL").select("author_id", "cluster_id").distinct().groupBy(F.col("author_id").alias("id")).agg(F.count("*").alias("spam_tweet_count"))
    return accounts(spark, sf_dir).join(counts, "id", "left").withColumn("spam_tweet_count", F.coalesce("spam_tweet_count", F.lit(0)))


@query("R1_account_factors", f"WITH {_FACTORS} SELECT id, factor, round(impact, 9) + 0.0::DOUBLE AS impact FROM fa")
def account_factors(spark, sf_dir):
    return R.account_factors(spam_accounts(spark, sf_dir))


@query("R3_account_events", f"WITH {_FACTORS} SELECT id, factor, round(impact, 9) AS impact, CASE factor WHEN 'spam_activity' THEN 'spam_detected' WHEN 'bot_score' THEN 'suspicious_pattern' WHEN 'verification' THEN 'verification_passed' ELSE 'automatic_flag' END AS event_type FROM fa WHERE abs(round(impact, 9)) > 0.01")
def account_events(spark, sf_dir):
    return R.events_of(R.account_factors(spam_accounts(spark, sf_dir)), 0.8).select("id", "factor", "impact", "event_type")


_MARKED = f"{_STATS}, mk AS (SELECT p.*, s.confidence, s.confidence AS spam_score, swarm OR few AS co FROM p LEFT JOIN m ON m.id = p.id LEFT JOIN s ON s.cluster_id = m.cluster_id AND s.confidence >= {MARK})"
_CONTENT = f"""{_MARKED},
cf AS (SELECT id, 'spam_detected' AS factor, round(-spam_score, 9) AS impact FROM mk WHERE spam_score IS NOT NULL UNION ALL SELECT id, 'legitimate_content', 0.1::DOUBLE FROM mk WHERE spam_score IS NULL
UNION ALL SELECT id, 'engagement', round(least(1, (retweet_count + like_count + reply_count) / 100.0::DOUBLE) * 0.2::DOUBLE, 9) FROM mk WHERE retweet_count + like_count + reply_count > 0
UNION ALL SELECT id, 'coordinated_behavior', -0.4::DOUBLE FROM mk WHERE co UNION ALL SELECT id, 'high_confidence_spam', round(confidence * -0.3::DOUBLE, 9) FROM mk WHERE confidence > 0.8
UNION ALL SELECT id, 'excessive_urls', -0.1::DOUBLE FROM mk WHERE len(urls) > 3 UNION ALL SELECT id, 'excessive_mentions', -0.1::DOUBLE FROM mk WHERE len(mentions) > 10)"""


@query("R2_content_factors", f"WITH {_CONTENT} SELECT * FROM cf")
def content_factors(spark, sf_dir):
    return R.content_factors(marked(spark, sf_dir))


@query("R3_content_events", f"WITH {_CONTENT} SELECT id, factor, impact, CASE WHEN factor IN ('spam_detected', 'high_confidence_spam') THEN 'spam_detected' WHEN factor IN ('legitimate_content', 'coordinated_behavior') THEN factor ELSE 'automatic_flag' END AS event_type, 0.9::DOUBLE AS confidence FROM cf WHERE abs(impact) > 0.01")
def content_events(spark, sf_dir):
    return R.events_of(R.content_factors(marked(spark, sf_dir)), 0.9).select("id", "factor", "impact", "event_type", "confidence")


_INDIRECT = "ie AS (SELECT author_id AS id, created_at AS ts, CASE WHEN spam_score IS NULL THEN 'legitimate_content' ELSE 'spam_detected' END || '-' || id AS factor, CASE WHEN spam_score IS NULL THEN 0.05::DOUBLE ELSE spam_score * -0.3::DOUBLE END AS impact, 0.7::DOUBLE AS confidence FROM mk)"


@query("R3_indirect_events", f"WITH {_MARKED}, {_INDIRECT} SELECT id, ts, factor, round(impact, 9) AS impact, confidence FROM ie")
def indirect_events(spark, sf_dir):
    return R.indirect_events(marked(spark, sf_dir)).withColumn("impact", F.round("impact", 9))


def fold_sql(source: str) -> str:
    """CTEs that fold the events (id, ts, factor, impact, confidence) of ``source``; fd has each update's score and weight."""
    return f"""od AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, factor, impact, confidence) AS k, count(*) OVER (PARTITION BY id) AS n FROM {source} WHERE ts IS NOT NULL),
wt AS (SELECT x.id, x.k, sum(y.confidence * exp(-(epoch_us(x.ts) - epoch_us(y.ts)) / 3.6e9::DOUBLE / 168)) AS w, sum(y.impact * y.confidence * exp(-(epoch_us(x.ts) - epoch_us(y.ts)) / 3.6e9::DOUBLE / 168)) AS wi
 FROM od x JOIN od y ON y.id IS NOT DISTINCT FROM x.id AND y.k BETWEEN x.k - 99 AND x.k AND epoch_us(x.ts) - epoch_us(y.ts) <= 720 * 3.6e9::DOUBLE GROUP BY ALL),
st AS (SELECT od.id, od.k, od.n, od.ts, w, CASE WHEN w > 0 THEN wi / w ELSE 0 END AS mean FROM od JOIN wt ON wt.id IS NOT DISTINCT FROM od.id AND wt.k = od.k),
fd(id, k, n, ts, w, score) AS (SELECT id, k, n, ts, w, greatest(0, least(1, 0.5::DOUBLE + mean)) FROM st WHERE k = 1
 UNION ALL SELECT st.id, st.k, st.n, st.ts, st.w, greatest(0, least(1, CASE WHEN epoch_us(st.ts) - epoch_us(fd.ts) >= 86400000000 THEN greatest(0, least(1, score * exp(-0.1::DOUBLE * (epoch_us(st.ts) - epoch_us(fd.ts)) / 8.64e10::DOUBLE) + 0.5::DOUBLE * (1 - exp(-0.1::DOUBLE * (epoch_us(st.ts) - epoch_us(fd.ts)) / 8.64e10::DOUBLE)))) ELSE score END + mean))
 FROM fd JOIN st ON st.id IS NOT DISTINCT FROM fd.id AND st.k = fd.k + 1)"""


@query("R4_reputation_fold", f"WITH RECURSIVE ev AS (SELECT user_id AS id, ts, event_type AS factor, CASE WHEN event_type = 'error' THEN -0.05::DOUBLE ELSE 0.01::DOUBLE END AS impact, 0.8::DOUBLE AS confidence FROM events), {fold_sql('ev')} SELECT id, round(score, 6) AS score, round(w, 6) AS effective_weight, n FROM fd WHERE k = n")
def reputation(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("id"), "ts", F.col("event_type").alias("factor"), F.when(F.col("event_type") == "error", -0.05).otherwise(0.01).alias("impact"), F.lit(0.8).alias("confidence"))
    return R.fold(e).withColumns({c: F.round(c, 6) for c in ("score", "effective_weight")})


@query("R9_reputation_pipeline", f"""WITH RECURSIVE {_FACTORS.replace(_STATS, _MARKED)}, {_INDIRECT}, ae AS (SELECT id, (SELECT max(created_at) FROM p) AS ts, factor, round(impact, 9) AS impact, 0.8::DOUBLE AS confidence FROM fa WHERE abs(round(impact, 9)) > 0.01),
ev AS (SELECT * FROM ie UNION ALL SELECT * FROM ae), {fold_sql('ev')}
SELECT id, n, round(score, 6) AS score, round(score, 6) < 0.3 AND n >= 3 AS is_spammy, round(score, 6) > 0.7 AND n >= 3 AS is_trusted FROM fd WHERE k = n""")
def reputation_pipeline(spark, sf_dir):
    """Factors of accounts and posts, their events, the fold, and a verdict on accounts with three events or more."""
    mk = marked(spark, sf_dir)
    last = posts(spark, sf_dir).agg(F.max("created_at").alias("ts"))
    own = R.events_of(R.account_factors(spam_accounts(spark, sf_dir)), 0.8).join(F.broadcast(last), F.lit(True)).select("id", "ts", "factor", "impact", "confidence")  # one row
    folded = R.fold(R.indirect_events(mk).unionByName(own)).withColumn("score", F.round("score", 6))
    return folded.select("id", "n", "score", ((F.col("score") < 0.3) & (F.col("n") >= 3)).alias("is_spammy"), ((F.col("score") > 0.7) & (F.col("n") >= 3)).alias("is_trusted"))


_SCORES = "sc AS (SELECT c_custkey AS id, 0.9::DOUBLE AS score, CASE WHEN c_custkey % 3 = 0 THEN 0.05 ELSE 1.0 END::DOUBLE AS confidence, TIMESTAMP '2024-02-01' - to_hours((c_custkey * 5 % 2400)::INT) AS last_update FROM customer)"
_AGED = "SELECT id, round(CASE WHEN h >= 24 THEN greatest(0, least(1, score * exp(-0.1::DOUBLE * h / 24) + 0.5::DOUBLE * (1 - exp(-0.1::DOUBLE * h / 24)))) ELSE score END, 9) AS score FROM (SELECT *, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_update)) / 3.6e9::DOUBLE AS h FROM sc) WHERE NOT (h > 1440 AND confidence < 0.1)"


def scores_of(spark, sf_dir):
    """Customers as entities whose scores were updated up to a hundred days ago."""
    key = F.col("c_custkey")
    last = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(hours=(key * 5 % 2400).cast("int"))
    return table(spark, sf_dir, "customer").select(key.alias("id"), F.lit(0.9).alias("score"), F.when(key % 3 == 0, 0.05).otherwise(1.0).alias("confidence"), last.alias("last_update"))


@query("R5_maintenance", f"WITH {_SCORES} {_AGED}")
def maintenance(spark, sf_dir):
    """Scores decay from a day on; entities idle for 60 days and hardly sure are dropped."""
    return R.maintained(scores_of(spark, sf_dir), "2024-02-01 00:00:00").select("id", F.round("score", 9).alias("score"))


@query("J11_batch_reputation", f"WITH {_SCORES} SELECT * FROM ({_AGED}) WHERE id % 5 = 0")
def batch_reputation(spark, sf_dir):
    """K6 and J11: a batch of ids, some of them known, the others read from a store that holds odd ids and lost one."""
    graphs.ready(spark)
    every = scores_of(spark, sf_dir)
    store = R.Store(f"{spark.sparkContext.getCheckpointDir()}/reputation-{uuid.uuid4().hex}")
    store.save(every.where("id % 2 = 1 OR id = 0"))
    store.delete(spark.createDataFrame([(0,)], "id bigint"))
    ids = every.where("id % 5 = 0").select("id")
    return R.batch_reputation(every.where("id % 2 = 0"), store, ids, "2024-02-01 00:00:00").select("id", F.round("score", 9).alias("score"))


@query("R5_decay", f"WITH {ACCOUNTS_SQL} SELECT id, round(greatest(0, least(1, bot_score * exp(-0.1::DOUBLE * (account_age_days % 60)) + 0.5::DOUBLE * (1 - exp(-0.1::DOUBLE * (account_age_days % 60))))), 9) AS score FROM acc")
def decay(spark, sf_dir):
    return accounts(spark, sf_dir).select("id", F.round(scores.decayed(F.col("bot_score"), (F.col("account_age_days") % 60).cast("double")), 9).alias("score"))


@query("W3_trend", """WITH b AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), q AS (SELECT user_id, regr_slope(value, -k::DOUBLE) AS slope, stddev_pop(value) AS volatility, count(*) AS n FROM b WHERE k <= 10 GROUP BY user_id HAVING count(*) >= 3)
SELECT user_id, round(slope, 6) AS slope, round(volatility, 6) AS volatility, CASE WHEN volatility > 0.5 THEN 'volatile' WHEN abs(slope) < 0.01 THEN 'stable' WHEN slope > 0 THEN 'improving' ELSE 'deteriorating' END AS trend FROM q""")
def trend(spark, sf_dir):
    return R.trend(table(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id")


@query("A17_reputation_stats", f"WITH {ACCOUNTS_SQL}, e AS (SELECT 'account' AS entity_type, 1 - bot_score AS score, least(1, tweet_count / 10.0::DOUBLE) AS confidence FROM acc UNION ALL SELECT 'content', quality::DOUBLE, 1 FROM labels) SELECT count(*) AS n, count(*) FILTER (entity_type = 'account') AS accounts, count(*) FILTER (entity_type = 'content') AS contents, count(*) FILTER (score < 0.3) AS spammy, count(*) FILTER (score > 0.7) AS trusted, round(avg(score), 9) AS avg_score, round(avg(confidence), 9) AS avg_confidence FROM e")
def reputation_stats(spark, sf_dir):
    a = accounts(spark, sf_dir).select(F.lit("account").alias("entity_type"), (1 - F.col("bot_score")).alias("score"), F.least(F.lit(1.0), F.col("tweet_count") / 10.0).alias("confidence"))
    return R.statistics(a.union(table(spark, sf_dir, "labels").select(F.lit("content"), F.col("quality").cast("double"), F.lit(1.0))))


@query("N1_pii_scrub_counts", r"SELECT doc_id, (len(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')))::INT AS n_mail, md5(regexp_replace(regexp_replace(regexp_replace(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '[EMAIL]', 'g'), '(\+?1[-.\s]?)?(\()?[0-9]{3}(\))?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}', '[PHONE]', 'g'), 'https?://[^\s]+', '[URL]', 'g')) AS masked_md5 FROM documents")
def scrub_counts(spark, sf_dir):
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", N.EMAIL, "[EMAIL]"), N.PHONE, "[PHONE]"), r"https?://[^\s]+", "[URL]")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(N.EMAIL), F.lit(0))).alias("n_mail"), F.md5(masked).alias("masked_md5"))


def scrub_sql(text: str) -> str:
    """A text without personal identifiers, in SQL."""

    def numbered(x: str, pattern: str, prefix: str) -> str:
        return f"array_to_string(list_transform(regexp_split_to_array({x}, '{pattern}'), lambda part, i: CASE WHEN i = 1 THEN part ELSE '{prefix}' || (i - 1) || part END), '')"

    masked = f"regexp_replace(regexp_replace(regexp_replace(coalesce({text}, ''), '{N.EMAIL}', '[EMAIL]', 'g'), '{N.PHONE}', '[PHONE]', 'g'), 'https?://[^\\s]+', '[URL]', 'g')"
    return numbered(numbered(masked, "@[a-zA-Z0-9_]+", "@USER"), "#[a-zA-Z0-9_]+", "#TAG")


def shape_sql(text: str) -> str:
    """A text's words as their shapes, in SQL."""
    return f"array_to_string(list_transform(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN starts_with(w, '[') AND ends_with(w, ']') THEN w WHEN strlen(w) = 1 THEN 'w' ELSE 'W' || repeat('w', strlen(w) - 1) END), ' ')"


@query("N1_pii_scrub", f"SELECT doc_id, {scrub_sql('text')} AS text FROM documents")
def scrub(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.scrub(F.col("text")).alias("text"))


@query("N2_structure", r"SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: CASE WHEN starts_with(w, '[') AND ends_with(w, ']') THEN w WHEN strlen(w) = 1 THEN 'w' ELSE 'W' || repeat('w', strlen(w) - 1) END), ' ') AS shape FROM documents")
def structure(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.structure(F.col("text")).alias("shape"))


@query("N4_hash", "SELECT c_custkey, substr(sha256('salt-1' || c_name), 1, 16) AS digest FROM customer")
def hashed(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", N.digest(F.col("c_name"), "salt-1").alias("digest"))


@query("N5_pseudonym", "SELECT c_custkey, 'USER_' || upper(substr(sha256('salt-1' || c_name), 1, 8)) AS pseudonym FROM customer")
def pseudonyms(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", N.pseudonym(F.col("c_name"), "salt-1", "account_id").alias("pseudonym"))


def _case(kind, value):
    limits, last = scores.TIERS[kind]
    return "CASE " + " ".join(f"WHEN {value} < {x} THEN '{n}'" for x, n in limits) + f" ELSE '{last}' END"


@query("N6_tiers", f"WITH {ACCOUNTS_SQL} SELECT id, {_case('account_age', 'account_age_days')} AS age, {_case('followers', 'followers_count')} AS followers, {_case('bot', 'bot_score')} AS bot, CASE WHEN tweets_per_day = 0 THEN 'inactive' WHEN tweets_per_day < 1 THEN 'low' WHEN tweets_per_day < 10 THEN 'moderate' WHEN tweets_per_day < 50 THEN 'high' ELSE 'extreme' END AS activity FROM acc")
def tiers(spark, sf_dir):
    c = F.col
    return accounts(spark, sf_dir).select("id", scores.tier("account_age", c("account_age_days")).alias("age"), scores.tier("followers", c("followers_count")).alias("followers"), scores.tier("bot", c("bot_score")).alias("bot"), scores.tier("activity", c("tweets_per_day")).alias("activity"))


_REGION = "CASE WHEN contains($, 'new york') OR contains($, 'ny') THEN 'northeast_us' WHEN contains($, 'california') OR contains($, 'ca') THEN 'west_us' WHEN contains($, 'texas') OR contains($, 'tx') THEN 'south_us' WHEN contains($, 'london') OR contains($, 'uk') THEN 'uk' WHEN contains($, 'europe') THEN 'europe' WHEN contains($, 'asia') THEN 'asia' ELSE 'other' END"


@query("N7_location", f"SELECT n_nationkey, {_REGION.replace('$', 'l')} AS region FROM (SELECT n_nationkey, lower(n_name) AS l FROM nation)")
def locations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", N.region(F.col("n_name")).alias("region"))


@query("N8_category", f"WITH {POSTS_SQL} SELECT id, CASE WHEN len(urls) > 0 THEN 'contains_links' WHEN len(mentions) > 3 THEN 'social' WHEN len(hashtags) > 2 THEN 'promotional' WHEN contains(lower(text), 'buy') OR contains(lower(text), 'sell') THEN 'commercial' WHEN contains(lower(text), 'follow') OR contains(lower(text), 'like') THEN 'engagement' ELSE 'general' END AS category FROM p")
def categories(spark, sf_dir):
    return posts(spark, sf_dir).select("id", N.category().alias("category"))


def noise_sql(value: str, key: str, sensitivity: float, epsilon: float, seed: int, mode: str = "laplace") -> str:
    u = f"(('0x' || substr(md5('{seed}|' || {key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE - 0.5)"
    scale = sensitivity / epsilon
    return f"{value} + {u} * 2 * {scale}" if mode == "uniform" else f"{value} - {scale} * sign({u}) * ln(1 - 2 * abs({u}) + 1e-300::DOUBLE)"


@query("N11_noise", f"SELECT c_custkey, round({noise_sql('c_acctbal', 'c_custkey', 1.0, 0.5, 7)}, 6) AS noisy, round({noise_sql('c_acctbal', 'c_custkey', 1.0, 0.5, 7, 'uniform')}, 6) AS shaken FROM customer")
def noisy(spark, sf_dir):
    """Laplace noise and uniform noise, drawn by hashing the key."""
    c, key = F.col("c_acctbal"), F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(N.noise(c, key, 1.0, 0.5, 7), 6).alias("noisy"), F.round(N.noise(c, key, 1.0, 0.5, 7, "uniform"), 6).alias("shaken"))


@query("N12_l_diversity", "SELECT c_custkey FROM customer JOIN (SELECT c_nationkey FROM customer GROUP BY ALL HAVING count(*) >= 5 AND count(DISTINCT c_mktsegment) >= 5) USING (c_nationkey)")
def diverse(spark, sf_dir):
    return N.k_anonymous(table(spark, sf_dir, "customer"), ["c_nationkey"], 5, "c_mktsegment", 5).select("c_custkey")


@query("N12_k_anonymity", "SELECT c_custkey FROM customer JOIN (SELECT c_nationkey, c_mktsegment FROM customer GROUP BY ALL HAVING count(*) >= 10) USING (c_nationkey, c_mktsegment)")
def anonymous(spark, sf_dir):
    return N.k_anonymous(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], 10).select("c_custkey")


_RULES = [("other", "no_such_metric", "lt", 0.0), ("big", "cluster_size", "gte", 3.0), ("sure", "confidence", "gt", 0.2), ("crowd", "unique_accounts", "gt", 2.0), ("one", "unique_accounts", "eq", 1.0), ("slow", "tweets_per_minute", "lt", 0.001)]


@query("M2_cluster_alerts", f"WITH {_STATS} SELECT cluster_id, r AS rule FROM (SELECT cluster_id, unnest([CASE WHEN size >= 3 THEN 'other' END, CASE WHEN size >= 3 THEN 'big' END, CASE WHEN confidence > 0.2 THEN 'sure' END, CASE WHEN unique_accounts > 2 THEN 'crowd' END, CASE WHEN unique_accounts = 1 THEN 'one' END, CASE WHEN tpm < 0.001 THEN 'slow' END]) AS r FROM s) WHERE r IS NOT NULL")
def cluster_alerts(spark, sf_dir):
    rules = spark.createDataFrame(_RULES, "rule string, metric string, operator string, threshold double")
    names = {"cluster_size": "size", "confidence": "confidence", "unique_accounts": "unique_accounts", "tweets_per_minute": "tweets_per_minute"}
    facts = clusters(spark, sf_dir).select("cluster_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in names.items()])).alias("f")).select("cluster_id", "f.metric", "f.value")
    return A.evaluated(facts, rules, "cluster").select("cluster_id", "rule")


@query("M5_throttle", """WITH RECURSIVE e AS (SELECT event_type AS rule, ts, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
f(rule, k, opened) AS (SELECT rule, k, ts FROM e WHERE k = 1 UNION ALL SELECT e.rule, min(e.k), min(e.ts) FROM f JOIN e ON e.rule IS NOT DISTINCT FROM f.rule AND e.ts > f.opened + INTERVAL 1 HOUR GROUP BY e.rule),
w AS (SELECT rule, k, lead(k) OVER (PARTITION BY rule ORDER BY k) AS until FROM f)
SELECT e.rule, id, e.k - w.k < 3 AS passed FROM e JOIN w ON e.rule IS NOT DISTINCT FROM w.rule AND e.k >= w.k AND (until IS NULL OR e.k < until)""")
def throttle(spark, sf_dir):
    alerts = events(spark, sf_dir).select(F.col("event_type").alias("rule"), "ts", F.col("event_id").alias("id"))
    return A.throttled(alerts, 3600, 3).select("rule", "id", "passed")


@query("A18_histogram", "SELECT le::DOUBLE AS le, count(*) FILTER (value <= le) AS n FROM events, (VALUES (1), (5), (10), (50), (100), (500)) AS s(le) GROUP BY le")
def histogram(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "events"), "value", [1, 5, 10, 50, 100, 500])


@query("A19_health", "WITH h AS (SELECT user_id, CASE WHEN avg((event_type = 'error')::INT) > 0.3 THEN 2 WHEN avg((event_type = 'error')::INT) > 0.2 THEN 1 ELSE 0 END AS s FROM events GROUP BY user_id) SELECT CASE max(s) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS status, count(*) FILTER (s = 0) AS healthy, count(*) FILTER (s = 1) AS degraded, count(*) FILTER (s = 2) AS unhealthy FROM h")
def health(spark, sf_dir):
    share = F.avg((F.col("event_type") == "error").cast("int"))
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.when(share > 0.3, 2).when(share > 0.2, 1).otherwise(0).alias("s"))
    worst = F.max("s")
    return per.agg(F.when(worst == 2, "unhealthy").when(worst == 1, "degraded").otherwise("healthy").alias("status"), F.count_if(F.col("s") == 0).alias("healthy"), F.count_if(F.col("s") == 1).alias("degraded"), F.count_if(F.col("s") == 2).alias("unhealthy"))


@query("K4_prometheus", "SELECT 'events_total{type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def exported(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("value"))
    return A.prometheus(counts.select(F.lit("events_total").alias("name"), F.create_map(F.lit("type"), "event_type").alias("labels"), "value"))


@query("K4_histogram_lines", """SELECT '# TYPE event_value histogram' AS line UNION ALL SELECT 'event_value_bucket{le="' || printf('%.2f', le::DOUBLE) || '"} ' || count(*) FILTER (value <= le) FROM events, (VALUES (1), (5), (10), (50), (100), (500)) AS s(le) GROUP BY le
UNION ALL SELECT 'event_value_sum ' || printf('%.2f', round(sum(value), 2)) FROM events UNION ALL SELECT 'event_value_count ' || count(value) FROM events""")
def histogram_lines(spark, sf_dir):
    return A.prometheus_histogram(table(spark, sf_dir, "events"), "event_value", "value", [1, 5, 10, 50, 100, 500])


@query("P12_events_after", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def events_after(spark, sf_dir):
    return table(spark, sf_dir, "events").where("ts > TIMESTAMP_NTZ '2024-01-15 00:00:00'").select("event_id")


@query("F8_template_cut", "SELECT doc_id, CASE WHEN strlen(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END AS short FROM documents")
def cut(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scores.shortened(F.col("text")).alias("short"))


@query("P3_member_posts", f"WITH {_STATS} SELECT id, cluster_id FROM m")
def member_posts(spark, sf_dir):
    return members(spark, sf_dir).select("id", "cluster_id")
