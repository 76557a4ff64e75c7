"""Queries of ramps and flash mobs, mergeable summaries, the audit trail, and plugins as table functions."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from swarmlens.operators import audit, graphs, summaries
from swarmlens.operators import temporal as T
from swarmlens.operators.privacy import hmac, pseudonym
from swarmlens.operators.similarity import algorithm_statistics
from swarmlens.plans.detection_queries import members
from swarmlens.plans.detection_queries import _MEMBERS
from swarmlens.plans.plugins import table_function
from swarmlens.plans.register import query, table
from swarmlens.sources.adapters import ACCOUNTS_SQL, POSTS_SQL, accounts, events, posts

_HOURLY = """hc AS (SELECT {key} AS key, epoch_us(ts) // 3600000000 AS hour, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL),
hg AS (SELECT key, unnest(range(min(hour), max(hour) + 1)) AS hour FROM hc GROUP BY key),
hh AS (SELECT hg.key, hg.hour, coalesce(n, 0) AS n FROM hg LEFT JOIN hc ON hg.key IS NOT DISTINCT FROM hc.key AND hg.hour = hc.hour),
hs AS (SELECT key, avg(n) AS mean, stddev_pop(n) AS sigma FROM hh GROUP BY key)"""


@query("T9_gradual_ramp", f"""WITH RECURSIVE {_HOURLY.replace('{key}', 'user_id % 20')},
d AS (SELECT hh.key, hour, sign, sigma, sign * (n - mean) - 0.5::DOUBLE * sigma AS d, row_number() OVER (PARTITION BY hh.key, sign ORDER BY hour) AS k FROM hh JOIN hs ON hh.key IS NOT DISTINCT FROM hs.key, (VALUES (1), (-1)) AS w(sign) WHERE sigma > 0),
c(key, sign, sigma, hour, k, s, start) AS (SELECT key, sign, sigma, hour, k, greatest(0, d), CASE WHEN d > 0 THEN hour ELSE hour + 1 END FROM d WHERE k = 1
 UNION ALL SELECT d.key, d.sign, d.sigma, d.hour, d.k, greatest(0, c.s + d.d), CASE WHEN c.s + d.d > 0 THEN c.start ELSE d.hour + 1 END FROM c JOIN d ON d.key IS NOT DISTINCT FROM c.key AND d.sign = c.sign AND d.k = c.k + 1)
SELECT key AS account_group, CASE WHEN sign > 0 THEN 'up' ELSE 'down' END AS direction, arg_min(start, hour) FILTER (s > 5 * sigma) AS start_hour, min(hour) FILTER (s > 5 * sigma) AS alarm_hour, round(max(s / sigma), 6) AS peak FROM c GROUP BY key, sign HAVING max(s / sigma) > 5""")
def gradual_ramp(spark, sf_dir):
    """Groups of accounts whose hourly activity rises or falls gradually, by cumulative sums with a reset."""
    e = events(spark, sf_dir).withColumn("account_group", F.col("user_id") % 20)
    return T.ramps(e, "account_group", "ts").withColumn("peak", F.round("peak", 6))


@query("T9_flash_mob", f"""WITH {_HOURLY.replace('{key}', 'event_type')}, ht AS (SELECT hh.key, hour, n, hour - row_number() OVER (PARTITION BY hh.key ORDER BY hour) AS island FROM hh JOIN hs ON hh.key IS NOT DISTINCT FROM hs.key WHERE n > mean + 2 * sigma),
bu AS (SELECT key, island, min(hour) AS start_hour, max(hour) AS end_hour, sum(n)::BIGINT AS n_events FROM ht GROUP BY ALL), fs AS (SELECT user_id, min(epoch_us(ts)) // 3600000000 AS first FROM events WHERE user_id IS NOT NULL GROUP BY user_id),
cr AS (SELECT bu.key, bu.island, count(DISTINCT e.user_id) AS accounts, count(DISTINCT e.user_id) FILTER (first >= start_hour) AS new_accounts FROM bu JOIN (SELECT event_type, user_id, epoch_us(ts) // 3600000000 AS hour FROM events WHERE ts IS NOT NULL) e ON e.event_type IS NOT DISTINCT FROM bu.key AND e.hour BETWEEN start_hour AND end_hour JOIN fs USING (user_id) GROUP BY ALL)
SELECT bu.key AS event_type, start_hour, end_hour, n_events, coalesce(accounts, 0) AS accounts, coalesce(new_accounts, 0) AS new_accounts, coalesce(accounts >= 5 AND accounts = new_accounts, false) AS is_flash_mob FROM bu LEFT JOIN cr ON bu.key IS NOT DISTINCT FROM cr.key AND bu.island = cr.island""")
def flash_mob(spark, sf_dir):
    """Bursts of each type, and whether all their accounts are new."""
    return T.flash_mobs(events(spark, sf_dir), "event_type", "ts", "user_id")


@query("M10_daily_quantiles", f"SELECT strftime(ts, '%Y-%m-%d') AS day, quantile, count(value) AS n, true AS within FROM events, (VALUES (0.5::DOUBLE), (0.9), (0.99)) AS q(quantile) GROUP BY ALL HAVING count(value) > 0")
def daily_quantiles(spark, sf_dir):
    """Quantiles of a day's values out of its hours' sketches, and whether their ranks are within the sketch's bound."""
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    hours = summaries.sketched(e, [F.col("hour")], "value").withColumn("day", F.substring("hour", 1, 10))
    found = summaries.quantiles(summaries.merged(hours, [F.col("day")]), [0.5, 0.9, 0.99])
    met = e.withColumnRenamed("value", "own").join(found, "day").groupBy("day", "quantile", "n").agg(F.count_if(F.col("own") < F.col("value")).alias("below"), F.count_if(F.col("own") <= F.col("value")).alias("upto"))
    room = F.lit(summaries.RANK_ERROR) * F.col("n") + 1
    return met.select("day", F.col("quantile").cast("double").alias("quantile"), "n", ((F.col("below") <= F.col("quantile") * F.col("n") + room) & (F.col("upto") >= F.col("quantile") * F.col("n") - room)).alias("within"))


@query("M10_observed_write", "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, max(event_id) AS last, (SELECT count(*) FROM events) AS rows_written FROM events")
def observed_write(spark, sf_dir):
    """Counts taken while events are written, beside those of what was written."""
    graphs.ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/observed-{uuid.uuid4().hex}"
    got = summaries.observed(table(spark, sf_dir, "events"), folder, n=F.count(F.lit(1)), errors=F.count_if(F.col("event_type") == "error"), last=F.max("event_id"))
    return spark.read.parquet(folder).agg(F.count("*").alias("rows_written")).select(F.lit(got["n"]).cast("bigint").alias("n"), F.lit(got["errors"]).cast("bigint").alias("errors"), F.lit(got["last"]).cast("bigint").alias("last"), "rows_written")


_SAID = "concat_ws('|', batch, strlen(subject) || ':' || subject, '9:author_id', '9:pseudonym', '7:analyst', '19:2024-02-01 00:00:00')"


@query("N14_audit_trail", f"""WITH {POSTS_SQL}, e AS (SELECT DISTINCT author_id FROM p WHERE author_id IS NOT NULL), r AS (SELECT author_id % 2 AS batch, 'USER_' || upper(substr(substr(sha256('audit' || author_id), 1, 16), 1, 8)) AS subject FROM e)
SELECT batch::INT AS batch, subject, sha256({_SAID}) AS hash, 0 AS faults FROM r""")
def audit_trail(spark, sf_dir):
    """What was done to the authors of posts, in two batches of a trail, with each row's hash and the number of faults that its check finds."""
    graphs.ready(spark)
    trail = audit.AuditTrail(spark, f"{spark.sparkContext.getCheckpointDir()}/audit-{uuid.uuid4().hex}")
    authors = posts(spark, sf_dir).where("author_id IS NOT NULL").select("author_id").distinct()
    for n in range(2):
        some = authors.where(F.col("author_id") % 2 == n)
        trail.append(some.select(pseudonym(F.col("author_id").cast("string"), "audit", "author_id").alias("subject"), F.lit("author_id").alias("field"), F.lit("pseudonym").alias("method")), "analyst", "2024-02-01 00:00:00")
    return trail.rows().select("batch", "subject", "hash", F.lit(len(trail.faults())).alias("faults"))


def _added(state, batch):
    """Posts, likes and the largest number of reposts of an author, so far."""
    n, likes, most, key = state or (0, 0, 0, None)
    columns = {name: batch.column(name) for name in ("author_id", "like_count", "retweet_count")}
    return n + batch.num_rows, likes + (pc.sum(columns["like_count"]).as_py() or 0), max(most, pc.max(columns["retweet_count"]).as_py() or 0), columns["author_id"][0].as_py()


def _told(state):
    n, likes, most, key = state or (0, 0, 0, None)
    rows = [[key], [n], [likes], [most]] if n else [[], [], [], []]
    return pa.table([pa.array(c, pa.int64()) for c in rows], names=["author_id", "posts", "likes", "most_retweets"])


@query("X1_table_plugin", f"WITH {POSTS_SQL} SELECT author_id, count(*) AS posts, sum(like_count)::BIGINT AS likes, greatest(0, max(retweet_count))::BIGINT AS most_retweets FROM p GROUP BY author_id")
def table_plugin(spark, sf_dir):
    """A detector as a table function: SQL hands it the posts, parted by author."""
    table_function(spark, "activity", lambda: None, _added, _told, "author_id bigint, posts bigint, likes bigint, most_retweets bigint")
    view = f"posts_{uuid.uuid4().hex}"
    posts(spark, sf_dir).select("author_id", "like_count", "retweet_count").createOrReplaceTempView(view)
    return spark.sql(f"SELECT * FROM activity(TABLE({view}) PARTITION BY author_id)")


def _spanned(state, batch):
    n, first, last, key = state or (0, None, None, None)
    times = pc.min_max(batch.column("us")).as_py()
    low = min(x for x in (first, times["min"]) if x is not None)
    return n + batch.num_rows, low, max(x for x in (last, times["max"]) if x is not None), batch.column("cluster_id")[0].as_py()


def _span(state):
    n, first, last, key = state or (0, None, None, None)
    rows = [[key], [n], [(last - first) / 1e6]] if n else [[], [], []]
    return pa.table([pa.array(c, kind) for c, kind in zip(rows, (pa.int64(), pa.int64(), pa.float64()))], names=["cluster_id", "size", "span_s"])


@query("X1_cluster_plugin", f"WITH {_MEMBERS} SELECT cluster_id, count(*) AS size, (max(epoch_us(created_at)) - min(epoch_us(created_at))) / 1e6::DOUBLE AS span_s FROM m WHERE created_at IS NOT NULL GROUP BY cluster_id")
def cluster_plugin(spark, sf_dir):
    """A cluster analysis as a table function, parted by cluster: sizes and spans of time."""
    table_function(spark, "cluster_span", lambda: None, _spanned, _span, "cluster_id bigint, size bigint, span_s double")
    view = f"members_{uuid.uuid4().hex}"
    members(spark, sf_dir).where("created_at IS NOT NULL").select("cluster_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("us")).createOrReplaceTempView(view)
    return spark.sql(f"SELECT * FROM cluster_span(TABLE({view}) PARTITION BY cluster_id)")


_PADS = [bytes(b ^ pad for b in b"a key for every field".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query("F7_hmac", f"SELECT c_custkey, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(c_name)))) AS mac FROM customer")
def keyed_digests(spark, sf_dir):
    """HMAC-SHA256 of every customer's name."""
    return table(spark, sf_dir, "customer").select("c_custkey", hmac(F.col("c_name"), b"a key for every field").alias("mac"))


@query("L29_algorithm_stats", """WITH RECURSIVE r AS (SELECT event_type AS algorithm, floor(value)::DOUBLE AS response, (event_id % 5 = 0)::INT AS tp, (event_id % 5 = 1)::INT AS fp, (event_id % 5 > 1)::INT AS tn, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
f(algorithm, k, m) AS (SELECT algorithm, k, response FROM r WHERE k = 1 UNION ALL SELECT r.algorithm, r.k, CASE WHEN f.m = 0 THEN r.response ELSE (f.m + r.response) / 2 END FROM f JOIN r ON r.algorithm = f.algorithm AND r.k = f.k + 1),
l AS (SELECT algorithm, arg_max(m, k) AS m FROM f GROUP BY algorithm)
SELECT algorithm, count(*) AS queries, round(any_value(m), 6) AS avg_response, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn, 0::BIGINT AS fn, round(sum(tp + tn) / sum(tp + fp + tn)::DOUBLE, 9) AS accuracy FROM r JOIN l USING (algorithm) GROUP BY algorithm""")
def algorithm_stats(spark, sf_dir):
    """Events as runs of five algorithms: smoothed response times, and judged counts that add up."""
    e, n = events(spark, sf_dir), F.col("event_id") % 5
    runs = e.select(F.col("event_type").alias("algorithm"), "ts", F.col("event_id").alias("id"), F.floor("value").cast("double").alias("response"), (n == 0).cast("int").alias("tp"), (n == 1).cast("int").alias("fp"), (n > 1).cast("int").alias("tn"), F.lit(0).alias("fn"))
    return algorithm_statistics(runs).withColumns({c: F.round(c, d) for c, d in (("avg_response", 6), ("accuracy", 9))})


@query("K2_read_posts", f"WITH {POSTS_SQL} SELECT id, author_id, created_at FROM p ORDER BY created_at DESC, id LIMIT 100")
def read_posts(spark, sf_dir):
    """The newest hundred posts, as a reader asks for them; the limit is the feature."""
    return posts(spark, sf_dir).select("id", "author_id", "created_at").orderBy(F.desc("created_at"), "id").limit(100)


@query("K2_read_accounts", f"WITH {ACCOUNTS_SQL} SELECT id, username, bot_score FROM acc WHERE bot_score > 0.5 ORDER BY bot_score DESC, id LIMIT 100")
def read_accounts(spark, sf_dir):
    """The hundred most suspicious accounts, as a reader asks for them; the limit is the feature."""
    return accounts(spark, sf_dir).where("bot_score > 0.5").select("id", "username", "bot_score").orderBy(F.desc("bot_score"), "id").limit(100)
