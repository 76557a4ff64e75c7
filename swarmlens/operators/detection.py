"""Filters on posts, cluster aggregates, confidence, coordination, marking and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarmlens.functions.scores import shortened
from swarmlens.operators.graphs import shuffled

#: Fixed phrases of obvious spam.
OBVIOUS = ["follow for follow", "f4f", "followback", "crypto deal", "make money", "click here", "limited time", "urgent", "verify account", "account suspension"]


def obvious_spam(bot_score: Column | None = None) -> Column:
    """A fixed phrase, over five hashtags, over three mentions, or an author over .7."""
    low = F.lower(F.coalesce("text", F.lit("")))
    signs = [low.contains(p) for p in OBVIOUS] + [F.size("hashtags") > 5, F.size("mentions") > 3]
    if bot_score is not None:
        signs.append(F.coalesce(bot_score, F.lit(0.0)) > 0.7)
    return reduce(lambda x, y: x | y, signs)


def watched(keywords=(), hashtags=(), users: Column | None = None) -> Column:
    """A keyword inside the text, a hashtag or an author of the watch list, whatever the case."""
    low = F.lower(F.coalesce("text", F.lit("")))
    signs = [low.contains(k.lower()) for k in keywords]
    if hashtags:
        signs.append(F.exists("hashtags", lambda h: F.lower(F.ltrim(h, F.lit("#"))).isin([x.lower() for x in hashtags])))
    if users is not None:
        signs.append(users)
    return reduce(lambda x, y: x | y, signs) if signs else F.lit(False)


def watched_by(posts: DataFrame, users: DataFrame, keywords=(), hashtags=()) -> DataFrame:
    """Posts (with username) that ``watched`` keeps or whose author is in a table of usernames, which may be long: one equi-join on the lowered name."""
    (name,) = users.columns
    listed = users.select(F.lower(name).alias("_listed")).where("_listed IS NOT NULL").distinct()
    return posts.join(listed, F.lower("username") == F.col("_listed"), "left").where(watched(keywords, hashtags) | F.col("_listed").isNotNull()).drop("_listed")


def included(posts: DataFrame, as_of: str, min_retweets: int = 0, max_age_hours: int = 0, keywords=(), hashtags=()) -> DataFrame:
    """Posts that are shared enough, young enough, and obvious spam or watched; their authors' bot_score counts where the column is there."""
    author = F.col("bot_score") if "bot_score" in posts.columns else None
    keep = (F.col("retweet_count") >= min_retweets) & (obvious_spam(author) | watched(keywords, hashtags))
    if max_age_hours:
        keep &= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(max_age_hours)) <= F.col("created_at")
    return posts.where(keep)


def cluster_stats(members: DataFrame) -> DataFrame:
    """Per cluster_id of (cluster_id, id, text, author_id, created_at, urls, mentions, hashtags, bot_score): all aggregates in one shuffle.

    Members may have ``adapters.text_facts`` in place of the last but author, time and score.
    Accounts are told apart before the averages, so an author's score counts once.
    """
    if "text" in members.columns:
        members = members.withColumns({"_bytes": F.octet_length("text"), "_short": shortened(F.col("text")), **{f"_has_{k}": (F.size(k) > 0).cast("int") for k in ("urls", "mentions", "hashtags")}})
    by = members.groupBy("cluster_id").agg(
        F.count("*").alias("size"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), (F.sum("_bytes") / F.count("*")).alias("_length"), F.min(F.struct("_bytes", "id", "_short")).getField("_short").alias("template"),
        *[F.avg(f"_has_{k}").alias(f"_{k}") for k in ("urls", "mentions", "hashtags")],
    )
    authors = members.groupBy("cluster_id", "author_id").agg(F.max("bot_score").alias("bot_score")).groupBy("cluster_id").agg(F.count("author_id").alias("unique_accounts"), F.avg("bot_score").alias("avg_bot_score"))
    out = by.join(authors, "cluster_id").withColumn("duration_s", F.unix_micros(F.col("last_seen").cast("timestamp")) / 1e6 - F.unix_micros(F.col("first_seen").cast("timestamp")) / 1e6)
    out = out.withColumn("tweets_per_minute", F.when(F.col("duration_s") > 0, F.col("size") / (F.col("duration_s") / 60)).otherwise(F.lit(0.0)))
    return out


def scored(clusters: DataFrame) -> DataFrame:
    """Confidence, coordination, suspicion level and pattern."""
    size, unique, tpm = F.col("size"), F.col("unique_accounts"), F.col("tweets_per_minute")
    quick = F.when((F.col("duration_s") < 3600) & (size > 5), 0.3).when((F.col("duration_s") < 3600) & (size > 3), 0.2).otherwise(0.0)
    confidence = 0.3 * F.least(F.lit(1.0), size / 100.0) + quick + 0.2 * (1 - unique / size) + 0.2 * F.coalesce("avg_bot_score", F.lit(0.0))
    swarm, few = (size >= 5) & (unique >= 3) & (tpm > 2), (size >= 10) & (unique <= 3)
    level = F.when(F.col("confidence") >= 0.8, "critical").when(F.col("confidence") >= 0.6, "high").when(F.col("confidence") >= 0.4, "medium").otherwise("low")
    notes = [F.when(F.col(f"_{k}") > 0.5, F.lit(f", contains {n}")).otherwise("") for k, n in (("urls", "URLs"), ("mentions", "mentions"), ("hashtags", "hashtags"))]
    out = clusters.withColumn("confidence", F.round(confidence, 9)).withColumn("is_coordinated", swarm | few)
    out = out.withColumn("suspicion_level", F.when(swarm, "high").when(few, "critical").otherwise(level))
    out = out.withColumn("pattern", F.concat(F.lit("Text similarity cluster (avg length: "), F.floor("_length").cast("string"), F.lit(" chars)"), *notes))
    return out.drop("_length", "_urls", "_mentions", "_hashtags")


def hybrid_union(minhash: DataFrame, simhash: DataFrame) -> DataFrame:
    """(algorithm, cluster_id, id): MinHash clusters, and the SimHash clusters of which less than half is in those."""
    taken = minhash.select("id").distinct().withColumn("taken", F.lit(1))
    share = simhash.join(shuffled(taken), "id", "left").groupBy("cluster_id").agg((F.sum(F.coalesce("taken", F.lit(0))) / F.count("*")).alias("share")).where("share < 0.5")
    new = simhash.join(shuffled(share.select("cluster_id")), "cluster_id", "left_semi")
    return minhash.select(F.lit("minhash").alias("algorithm"), "cluster_id", "id").union(new.select(F.lit("simhash"), "cluster_id", "id"))


def hourly_quota(df: DataFrame, ts: str, key: str, most: int) -> DataFrame:
    """The first ``most`` rows of each hour.  Rows are ranked by minute first, so an hour's rows never meet in one task before most of them are ruled out."""
    minute = Window.partitionBy(F.date_trunc("minute", ts)).orderBy(ts, key)
    some = df.withColumn("_m", F.row_number().over(minute)).where(F.col("_m") <= most).drop("_m")
    hour = Window.partitionBy(F.date_trunc("hour", ts)).orderBy(ts, key)
    return some.withColumn("nth", F.row_number().over(hour)).where(F.col("nth") <= most)
