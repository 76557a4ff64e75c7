"""Readers and adapters: the driver's tables as posts, accounts and events; line, JSON and sample sources."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmlens.functions.text import ENTITIES, extracted, has
from swarmlens.functions.scores import account_age, bot_score, shortened

#: The wire format of the posts API.
API_SCHEMA = """data array<struct<id: string, text: string, author_id: string, created_at: string, lang: string,
 public_metrics: struct<retweet_count: int, like_count: int, reply_count: int>, referenced_tweets: array<struct<type: string>>,
 entities: struct<urls: array<struct<expanded_url: string>>, mentions: array<struct<username: string>>, hashtags: array<struct<tag: string>>>>>,
 includes struct<users: array<struct<id: string, username: string, name: string, created_at: string, description: string, location: string, verified: boolean,
 public_metrics: struct<followers_count: int, following_count: int, tweet_count: int>>>>"""


#: The white space that is cut from lines, texts and names.
WHITE = " \t\n\x0b\x0c\r"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with zoned timestamps."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: author and time from the event of the same number."""
    docs, e = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/events.parquet")
    joined = docs.join(e, docs["doc_id"] == e["event_id"])
    return joined.select(
        F.col("doc_id").alias("id"), "text", F.col("user_id").alias("author_id"), F.col("ts").alias("created_at"), F.floor("value").cast("int").alias("retweet_count"), (F.col("user_id") % 50).cast("int").alias("like_count"), (F.col("doc_id") % 7).cast("int").alias("reply_count"),
        *[extracted(F.col("text"), k).alias(k) for k in ("urls", "mentions", "hashtags")],
    )


def text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts with the digest of their text (null without one) and what clusters are summed up by in its stead: no text meets the events, as a join would shuffle and sort it."""
    docs, e = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.col("text")
    facts = docs.select(F.col("doc_id").alias("id"), F.md5(text).alias("key"), F.octet_length(text).alias("_bytes"), shortened(text).alias("_short"), *[has(text, k).cast("int").alias(f"_has_{k}") for k in ENTITIES])
    return facts.join(e.select(F.col("event_id").alias("id"), F.col("user_id").alias("author_id"), F.col("ts").alias("created_at")), "id")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accounts, with bot_score and is_suspicious."""
    c, n = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    activity = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n_events"))
    key = F.col("c_custkey")
    base = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(activity, "c_custkey", "left").select(
        key.alias("id"), F.when(key % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lit("u"), key.cast("string"))).alias("username"), (key * 37 % 1200).cast("int").alias("account_age_days"),
        F.floor(F.greatest("c_acctbal", F.lit(0.0))).cast("int").alias("followers_count"), (key * 13 % 1000).cast("int").alias("following_count"), F.coalesce("n_events", F.lit(0)).cast("int").alias("tweet_count"),
        F.when(F.col("c_mktsegment") == "FURNITURE", "").otherwise(F.col("c_mktsegment")).alias("bio"), F.when(key % 4 == 0, "").otherwise(F.col("n_name")).alias("location"), F.lit("").alias("website"), F.when(key % 5 == 0, "").otherwise("x").alias("profile_image_url"), (key % 11 == 0).alias("is_verified"),
    )
    base = base.withColumn("tweets_per_day", F.coalesce(F.try_divide(F.col("tweet_count").cast("double"), F.col("account_age_days").cast("double")), F.lit(0.0)))
    return base.withColumn("bot_score", bot_score()).withColumn("is_suspicious", F.col("bot_score") > 0.5)


#: The same accounts in SQL (money-like constants as DOUBLE).
ACCOUNTS_SQL = """acc0 AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'u' || c_custkey END AS username, (c_custkey * 37 % 1200)::INT AS account_age_days,
 floor(greatest(c_acctbal, 0))::INT AS followers_count, (c_custkey * 13 % 1000)::INT AS following_count, coalesce(n_events, 0)::INT AS tweet_count,
 CASE WHEN c_mktsegment = 'FURNITURE' THEN '' ELSE c_mktsegment END AS bio, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE n_name END AS location, '' AS website, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'x' END AS profile_image_url, c_custkey % 11 = 0 AS is_verified
 FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT user_id, count(*) AS n_events FROM events GROUP BY user_id) ON user_id = c_custkey),
acc1 AS (SELECT *, coalesce(tweet_count::DOUBLE / nullif(account_age_days, 0), 0) AS tweets_per_day FROM acc0),
acc AS (SELECT *, round((CASE WHEN account_age_days < 30 THEN 0.3 WHEN account_age_days < 90 THEN 0.1 ELSE 0 END)::DOUBLE
 + (CASE WHEN following_count = 0 THEN 0 WHEN followers_count::DOUBLE / following_count < 0.1 THEN 0.2 WHEN followers_count::DOUBLE / following_count > 10 THEN 0.1 ELSE 0 END)::DOUBLE
 + (CASE WHEN tweets_per_day > 50 THEN 0.3 WHEN tweets_per_day > 20 THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN coalesce(bio, '') = '' THEN 0.1 ELSE 0 END)::DOUBLE
 + (CASE WHEN coalesce(location, '') = '' THEN 0.05 ELSE 0 END)::DOUBLE + (CASE WHEN coalesce(profile_image_url, '') = '' THEN 0.1 ELSE 0 END)::DOUBLE
 + (CASE WHEN strlen(username) > 15 AND regexp_matches(username, '[0-9]') THEN 0.15 ELSE 0 END)::DOUBLE, 9) AS bot_score FROM acc1)"""
POSTS_SQL = """p AS (SELECT doc_id AS id, text, user_id AS author_id, ts AS created_at, floor(value)::INT AS retweet_count, (user_id % 50)::INT AS like_count, (doc_id % 7)::INT AS reply_count,
 regexp_extract_all(coalesce(text, ''), 'https?://\\S+') AS urls, regexp_extract_all(coalesce(text, ''), '@[A-Za-z0-9_]+') AS mentions, regexp_extract_all(coalesce(text, ''), '#[A-Za-z0-9_]+') AS hashtags FROM documents JOIN events ON event_id = doc_id)"""


def lines(df: DataFrame, text: str = "value") -> DataFrame:
    """(line, username, text): each non-blank line, trimmed, of a text column; lines are numbered from 1, blank ones too."""
    cut = df.select(F.posexplode(F.split(text, "\n")).alias("at", "raw"))
    return cut.select((F.col("at") + 1).alias("line"), F.concat(F.lit("user_"), (F.col("at") + 1).cast("string")).alias("username"), F.btrim("raw", F.lit(WHITE)).alias("text")).where("text <> ''")


def _wire_posts(df: DataFrame, value: str = "value") -> DataFrame:
    """Posts of newline-delimited API messages with their language and what they refer to.

    An author that a message lists twice is who it lists last; a post without a listed author is left out.
    """
    parsed = df.where(F.btrim(value, F.lit(WHITE)) != "").select(F.from_json(value, API_SCHEMA, {"mode": "PERMISSIVE"}).alias("m")).where("m.data IS NOT NULL")
    each = parsed.select(F.explode("m.data").alias("d"), F.col("m.includes.users").alias("users"))
    each = each.select("d", F.try_element_at(F.filter("users", lambda u: u["id"] == F.col("d.author_id")), F.lit(-1)).alias("u")).where("u IS NOT NULL")
    names = lambda c, f: F.coalesce(F.transform(c, lambda x: x[f]), F.array().cast("array<string>"))
    refers = lambda kind: F.coalesce(F.exists("d.referenced_tweets", lambda r: r["type"] == kind), F.lit(False))
    return each.select(
        F.col("d.id").alias("id"), F.col("d.text").alias("text"), F.col("d.author_id").alias("author_id"), F.col("u.username").alias("username"), F.try_to_timestamp("d.created_at").alias("created_at"), F.col("d.public_metrics.retweet_count").alias("retweet_count"),
        names("d.entities.urls", "expanded_url").alias("urls"), names("d.entities.mentions", "username").alias("mentions"), names("d.entities.hashtags", "tag").alias("hashtags"),
        F.col("d.lang").alias("lang"), refers("retweeted").alias("is_retweet"), refers("replied_to").alias("is_reply"),
    )


def parse_stream(df: DataFrame, value: str = "value") -> DataFrame:
    """Posts of newline-delimited API messages; blank lines (heartbeats) and malformed ones are skipped.  Works on streams too."""
    return _wire_posts(df, value).drop("lang", "is_retweet", "is_reply")


def search_query(keywords=(), hashtags=(), languages=()) -> str:
    """The search string of a watch list: alternatives joined by OR, several words quoted, languages required, reposts and replies left out."""
    terms = [f'"{k}"' if " " in k else k for k in keywords] + [f"#{h}" for h in hashtags]
    out = " OR ".join(terms)
    if languages:
        out = f"({out}) ({' OR '.join(f'lang:{x}' for x in languages)})"
    return f"{out} -is:retweet -is:reply".strip()


def upserted(rows: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """The last row of each key by time, then ``order``: a map-side maximum of whole rows."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(whole, F.struct(ts, order)).alias("r")).select("r.*")


def account_rows(users: DataFrame, as_of: str) -> DataFrame:
    """Accounts of wire users: age in days, posts a day and follower ratio; an unreadable time gives no age and no rate."""
    age = account_age(F.col("created_at"), as_of)
    per_day = F.when(age > 0, F.col("public_metrics.tweet_count") / age).otherwise(0.0)
    ratio = F.when(F.col("public_metrics.following_count") > 0, F.col("public_metrics.followers_count") / F.col("public_metrics.following_count")).otherwise(0.0)
    return users.select("id", "username", F.coalesce(age, F.lit(0)).alias("account_age_days"), F.coalesce(per_day, F.lit(0.0)).alias("tweets_per_day"), ratio.cast("double").alias("follower_ratio"))


def holds(query: str) -> Column:
    """Whether a post (text, hashtags, username, lang, is_retweet, is_reply) answers a search string, as ``search_query`` and ``stream_rules`` write them.

    Alternatives stand between ORs, and all that stands side by side has to hold; an OR
    binds its neighbours before that, so what is required or left out counts for every
    alternative.  Brackets only group.  A word is met in any case and at word ends only,
    as are quoted words; ``#tag``, ``from:user``, ``lang:code``, ``is:retweet`` and
    ``is:reply`` read the post's fields, and a minus turns a term round.  Without terms every post answers.
    """

    def term(t: str) -> Column:
        if t.startswith("-") and len(t) > 1:
            return ~term(t[1:])
        kind, _, rest = t.partition(":")
        if t.startswith("#"):
            return F.exists("hashtags", lambda h: F.lower(h) == t[1:].lower())
        if kind in ("from", "lang") and rest:
            return F.lower("username" if kind == "from" else "lang") == rest.lower()
        if t in ("is:retweet", "is:reply"):
            return F.col(t.replace(":", "_"))
        return F.col("text").rlike(rf"(?iu)(?<![\p{{L}}\p{{Nd}}]){re.escape(t.strip(chr(34)))}(?![\p{{L}}\p{{Nd}}])")

    groups, joined = [], False
    for t in re.findall(r'-?"[^"]*"|[^\s()]+', query):
        if t == "OR":
            joined = True
            continue
        found = F.coalesce(term(t), F.lit(False))
        groups = [*groups[:-1], groups[-1] | found] if joined and groups else [*groups, found]
        joined = False
    return reduce(lambda a, b: a & b, groups, F.lit(True))


def search(spark: SparkSession, folder: str, query: str, max_results: int | None = None) -> DataFrame:
    """Posts of paged search answers (a JSON document a file or line) that answer ``query``; every page is read, and the limit is pushed down.

    A page with errors and no data fails the scan.
    """
    pages = spark.read.schema(f"{API_SCHEMA}, errors array<struct<title: string, detail: string>>").json(folder)
    wrong = F.raise_error(F.concat(F.lit("the search answered with an error: "), F.to_json("errors")))
    good = pages.withColumn("data", F.when(F.col("data").isNull() & (F.size("errors") > 0), wrong.cast(pages.schema["data"].dataType)).otherwise(F.col("data")))
    found = _wire_posts(good.select(F.to_json(F.struct("data", "includes")).alias("value"))).where(holds(query)).drop("lang", "is_retweet", "is_reply")
    return found if max_results is None else found.limit(max_results)


class Rules:
    """The rules of a stream (value, tag): replaced as a whole, added, listed and deleted by id; more of them than a stream takes are an error."""

    MOST = 1000

    def __init__(self):
        self.rows: dict[str, tuple[str, str]] = {}

    def replace(self, rules: DataFrame) -> None:
        self.rows = {}
        self.add(rules)

    def add(self, rules: DataFrame) -> None:
        found = rules.distinct().limit(self.MOST + 1).collect()
        if len(found) > self.MOST:
            raise ValueError(f"a stream takes {self.MOST} rules at most")
        for r in found:
            self.rows[hashlib.sha256(f"{r['value']}|{r['tag']}".encode()).hexdigest()[:16]] = (r["value"], r["tag"])

    def get(self) -> list[tuple[str, str, str]]:
        return [(i, value, tag) for i, (value, tag) in self.rows.items()]

    def delete(self, ids: list[str]) -> int:
        """How many of the ids there were."""
        return sum(self.rows.pop(i, None) is not None for i in ids)


def stream_rules(spark: SparkSession, keywords=(), hashtags=(), users=(), languages=()) -> DataFrame:
    """(value, tag): a rule for each keyword, hashtag and user."""
    suffix = f" ({' OR '.join(f'lang:{x}' for x in languages)})" if languages else ""
    quoted = lambda k: f'"{k}"' if " " in k else k
    rows = [(quoted(k) + suffix, f"keyword:{k}") for k in keywords] + [(f"#{h}{suffix}", f"hashtag:{h}") for h in hashtags] + [(f"from:{u}", f"user:{u}") for u in users]
    return spark.createDataFrame(rows, "value string, tag string")
