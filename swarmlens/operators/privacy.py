"""Anonymisation: scrubbing, structure, keyed digests, generalisation, noise, k-anonymity."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmlens.functions.scores import tier

#: Fixed patterns.
EMAIL, PHONE = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"(\+?1[-.\s]?)?(\()?[0-9]{3}(\))?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"


def _numbered(text: Column, pattern: str, prefix: str) -> Column:
    """Every match replaced by the prefix and its number, by cutting at the matches."""
    parts = F.split(text, pattern, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(prefix), i.cast("string"), p))), "")


def scrub(text: Column) -> Column:
    """Mail addresses, phone numbers, links, then mentions and hashtags by number."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), EMAIL, "[EMAIL]")
    out = F.regexp_replace(out, PHONE, "[PHONE]")
    out = F.regexp_replace(out, r"https?://[^\s]+", "[URL]")
    return _numbered(_numbered(out, "@[a-zA-Z0-9_]+", "@USER"), "#[a-zA-Z0-9_]+", "#TAG")


def structure(text: Column) -> Column:
    """Words as W, w... of their byte length; bracketed marks stay."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = lambda w: F.octet_length(w)
    shape = lambda w: F.when(w.startswith("[") & w.endswith("]"), w).when(n(w) == 1, "w").otherwise(F.concat(F.lit("W"), F.repeat(F.lit("w"), n(w) - 1)))
    return F.array_join(F.transform(words, shape), " ")


def digest(value: Column, salt: str) -> Column:
    """Sixteen hex digits of a salted SHA-256."""
    return F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 16)


def hmac(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text under a key, as hex digits: two digests over the key's two pads, in column functions alone.

    Null stays null; a key of more than 64 bytes counts as its own digest.
    """
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)


def pseudonym(value: Column, salt: str, kind: str) -> Column:
    prefix = {"author_id": "USER", "account_id": "USER", "tweet_id": "TWEET", "cluster_id": "CLUSTER"}.get(kind, "ID")
    return F.concat(F.lit(prefix + "_"), F.upper(F.substring(digest(value, salt), 1, 8)))


def region(location: Column) -> Column:
    """The first fixed rule whose names the location holds."""
    low = F.lower(F.coalesce(location, F.lit("")))
    rules = [(("new york", "ny"), "northeast_us"), (("california", "ca"), "west_us"), (("texas", "tx"), "south_us"), (("london", "uk"), "uk"), (("europe",), "europe"), (("asia",), "asia")]
    out = F.when(F.lit(False), "")
    for names, name in rules:
        hit = low.contains(names[0])
        for n in names[1:]:
            hit = hit | low.contains(n)
        out = out.when(hit, name)
    return out.otherwise("other")


def category() -> Column:
    low = F.lower(F.coalesce("text", F.lit("")))
    return F.when(F.size("urls") > 0, "contains_links").when(F.size("mentions") > 3, "social").when(F.size("hashtags") > 2, "promotional").when(low.contains("buy") | low.contains("sell"), "commercial").when(low.contains("follow") | low.contains("like"), "engagement").otherwise("general")


def uniform(*parts: Column) -> Column:
    """52 hashed bits of the parts as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 13), 16, 10).cast("double") / float(1 << 52)


def noise(value: Column, key: Column, sensitivity: float, epsilon: float, seed: int, mode: str = "laplace") -> Column:
    """Laplace noise of scale sensitivity / epsilon, or uniform in plus or minus that; drawn by hashing seed and key, so it does not depend on how rows are dealt."""
    scale, u = sensitivity / epsilon, uniform(F.lit(seed), key) - 0.5
    return value + (u * 2 * scale if mode == "uniform" else -scale * F.signum(u) * F.log1p(-2 * F.abs(u) + 1e-300))


#: The ways a field can be treated; others fall back to the digest.
METHODS = ("hash", "pseudonymize", "suppress")


def field(value: Column, kind: str, salt: str, method: str = "hash", enabled: bool = True) -> Column:
    if not enabled:
        return value
    if method == "suppress":
        return F.when(value.isNotNull(), "[REDACTED]")
    return pseudonym(value, salt, kind) if method == "pseudonymize" else digest(value, salt)


def field_list(values: Column, kind: str, salt: str, method: str = "hash") -> Column:
    """A short list of ids in one row, each treated as a field; ids of a cluster stay rows."""
    return F.transform(values, lambda v: field(v.cast("string"), kind, salt, method))


def pattern_kind(pattern: Column) -> Column:
    """The kind of a cluster's pattern, by the first of the fixed words it holds."""
    return F.when(pattern.contains("URL"), "contains_urls").when(pattern.contains("mention"), "contains_mentions").when(pattern.contains("hashtag"), "contains_hashtags").otherwise("text_similarity")


def is_complete() -> Column:
    """Whether at least two of an account's four fields are filled."""
    filled = [F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0) for c in ("bio", "location", "website", "profile_image_url")]
    return filled[0] + filled[1] + filled[2] + filled[3] >= 2


def hour_of(ts: str) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def anonymous_posts(posts: DataFrame, salt: str, enabled: bool = True) -> DataFrame:
    """Posts (with spam_score or null, cluster_id or null) without what names anyone; as they are if not enabled."""
    if not enabled:
        return posts.select(F.col("id").cast("string").alias("id"), "text", F.col("author_id").cast("string").alias("author"), F.col("created_at").alias("hour"), F.format_string("%.2f", F.round(F.coalesce("spam_score", F.lit(0.0)), 2)).alias("spam_confidence"), F.col("cluster_id").cast("string").alias("cluster_id"))
    engagement = F.col("retweet_count") + F.col("like_count") + F.col("reply_count")
    return posts.select(
        field(F.col("id").cast("string"), "tweet_id", salt).alias("id"), field(F.col("author_id").cast("string"), "author_id", salt, "pseudonymize").alias("author"), hour_of("created_at").alias("hour"), structure(scrub(F.col("text"))).alias("text"),
        tier("engagement", engagement).alias("engagement"), category().alias("category"), tier("spam", F.coalesce("spam_score", F.lit(0.0))).alias("spam_confidence"), field(F.col("cluster_id").cast("string"), "cluster_id", salt).alias("cluster_id"),
    )


def anonymous_accounts(accounts: DataFrame, salt: str) -> DataFrame:
    c = F.col
    return accounts.select(
        field(c("id").cast("string"), "account_id", salt).alias("id"), "is_verified", is_complete().alias("profile_complete"), tier("account_age", c("account_age_days")).alias("age"), tier("followers", c("followers_count")).alias("followers"), tier("activity", c("tweets_per_day")).alias("activity"),
        tier("bot", c("bot_score")).alias("bot"), F.when(F.coalesce("location", F.lit("")) != "", region(c("location"))).alias("location"),
    )


def anonymous_clusters(clusters: DataFrame, salt: str, epsilon: float, seed: int) -> DataFrame:
    """Scored clusters with digests, hours, the pattern's kind, the template's shape and noise on confidence and rate."""
    key = F.col("cluster_id").cast("string")
    return clusters.select(
        field(key, "cluster_id", salt).alias("cluster_id"), "size", "unique_accounts", "suspicion_level", "is_coordinated", hour_of("first_seen").alias("first_hour"), hour_of("last_seen").alias("last_hour"), pattern_kind(F.col("pattern")).alias("pattern"), structure(scrub(F.col("template"))).alias("template"),
        noise(F.col("confidence"), F.concat(F.lit("confidence-"), key), 0.05, epsilon, seed, "uniform").alias("confidence"), noise(F.col("tweets_per_minute"), F.concat(F.lit("rate-"), key), 0.1, epsilon, seed, "uniform").alias("tweets_per_minute"),
    )


def k_anonymous(df: DataFrame, quasi: list[str], k: int, sensitive: str | None = None, l_diversity: int = 1) -> DataFrame:
    """Rows whose quasi-identifiers at least k rows share (with l different sensitive values); the other rows are suppressed."""
    agg = [F.count("*").alias("_n")] + ([F.count_distinct(sensitive).alias("_l")] if sensitive else [])
    groups = df.groupBy(*quasi).agg(*agg).where((F.col("_n") >= k) & (F.col("_l") >= l_diversity if sensitive else F.lit(True))).select(*quasi)
    return df.join(groups, quasi, "left_semi")
