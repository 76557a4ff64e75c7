"""Text expressions: normalisation, words, shingles, similarity features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{Nd}]+"
URL, MENTION, HASHTAG = r"https?://\S+", r"@\S+", r"#\S+"


def bare(text: Column) -> Column:
    """Lower case without links, mentions and hashtags."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern in (URL, MENTION, HASHTAG):
        out = F.regexp_replace(out, pattern, "")
    return out


def word_runs(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def long_words(text: Column) -> Column:
    """Words of three bytes or more of a post's bare text."""
    return F.filter(word_runs(bare(text)), lambda w: F.octet_length(w) >= 3)


def words_apart(low: Column) -> Column:
    """The words of a lower-case text without links, mentions and hashtags, parted by spaces or whatever else of ASCII is no letter or digit.

    One pass: a link, mention or hashtag goes on to the next white space, whichever of
    them begins first, so that taking them out one after the other leaves the same words.
    Texts that can have none of them take a shorter pattern, and ASCII ones none.
    """
    signs = F.contains(low, F.lit("@")) | F.contains(low, F.lit("#")) | F.contains(low, F.lit("://"))
    apart = r"[^\x00-\x7F\p{L}\p{Nd}]+"
    return F.when(signs, F.regexp_replace(low, rf"https?://\S+|[@#]\S*|{apart}", " ")).when(F.octet_length(low) > F.length(low), F.regexp_replace(low, apart, " ")).otherwise(low)


def sketch_parts(df, text: str, size: str | None = None):
    """(id, links, mentions, hashtags, words): what ``feature_parts`` finds, as a number and as strings parted by spaces; patterns run where a text can have what they find.

    ``size`` names a column that goes along, as size.
    """
    more = [F.col(size).alias("size")] if size else []
    df = df.select("id", *more, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    bare_of_links = F.when(F.contains("_low", F.lit("://")), F.regexp_replace("_low", URL, " ")).otherwise(F.col("_low"))

    def tags(sign: str) -> Column:
        names = F.array_distinct(F.regexp_extract_all(bare_of_links, F.lit(sign + r"(\S+)"), F.lit(1)))
        return F.when(F.contains("_low", F.lit(sign)), F.array_join(F.transform(names, lambda x: F.concat(F.lit(sign), x)), " ")).otherwise("")

    links = F.when(F.contains("_low", F.lit("://")), F.size(F.regexp_extract_all("_low", F.lit(URL), F.lit(0)))).otherwise(0)
    return df.select("id", links.alias("links"), tags("@").alias("mentions"), tags("#").alias("hashtags"), words_apart(F.col("_low")).alias("words"), *(["size"] if size else []))


def grams(words: str | Column, n: int) -> Column:
    """Runs of n words, joined by a space."""
    words = F.col(words) if isinstance(words, str) else words
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def shingles(words: str) -> Column:
    """The distinct uni-, bi- and trigrams of a column of words."""
    return F.array_distinct(F.concat(F.col(words), grams(words, 2), grams(words, 3)))


def token_code(token: Column) -> Column:
    """The first 28 bits of a token's MD5."""
    return F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("bigint")


def hash64(token: Column) -> Column:
    """The first eight bytes of the MD5 as a signed 64-bit number."""
    return F.conv(F.substring(F.md5(token), 1, 16), 16, -10).cast("bigint")


#: What a post's links, mentions and hashtags look like, and what a text without it cannot have.
ENTITIES = {"urls": (URL, "://"), "mentions": (r"@[A-Za-z0-9_]+", "@"), "hashtags": (r"#[A-Za-z0-9_]+", "#")}


def extracted(text: Column, kind: str) -> Column:
    """Links, mentions or hashtags of a post, as written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITIES[kind][0]), F.lit(0))


def has(text: Column, kind: str) -> Column:
    """Whether ``extracted`` finds any; patterns run where a text can have what they find."""
    pattern, sign = ENTITIES[kind]
    return F.coalesce(F.contains(text, F.lit(sign)) & text.rlike(pattern), F.lit(False))


def feature_parts(df, text: str):
    """``df`` with what similarity features are made of: links (_links), mentions (_m) and hashtags (_h) once each, words (_w) and runs of three letters or more (_r)."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_links", F.regexp_extract_all(low, F.lit(URL), F.lit(0))).withColumn("_t", F.regexp_replace(low, URL, " "))
    df = df.withColumn("_m", F.array_distinct(F.transform(F.regexp_extract_all("_t", F.lit(r"@(\S+)"), F.lit(1)), lambda m: F.concat(F.lit("@"), m))))
    df = df.withColumn("_h", F.array_distinct(F.transform(F.regexp_extract_all("_t", F.lit(r"#(\S+)"), F.lit(1)), lambda m: F.concat(F.lit("#"), m))))
    df = df.withColumn("_b", F.regexp_replace(F.regexp_replace("_t", MENTION, " "), HASHTAG, " "))
    return df.withColumn("_w", word_runs(F.col("_b"))).withColumn("_r", F.regexp_extract_all("_b", F.lit(r"\p{L}{3,}"), F.lit(0))).drop("_t", "_b")


def weighted_features(df, text: str):
    """``df`` with features: every occurrence of a similarity feature.

    A count of links; mentions and hashtags once each; words of three bytes or more;
    pairs of neighbouring words that are both that long; letter trigrams.
    """
    df = feature_parts(df, text)
    pairs = F.when(F.size("_w") > 1, F.filter(F.transform(F.sequence(F.lit(0), F.size("_w") - 2), lambda i: F.when((F.octet_length(F.get("_w", i)) >= 3) & (F.octet_length(F.get("_w", i + 1)) >= 3), F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1)))), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    letters = F.flatten(F.transform("_r", lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 2), lambda i: F.concat(F.lit("__CHAR__"), F.substr(r, i, F.lit(3))))))
    words = F.filter("_w", lambda w: F.octet_length(w) >= 3)
    links = F.array_repeat(F.lit("__HAS_URL__"), F.size("_links"))
    return df.withColumn("features", F.concat(links, "_m", "_h", words, pairs, letters)).drop("_links", "_m", "_h", "_w", "_r")


def byte_values(text: Column) -> Column:
    """The UTF-8 bytes as numbers."""
    digits = F.hex(F.encode(text, "UTF-8"))
    return F.when(F.octet_length(text) > 0, F.transform(F.sequence(F.lit(0), F.octet_length(text) - 1), lambda i: F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def fnv32(text: Column) -> Column:
    """The 32-bit FNV-1a hash (fixed offset and prime)."""
    return F.aggregate(byte_values(text), F.lit(2166136261).cast("bigint"), lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(16777619), F.lit(1 << 32)))


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id that is the same in every run: a digest of what it names."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16))
