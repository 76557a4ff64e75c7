"""Sharding by extendible hashing.

A document's key is the first 60 bits of the MD5 of its id.  The directory is
indexed by leading key bits: a bucket whose documents exceed the byte limit is
split on one more bit, all others stay as they are, so a document's shard is its
shortest key prefix whose documents fit.  Only (prefix, bytes) sums are shuffled:
one histogram at a depth that follows the ratio of all bytes to the limit.  The
directory is read off it ``TIER`` bits at a time from the top, only where the bits
above did not fit, so at most 2**TIER sums meet in one of its nodes and no level is
a hot key; further bits are taken from the documents of buckets still too large.

Defined cases: null text has no bytes; a row without an id has the digest of its text as its key
(null as the empty text), so different texts are parted; documents whose 60 key bits are all the same cannot be parted and keep depth 60
(``fits`` is false if they exceed the limit, as for one document over it); an
empty table gives an empty table; repeated rows share their shard.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmlens.llm.session import fresh

BITS = 60
#: Bits that are judged together, and the depth up to which a tier's verdicts (at most two to its power) are broadcast.
TIER, MOST_BROADCAST_BITS = 8, 16
LIMIT = 1 << 20


def _leaves(sums: DataFrame, low: int, depth: int, limit: int) -> DataFrame:
    """(prefix of ``depth`` bits, leaf): its highest node from depth ``low`` on that fits (depth and bytes); null where none does."""
    up = sums.select("prefix", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("depth"), "n_bytes").withColumn("node", F.expr(f"shiftrightunsigned(prefix, {depth} - depth)"))
    nodes = up.groupBy("depth", "node").agg(F.sum("n_bytes").alias("node_bytes")).where(F.col("node_bytes") <= limit)
    return up.join(nodes, ["depth", "node"], "left").groupBy("prefix").agg(F.min(F.when(F.col("node_bytes").isNotNull(), F.struct("depth", F.col("node_bytes").alias("shard_bytes")))).alias("leaf"))


def _directory(hist: DataFrame, low: int, depth: int, limit: int) -> DataFrame:
    """``_leaves`` of a histogram of (prefix, n_bytes), tier by tier."""
    done, rest = [], hist
    for tier in range(min(low + TIER - 1, depth), depth + TIER, TIER):
        tier = min(tier, depth)
        above = F.shiftrightunsigned("prefix", depth - tier)
        sums = rest.groupBy(above.alias("prefix")).agg(F.sum("n_bytes").alias("n_bytes")) if tier < depth else rest
        found = _leaves(sums, low, tier, limit)
        if tier == depth:
            return reduce(DataFrame.union, [*done, found])
        found = found.checkpoint().select(F.col("prefix").alias("above"), "leaf")
        placed = rest.join(F.broadcast(found) if tier <= MOST_BROADCAST_BITS else found, above == F.col("above")).drop("above")  # at most 2**tier rows
        done.append(placed.where("leaf IS NOT NULL").select("prefix", "leaf"))
        rest, low = placed.where("leaf IS NULL").select("prefix", "n_bytes").checkpoint(), tier + 1


def assign_shards(docs: DataFrame, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, shard (the key prefix as bits), depth, shard_bytes and fits."""
    docs = docs.drop("n_bytes", "shard", "depth", "shard_bytes", "fits")
    key, leaf, other, place = fresh(docs, "_key", "_leaf", "_other", "_prefix")
    prefix = lambda depth: F.shiftrightunsigned(key, BITS - depth)
    keyed = docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")).withColumn(key, F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text|"), F.md5(F.coalesce(F.col(text), F.lit("")))))), 1, BITS // 4), 16, 10).cast("bigint"))
    sizes = keyed.select(key, "n_bytes")
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(4, math.ceil(math.log2(max(total / limit, 1))) + 4))
    open_, low, levels = sizes, 0, []
    while True:
        hist = open_.groupBy(prefix(depth).alias("prefix")).agg(F.sum("n_bytes").alias("n_bytes")).checkpoint()
        leaves = _directory(hist, low, depth, limit).checkpoint()
        if depth == BITS:
            leaves = leaves.withColumn("leaf", F.coalesce("leaf", F.struct(F.lit(BITS).alias("depth"), F.lit(None).cast("bigint").alias("shard_bytes"))))
        levels.append((depth, leaves.where("leaf IS NOT NULL")))
        large = leaves.where("leaf IS NULL").select("prefix")
        if depth == BITS or large.isEmpty():
            break
        open_ = open_.join(large, prefix(depth) == F.col("prefix"), "left_semi")
        low, depth = depth + 1, min(BITS, depth + TIER)
    out = keyed.withColumn(leaf, F.lit(None).cast("struct<depth:int,shard_bytes:bigint>"))
    for depth, leaves in levels:
        found = leaves.select(F.col("prefix").alias(place), F.col("leaf").alias(other))
        out = out.join(found, prefix(depth) == F.col(place), "left").withColumn(leaf, F.coalesce(leaf, other)).drop(place, other)
    shard = F.when(F.col(f"{leaf}.depth") == 0, F.lit("")).otherwise(F.expr(f"lpad(bin(shiftrightunsigned({key}, {BITS} - {leaf}.depth)), {leaf}.depth, '0')"))
    out = out.select("*", shard.alias("shard"), F.col(f"{leaf}.depth").alias("depth"), F.col(f"{leaf}.shard_bytes").alias("shard_bytes"))
    return out.withColumn("fits", F.col("shard_bytes").isNotNull()).drop(leaf, key)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write each shard into a folder of its own; a shard's rows meet in one task, which the byte limit bounds."""
    assign_shards(docs, limit).repartition("shard").write.partitionBy("shard").parquet(path)


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign_shards(docs).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "fits")


OP8_SQL = f"""
WITH k AS (SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text|' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS key FROM documents),
d AS (SELECT r, depth, key >> (60 - depth) AS node, n_bytes FROM k, range(0, 61) AS s(depth)),
n AS (SELECT depth, node, sum(n_bytes)::BIGINT AS node_bytes FROM d GROUP BY ALL HAVING sum(n_bytes) <= {LIMIT}),
b AS (SELECT r, min(depth)::INTEGER AS depth, min_by(node_bytes, depth) AS shard_bytes FROM d JOIN n USING (depth, node) GROUP BY r)
SELECT doc_id, n_bytes, CASE WHEN coalesce(depth, 60) = 0 THEN '' ELSE lpad(bin(key >> (60 - coalesce(depth, 60))), coalesce(depth, 60), '0') END AS shard,
coalesce(depth, 60) AS depth, shard_bytes, shard_bytes IS NOT NULL AS fits FROM k LEFT JOIN b USING (r)
"""
