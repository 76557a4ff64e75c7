"""The detection engine: near-duplicate clusters of posts, scored, marked and summed up."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmlens.operators import detection as D
from swarmlens.operators import graphs
from swarmlens.operators import similarity as S
from swarmlens.plans.config import DetectionConfig


def near_clusters(docs: DataFrame, algorithm: str, doc_id: str = "doc_id", config: DetectionConfig = DetectionConfig(), keyed: DataFrame | None = None) -> DataFrame:
    """(id, cluster_id) of clusters of near duplicates: leader clusters of distinct texts, whose pairs are not listed, and all copies by membership.

    ``keyed``: ``similarity.keys`` of the documents that count, where they are kept already.
    """
    texts = S.distinct_texts(docs, doc_id, keyed=keyed)
    seeds = S.minhash_leaders(texts, config.minhash_hashes, config.minhash_bands, config.minhash_threshold) if algorithm == "minhash" else S.simhash_leaders(texts, config.simhash_tables, config.simhash_threshold)
    placed = S.membership(docs, doc_id, keyed=keyed).join(graphs.shuffled(seeds.withColumnRenamed("id", "rep")), "rep", "left").select(F.col("doc_id").alias("id"), F.coalesce("seed", "rep").alias("cluster_id")).checkpoint()
    return placed.join(graphs.shuffled(placed.groupBy("cluster_id").count().where("count > 1")), "cluster_id", "left_semi")


def at_least(placed: DataFrame, size: int) -> DataFrame:
    """The members of clusters of at least ``size`` rows."""
    return placed.join(graphs.shuffled(placed.groupBy("cluster_id").count().where(F.col("count") >= size).select("cluster_id")), "cluster_id", "left_semi")


@dataclass(frozen=True)
class Detection:
    """What one run found; all parts are DataFrames.

    members: posts with cluster_id and their author's bot_score; clusters: scored, with
    detection_method, lsh_threshold and is_spam; marked: (id, cluster_id, spam_score) of
    spam; accounts: suspicious ones with spam_tweet_count; result: one row of totals.
    """

    members: DataFrame
    clusters: DataFrame
    marked: DataFrame
    accounts: DataFrame
    result: DataFrame


@dataclass(frozen=True)
class Engine:
    """The facade: settings that were checked, and one call that detects."""

    config: DetectionConfig = DetectionConfig()

    def updated(self, **changes) -> "Engine":
        """An engine with other settings, which are checked; what it detects is computed anew from the posts."""
        return Engine(replace(self.config, **changes))

    @property
    def algorithm(self) -> str:
        return "hybrid" if self.config.enable_hybrid_mode else "minhash"

    def placed(self, posts: DataFrame) -> DataFrame:
        """(id, cluster_id): MinHash clusters of the least size and, in hybrid mode, SimHash clusters of which less than half is in those.

        SimHash clusters share no post with each other, so the order in which they are admitted cannot matter.
        """
        minhash = at_least(near_clusters(posts, "minhash", "id", self.config), self.config.min_cluster_size)
        if not self.config.enable_hybrid_mode:
            return minhash.select("id", F.concat(F.lit("minhash-"), F.col("cluster_id").cast("string")).alias("cluster_id"))
        both = D.hybrid_union(minhash, at_least(near_clusters(posts, "simhash", "id", self.config), self.config.min_cluster_size))
        return both.select("id", F.concat_ws("-", "algorithm", F.col("cluster_id").cast("string")).alias("cluster_id"))

    def detect(self, posts: DataFrame, accounts: DataFrame) -> Detection:
        """``posts`` as the adapters give them, ``accounts`` with id and bot_score; raises if there are no posts' columns to work on."""
        graphs.ready(posts.sparkSession)
        if missing := {"id", "text", "author_id", "created_at"} - set(posts.columns):
            raise ValueError(f"posts lack {sorted(missing)}")
        placed = self.placed(posts).checkpoint()
        scores = accounts.select(F.col("id").alias("author_id"), "bot_score")
        members = posts.join(graphs.shuffled(placed), "id").join(graphs.shuffled(scores), "author_id", "left").withColumn("bot_score", F.coalesce("bot_score", F.lit(0.0)))
        spam = F.col("confidence") >= self.config.spam_score_threshold
        clusters = D.scored(D.cluster_stats(members)).withColumns({"detection_method": F.lit(self.algorithm), "lsh_threshold": F.lit(self.config.minhash_threshold), "is_spam": spam}).checkpoint()
        kept = clusters.where("is_spam").select("cluster_id", F.col("confidence").alias("spam_score"), "size", "is_coordinated")
        marked = placed.join(kept, "cluster_id").select("id", "cluster_id", "spam_score")
        counts = members.select("author_id", "cluster_id").distinct().join(kept, "cluster_id", "left_semi").groupBy(F.col("author_id").alias("id")).agg(F.count("*").alias("spam_tweet_count"))
        suspects = accounts.join(counts, "id", "left").withColumn("spam_tweet_count", F.coalesce("spam_tweet_count", F.lit(0))).where((F.col("bot_score") > self.config.bot_score_threshold) | (F.col("spam_tweet_count") > 0))
        totals = kept.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("spam_tweets"), F.count("*").alias("spam_clusters"), F.max("size").alias("largest_cluster"), F.avg("size").alias("avg_cluster_size"), F.count_if("is_coordinated").alias("coordinated_clusters"))
        result = posts.agg(F.count("*").alias("total_tweets")).join(totals, F.lit(True))  # a row each
        result = result.withColumn("spam_rate", F.coalesce(F.try_divide(F.col("spam_tweets").cast("double"), F.col("total_tweets")), F.lit(0.0)))
        result = result.select(F.lit(self.algorithm).alias("algorithm"), F.lit(self.config.minhash_threshold).alias("threshold"), F.lit(self.config.min_cluster_size).alias("min_cluster_size"), "*")
        return Detection(members, clusters, marked, suspects, result)


def posts_of_cluster(marked: DataFrame, cluster_id) -> DataFrame:
    """The rows of one cluster; an error if there is none of this id."""
    found = marked.where(F.col("cluster_id") == F.lit(cluster_id))
    if found.isEmpty():
        raise KeyError(f"no cluster {cluster_id!r}")
    return found
