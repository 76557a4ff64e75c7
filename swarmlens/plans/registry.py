"""All queries of the engine's own operators and their SQL."""

from swarmlens.plans import analytics_queries, detection_queries, extension_queries, incremental_queries, report_queries, service_queries, similarity_queries, stream_queries  # noqa: F401
from swarmlens.plans.register import ORACLE_SQL, QUERIES, query

#: The queries that stand on clusters of equal texts.
ON_CLUSTERS = "A1_cluster_stats A2_confidence A3_coordination A4_pattern A5_template A6_detection_result A7_spam_marking A8_account_spam A10_app_stats A11_account_activity P3_member_posts P7_min_cluster_size P8_confidence_filter P9_suspicious_accounts P10_posts_of_largest_cluster J6_cluster_accounts W6_first_post_of_account K1_export K2_read_clusters M2_cluster_alerts M9_builtin_alerts M16_alert_records N10_anonymous_clusters N9_id_lists".split()


def _near(f):
    def run(spark, sf_dir):
        kept = detection_queries.NEAR.set(True)
        try:
            return f(spark, sf_dir)
        finally:
            detection_queries.NEAR.reset(kept)

    return run


for _name in ON_CLUSTERS:  # the same over clusters of near duplicates
    query(_name.replace("_", "_near_", 1), detection_queries.near_sql(ORACLE_SQL[_name]))(_near(QUERIES[_name]))


def flagship(spark, sf_dir):
    """Near-duplicate pairs of documents."""
    return QUERIES["L4_minhash_pairs"](spark, sf_dir)
