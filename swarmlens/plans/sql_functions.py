"""The engine's scalar functions under SQL names, as SQL functions that the optimiser inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from swarmlens.functions.text import WORD

#: name(parameters) -> type, and its expression.
FUNCTIONS = {
    "simhash_distance(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
    "simhash_similarity(a BIGINT, b BIGINT) RETURNS DOUBLE": "1 - bit_count(a ^ b) / 64.0D",
    "signature_similarity(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS DOUBLE": "if(size(a) = size(b) AND size(a) > 0, size(filter(zip_with(a, b, (x, y) -> x = y), z -> z)) / cast(size(a) AS double), 0.0D)",
    "word_count(t STRING) RETURNS INT": f"size(regexp_extract_all(lower(t), '{WORD}', 0))".replace("\\", "\\\\"),
    "decayed_score(score DOUBLE, days DOUBLE) RETURNS DOUBLE": "greatest(0.0D, least(1.0D, score * exp(-0.1D * days) + 0.5D * (1 - exp(-0.1D * days))))",
    "shortened(t STRING) RETURNS STRING": "if(octet_length(t) > 100, concat(substring(t, 1, 97), '...'), t)",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session; again is harmless."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
