"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next stage's input.  All but the last
return the columns that they were given, whatever else those are named; rows may
have become fewer, or more (mixing).

1. language ID: documents without a language (no letters, or no language that
   holds half of the letters) go.
2. n-gram Jaccard join: of each class of near duplicates the document with the
   least id stays.
3. substring dedup: words in passages of 35 words or more that occur twice go.
4. mixing: each source is repeated to its target share.
5. byte-level BPE: the kept texts' ids, and digests of ids and decoded bytes.

Defined cases, each stage on its own input: an empty table gives an empty table;
null texts go in stage 1, stay as they are in stages 2 to 4 and have no ids in stage
5; null ids, languages and sources are values like others, and stage 2 prefers
an id to none; ties and repeated rows are stated with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmlens.llm import byte_bpe, language_id, mixing, ngram_join, substring_dedup
from swarmlens.llm.session import shared_checkpoints

#: No SQL can express the language model of stage 1; tests hold run() against a brute-force version of all five stages.
ORACLE_SQL = None


def _apart(docs: DataFrame) -> DataFrame:
    """The columns under names that no operator uses."""
    return docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns})


def _back(df: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` again, some of them changed."""
    return df.select([(changed[c] if c in changed else F.col(f"in_{c}")).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one recognised language; a missing lang is filled in.

    Repeated rows are kept or not alike; where half of the letters are in one language and half in another, the document stays.
    """
    shared_checkpoints(spark)
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.predict(_apart(docs), model, text="in_text")
    return _back(found.where("lang_pred <> 'und' AND score >= 0.5"), docs, lang=F.coalesce("in_lang", "lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: that with the least id, then the least text digest.

    Classes are those of texts, so documents with one id and unrelated texts are told
    apart.  Of rows that repeat both id and text, the least by their other columns
    stays.  A null text is no duplicate of anything and stays.
    """
    shared_checkpoints(spark)
    classes = ngram_join.near_duplicates(docs.select("doc_id", "text")).where("key IS NOT NULL").select("doc_id", "key", "class_key").checkpoint()
    least = classes.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "key")).alias("m"))
    kept = least.select(F.col("m.id").alias("kept_id"), F.col("m.key").alias("kept_key"))
    apart = _apart(docs).withColumn("key", F.unhex(F.md5("in_text")))
    stay = apart.join(kept, (F.col("key") == F.col("kept_key")) & F.col("in_doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    if not classes.groupBy("key", "doc_id").count().where("count > 1").isEmpty():
        row = F.struct(*[f"in_{c}" for c in docs.columns])
        stay = stay.groupBy("key", "in_doc_id").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return _back(stay, docs).union(docs.where("text IS NULL"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of passages that occur twice in what is left; repeated rows lose all such words alike."""
    shared_checkpoints(spark)
    cut = substring_dedup.dedup_substrings(_apart(docs), text="in_text")
    return _back(cut, docs, text=F.col("kept_text"), n_chars=F.length("kept_text").cast("bigint"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins each source to its target share; repeated rows of one id are repeated alike."""
    shared_checkpoints(spark)
    return _back(mixing.mix_sources(_apart(docs), source="in_source", doc_id="in_doc_id"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every text; a null text has none."""
    shared_checkpoints(spark)
    return byte_bpe.encode_documents(docs.select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_to_targets),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage returns is written to the shared folder and read again."""
    import uuid

    shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
