"""From raw documents to packed training sequences, in five stages.

Every stage works on all that the one before kept; each result is written as
Parquet and read again.  ``STAGES`` lists the stages in order; all but the last
return the columns of ``documents``, whatever columns these are: the stages add
none and overwrite none but ``text`` and ``n_chars``.

Defined results: null texts count as empty and stay null until they are packed;
empty and null texts are no near duplicates and stay; rows that repeat a kept
doc_id leave one, rows without an id stay unless a stage rejects their text; of
equal copies the smallest doc_id stays; very long texts are worked on whole; an empty table gives an empty
result, and without usable labels no document is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontamination, near_duplicates, packing, pii, toxicity
from spindrift.llm.common import prepare, store, table
from spindrift.llm.queries import pseudonym_key, tokenizer_path

#: No single SQL statement expresses the trained and the tokenised stages.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled ones among them."""
    prepare(spark)
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingle sets are at least 0.8 alike."""
    return near_duplicates.keep_one(docs, near_duplicates.Settings(numerator=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copied or edited passage of the benchmark; rows without an id are told by their texts."""
    told = F.coalesce(F.concat(F.lit("id:"), F.col("doc_id").cast("string")), F.concat(F.lit("text:"), F.sha2("text", 256)), F.lit("empty"))
    found = decontamination.leaks(docs.select(told.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaked = store(found.select(F.col("doc_id").alias("leaked")).distinct(), "leaked")
    return docs.join(leaked, told == F.col("leaked"), "left_anti").select(docs.columns)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses replaced within their formats."""
    out = pii.pseudonymise(docs, pseudonym_key(spark), counts=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in training sequences."""
    return packing.pack(docs, packing.Settings(tokenizer_path()))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", pseudonymise), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
