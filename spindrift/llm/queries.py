"""The registered queries: thin applications of the operators to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, compression, decontamination, language_model, near_duplicates, ogg, packing, phrases, pii, repair, suffixes, token_files, toxicity
from .common import scratch, table


def tokenizer_path() -> str:
    """The byte-level vocabulary that op5 counts in; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts look like the template's own marks."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], rows.schema)
    return chat.digests(chat.conversations(chat.chain(rows.unionByName(extra))))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), 0.5)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), near_duplicates.Settings(numerator=85))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.Settings(tokenizer_path()))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents"), suffixes.Settings(length=200))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item that it copies, with its best passage."""
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "first_word", "end_word", "n_seeds")).alias("best"), F.count("*").alias("n_passages")).select("doc_id", "item_id", "best.*", "n_passages")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_columns(table(spark, sf_dir, "documents"))


#: Session setting with the pseudonyms' key, and the key of tests and demonstrations.
KEY_SETTING, DEMONSTRATION_KEY = "spark.spindrift.pseudonyms.key", "spindrift-demonstration-key"


def pseudonym_key(spark: SparkSession) -> str:
    """The deployment's own key; only where it has set none, the demonstration key."""
    return spark.conf.get(KEY_SETTING, None) or DEMONSTRATION_KEY


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compression.score(docs, compression.train(docs, table(spark, sf_dir, "labels")), 0.3)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


def word_tokenizer_path() -> str:
    """The vocabulary of word ends that op12 writes ids of; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written as files of bit planes and read back."""
    path = scratch(spark, "token-planes")
    token_files.write(table(spark, sf_dir, "documents"), path, token_files.Settings(word_tokenizer_path()))
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language (the limit is the feature), from counts over all documents."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_language_model, op3_toxicity, op4_near_duplicates, op5_best_fit_packing, op6_suffix_array_dedup, op7_decontamination, op8_media_columns, op9_pseudonyms, op10_quality_classifier, op11_conversation_repair, op12_token_files, op13_collocations)}
