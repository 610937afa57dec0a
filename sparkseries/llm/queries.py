"""The registered queries of the dealt operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseries.llm import (
    bpe, chat, decontaminate, langid, lexical, licenses, near_dedup, orc_tokens, phrases, sharding, token_counts, topk,
    toxicity)
from sparkseries.llm.oracle import SQL as ORACLES
from sparkseries.llm.tables import free, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"),
                                             word_pattern())


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(chat.trap(table(spark, sf_dir, "conversations")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.token_file_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Stages of the corpus pipeline: each takes the documents its predecessor kept.

def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: any but ``und``, with a calibrated score above that of text in no
    learned language (``langid.least_score``).  Where no language could be learned, documents with a letter."""
    model = langid.train(docs)
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(langid.LETTER), F.lit(False)))
    lang, score = free(docs, "__lang"), free(docs, "__score")
    pred = langid.predict(docs, model, docs.columns, out=(lang, score))
    known = (F.col(lang) != langid.UNKNOWN) & (F.col(score) >= langid.least_score(model))
    return pred.where(known).drop(lang, score)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = free(docs, "__score")
    return toxicity.score(docs, model, docs.columns, out=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' token counts and digests."""
    return bpe.encode_digests(docs, vocabulary("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_bpe, op3_language, op4_token_counts, op5_top_k, op6_chat,
                                   op7_decontamination, op8_toxicity, op9_licenses,
                                   op10_sharding, op11_token_files, op12_collocations, op13_lexical_search)}
SQL = ORACLES
