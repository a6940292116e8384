"""Registered queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, importance, jaccard, licenses, media, repair, toxic, urlmodel, winnow
from .brown import score_documents
from .packing import pack
from .quality import quality
from .store import documents
from .tokens import count_tokens


def vocabulary(name: str) -> str:
    """Where the public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(spark, media.store_media(spark, documents(spark, sf_dir)))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_chats(spark, chat.records_of(rows)))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(spark, documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark, documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxic.score(spark, docs, toxic.train(spark, docs, documents(spark, sf_dir, "labels")))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlmodel.judge_urls(spark, documents(spark, sf_dir, "pages"))
    return judged.withColumns({c: F.round(c, 6) for c in ("score", "threshold")})


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.hits(spark, documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, documents(spark, sf_dir))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(spark, documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(spark, repair.damage(documents(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_media_columns": op2_media_columns,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_packing": op4_packing,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_token_counts": op6_token_counts,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_toxicity": op8_toxicity,
    "op9_url_filters": op9_url_filters,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_license_scans": op11_license_scans,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_structure_repair": op13_structure_repair,
}

ORACLES: dict[str, str] = {
    "op5_ngram_jaccard_join": jaccard.ORACLE,
    "op9_url_filters": urlmodel.ORACLE,
    "op10_benchmark_decontamination": winnow.ORACLE,
    "op11_license_scans": licenses.ORACLE,
    "op12_importance_resampling": importance.ORACLE,
    "op13_structure_repair": repair.ORACLE,
}
