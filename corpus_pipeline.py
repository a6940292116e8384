"""Stages that turn ``documents`` into packed training sequences, each by one operator."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cairnmesh.llm import jaccard, toxic, winnow
from cairnmesh.llm.packing import pack
from cairnmesh.llm.quality import Posterior
from cairnmesh.llm.queries import vocabulary
from cairnmesh.llm.store import Scratch, documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is at least one half stay."""
    return Posterior(spark, docs, documents(spark, sf_dir, "labels")).filtered()


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's calibrated threshold stay."""
    return toxic.filtered(spark, docs, toxic.train(spark, docs, documents(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents stays."""
    return jaccard.one_each(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate stay."""
    return winnow.clean(spark, docs, documents(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in the sequences."""
    return pack(spark, docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("toxicity", toxicity), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("packing", packing)]

#: A classifier fitted by iteration and a tokenizer's ids are beyond SQL: the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a written table."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
