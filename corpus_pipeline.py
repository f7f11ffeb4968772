"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

So what a stage has stored besides its result is removed when the next one begins.
"""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evloom.llm import bpe, langid, mixing, nearcopy, quality
from evloom.llm.common import discard, documents, shared_dir, stored


_left: set[str] = set()


def stage(f):
    """f as a stage: what the stage before has stored besides its result is removed first, for its result is written by then."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _left)
        before = stored()
        out = f(spark, docs, sf_dir)
        _left.clear()
        _left.update(stored() - before)
        return out

    return run_stage


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with lang set to it."""
    return langid.language_filter(docs)


@stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return quality.quality_filter(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash's links first, then all others, each verified as a Jaccard similarity of five-word shingles of 0.8 or more."""
    return nearcopy.keep_one(docs, width=5)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out as their source's target asks."""
    return mixing.mix(docs)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A digest of each remaining row's token ids and of the text decoded from them."""
    return bpe.token_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("quality rules", rules), ("SimHash near-dedup", near_dedup), ("mixing", mix), ("BPE", tokens)]

#: Language models and SimHash have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, apply) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{k}-{uuid.uuid4().hex}"
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
