"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from evloom.llm import audio, bpe, brown, convrepair, langid, mixing, piece, quality, simhash, tokencount, tokenfile, urlrules, whitening
from evloom.llm.common import documents

BPE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"


def op1_mixing(spark, sf_dir):
    return mixing.mixing_digest(documents(spark, sf_dir))


def op2_quality(spark, sf_dir):
    return quality.judge(documents(spark, sf_dir), "doc_id")


def op3_bpe(spark, sf_dir):
    return bpe.token_digest(documents(spark, sf_dir), public_tokenizers.path(BPE_FILE))


def op4_language(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


def op5_token_counts(spark, sf_dir):
    return tokencount.line_sections(documents(spark, sf_dir), public_tokenizers.path(BPE_FILE))


def op6_audio(spark, sf_dir):
    """The tables hold no sound: each vector of embeddings is rendered as a tune."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = audio.match(vectors.select(F.col("vec_id").alias("media_id"), F.col("embedding").alias("samples")), audio.melody)
    return out.withColumnRenamed("media_id", "vec_id")


def op7_simhash(spark, sf_dir):
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_url_rules(spark, sf_dir):
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return urlrules.judge(pages, urlrules.labelled_pages(pages, labels))


def op9_token_files(spark, sf_dir):
    return tokenfile.token_file_digest(documents(spark, sf_dir), public_tokenizers.path(BPE_FILE))


def op10_class_lm(spark, sf_dir):
    return brown.score_held_out(documents(spark, sf_dir))


def op11_whitening(spark, sf_dir):
    return whitening.whiten_digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_pieces(spark, sf_dir):
    return piece.piece_digest(documents(spark, sf_dir), public_tokenizers.path(PIECE_FILE))


def op13_conversations(spark, sf_dir):
    return convrepair.repair_digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_quality, op3_bpe, op4_language, op5_token_counts, op6_audio, op7_simhash, op8_url_rules, op9_token_files, op10_class_lm, op11_whitening, op12_pieces, op13_conversations)}


def sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL, "op2_quality": quality.sql()}
