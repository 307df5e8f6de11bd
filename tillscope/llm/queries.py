"""The queries of this subpackage, over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.hard_negatives import hard_negatives
from tillscope.llm.itq import itq_near_duplicates
from tillscope.llm.jaccard import ngram_jaccard
from tillscope.llm.language import fit_languages, identify_languages
from tillscope.llm.licences import fit_licences, licence_scan
from tillscope.llm.mixing import mixed_counts
from tillscope.llm.packing import Capacity, best_fit_pack, token_pieces
from tillscope.llm.perspective import perspective_rotation
from tillscope.llm.quality_rules import quality_rules
from tillscope.llm.queries_sql import SQL as SQL
from tillscope.llm.sampling import in_fold
from tillscope.llm.secrets import secret_scan
from tillscope.llm.store import scratch_path
from tillscope.llm.token_store import read_token_store, write_token_store
from tillscope.llm.toxicity import Model, fit_toxicity, score_toxicity
from tillscope.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(docs, "token-store")
    write_token_store(docs, path, _vocabulary("byte_bpe_50k.json"), "bytes", end_id=2)
    return read_token_store(spark.read.parquet(path))


def op2_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(
        docs.where(~in_fold("doc_id", 3, 1)).select("doc_id", "text", docs["lang"].alias("label"))
    )
    folded = docs.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "text")
    return identify_languages(folded, model)


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspective_rotation(_table(spark, sf_dir, "conversations"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """Documents as pieces of 2048 tokens at most, packed into sequences of 2048."""
    capacity = Capacity()
    path = _vocabulary("word_bpe_49k.json")
    pieces = token_pieces(docs, path, "words", end_id=0, most=capacity.tokens)
    return best_fit_pack(pieces, capacity)


def op4_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licence_scan(docs, fit_licences(docs))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """Learned from labelled documents outside the held-out fifth."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    known = docs.where(~in_fold("doc_id", 5, 0)).select("doc_id", "text")
    return fit_toxicity(known, labels)


def op6_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(spark, docs, sf_dir)
    folded = docs.withColumn("held_out", in_fold("doc_id", 5, 0))
    scored = score_toxicity(folded, model, keep_text=False)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(_table(spark, sf_dir, "documents"))


def op8_itq_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixed_counts(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.selectExpr(
        "doc_id", "size", "source_size", "target", "size * copies AS taken", "copies"
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_lines",
        "n_stop_words",
        "n_capitals",
    )


def op11_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_owned_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is an owner, a document its repository; equal texts are one repository."""
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", "source", F.md5("text").alias("repository"))
    return secret_scan(rows, owner="source", repository="repository")


def op13_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 move on by one; ids divisible by 50 are anchors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(vectors, "vec_id % 50 = 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rans_tokens": op1_rans_tokens,
    "op2_cross_parsing": op2_cross_parsing,
    "op3_perspective_rotation": op3_perspective_rotation,
    "op4_vector_best_fit": op4_vector_best_fit,
    "op5_licence_classifier": op5_licence_classifier,
    "op6_subword_toxicity": op6_subword_toxicity,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_itq_near_dups": op8_itq_near_dups,
    "op9_mix_sources": op9_mix_sources,
    "op10_quality_rules": op10_quality_rules,
    "op11_polarised_whitening": op11_polarised_whitening,
    "op12_owned_secrets": op12_owned_secrets,
    "op13_residue_negatives": op13_residue_negatives,
}
