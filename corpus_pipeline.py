"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage takes the documents that the one before kept, written and read again. All
but the last return the columns of ``documents`` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.llm.jaccard import ngram_jaccard
from tillscope.llm.mixing import mix_sources
from tillscope.llm.quality_rules import quality_rules
from tillscope.llm.queries import packed_documents, toxicity_model
from tillscope.llm.store import written
from tillscope.llm.toxicity import score_toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: the columns that stages read; all others are kept under another name meanwhile
_READ = ("doc_id", "text", "source")


def _aside(docs: DataFrame) -> DataFrame:
    """``docs`` whose other columns cannot clash with what an operator adds."""
    return docs.toDF(*(c if c in _READ else f"__own_{c}" for c in docs.columns))


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    names = [(c if c in _READ else f"__own_{c}", c) for c in docs.columns]
    return found.select(*(F.col(f"`{hidden}`").alias(name) for hidden, name in names))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier calls toxic; it learns from the labels of these documents."""
    scored = score_toxicity(_aside(docs), toxicity_model(spark, docs, sf_dir))
    return _back(scored.where("predicted = 0"), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what a quality rule rejects."""
    return _back(quality_rules(_aside(docs)).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group, and one of repeated rows.

    Documents without words are in no group. Rows with a null doc_id are kept.
    """
    named = written(ngram_jaccard(docs), "pipeline-groups")
    firsts = named.where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    hidden = _aside(docs)
    kept = hidden.join(firsts.hint("shuffle_hash"), F.col("doc_id").cast("bigint") == F.col("__kept"))
    turn = F.row_number().over(Window.partitionBy("__kept").orderBy(F.xxhash64("text"), "text"))
    single = kept.withColumn("__turn", turn).where("__turn = 1")
    return _back(single, docs).unionByName(docs.where("doc_id IS NULL"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents until the sources meet their target weights."""
    return _back(mix_sources(_aside(docs)), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: the first stage is a trained model and the last a packing, which SQL cannot state
ORACLE_SQL = None
