"""Bounded samples of labelled texts, the only rows a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HASH_SPACE = 1 << 30


def labelled_sample(
    docs: DataFrame, labels: DataFrame | None, per_label: int, longest: int
) -> DataFrame:
    """label, text and rank of at most ``per_label`` different texts of each label.

    ``docs`` has doc_id and text, and a label unless ``labels`` (doc_id, label) gives it.
    Null labels, ids and texts, empty texts and texts of more than ``longest`` characters
    are left out. A text stays or goes whole, and equal texts count once, so a group of
    copies cannot fill the sample. The hash decides, so reruns agree. About twice the
    wanted texts pass a threshold on the hash, set from the label's count, before they are
    ranked: the ranking never sees more, however many rows a label has. Ids and hashes move,
    texts do not; the chosen ids, ``per_label`` for each label, are broadcast to them.
    """
    hashed = docs.where(F.length("text").between(1, longest)).withColumn(
        "hash", F.xxhash64("text")
    )
    narrow = hashed.drop("text")
    if labels is not None:
        narrow = narrow.drop("label").join(labels, "doc_id")
    narrow = narrow.where("label IS NOT NULL AND doc_id IS NOT NULL")
    narrow = narrow.select("doc_id", "label", "hash")
    counts = narrow.groupBy("label").count()
    place = F.pmod("hash", F.lit(_HASH_SPACE))
    likely = (
        narrow.join(counts, "label")
        .where(place * F.col("count") < F.lit(2 * per_label * _HASH_SPACE))
        .groupBy("label", "hash")
        .agg(F.min("doc_id").alias("doc_id"))
    )
    order = Window.partitionBy("label").orderBy(place, "hash")
    chosen = likely.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= per_label
    )
    texts = hashed.select("doc_id", "hash", "text")
    found = texts.join(F.broadcast(chosen), ["doc_id", "hash"]).select("label", "text", "rank")
    return found.dropDuplicates(["label", "rank"])


def in_fold(doc_id: str, folds: int, fold: int):
    """True where crc32 of the id as text, modulo ``folds``, is ``fold``; false for null."""
    return F.coalesce(
        F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False)
    )
