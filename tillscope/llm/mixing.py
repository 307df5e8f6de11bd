"""Mix sources to target weights by repeating whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.store import written
from tillscope.llm.words import word_count

#: weights dealt to the sources in code point order, null last, over and over
WEIGHTS = (5, 2, 1)
#: the mix holds this many percent of all words
SHARE_PERCENT = 150
#: no source is repeated more often than this
MOST_REPEATS = 2
_HASH_SPACE = 1 << 52


def source_targets(
    sized: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most_repeats: int = MOST_REPEATS,
) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    ``sized`` has columns source and size. Targets share ``share_percent`` of all
    words by weight; a target stops at ``most_repeats`` times its source's size and
    the excess is shared again by weight. In order of size per weight the sources
    that stop come first, so running sums over one row per source find the level.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    dealt = totals.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place).cast("bigint"))
    cap = F.col("source_size") * most_repeats
    by_level = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # whole numbers up to the one division: hundredths of a word
    left = F.sum("source_size").over(everything) * share_percent - 100 * F.coalesce(
        F.sum(cap).over(before), F.lit(0)
    )
    level = left.cast("double") / (100 * F.sum("weight").over(onward)).cast("double")
    stops = dealt.withColumn("level", level).withColumn(
        "stops", F.col("level") * F.col("weight") >= cap
    )
    stops = stops.withColumn("rank", F.row_number().over(by_level))
    common = F.min(F.when(~F.col("stops"), F.struct("rank", "level")))
    water = common.over(Window.partitionBy()).getField("level")
    target = F.when(F.col("stops"), cap.cast("double")).otherwise(water * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
    return (
        stops.withColumn("target", target)
        .withColumn("rate", F.coalesce(rate, F.lit(0.0)))
        .select("source", "source_size", "target", "rate")
    )


def _chance(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the id alone, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(_HASH_SPACE))


def mixed_counts(docs: DataFrame, seed: str = "mix", **shares) -> DataFrame:
    """``docs`` with size, source_size, target and copies, one row per input row.

    size: words of the text, 0 if null. copies: the whole part of the source's
    repetition rate plus one with the probability of the fraction, drawn from the
    hash of seed and doc_id; so rows that repeat an id are drawn alike, null ids too.
    A null source is a source. Sources without words get target 0 and no copies.
    Columns of these names are replaced, others pass through. The sums per source
    are added up before they move, and the table of sources is written first, so that its
    size is known when the join is planned: the documents move only if it is too large to
    broadcast.
    """
    mine = ("size", "source_size", "target", "rate", "copies")
    sized = docs.drop(*mine).withColumn("size", word_count(F.col("text")))
    targets = written(source_targets(sized.select("source", "size"), **shares), "mix-targets")
    targets = targets.withColumnRenamed("source", "__mix_source")
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["__mix_source"]), "left")
    whole = F.floor("rate")
    extra = (_chance(F.col("doc_id"), seed) < F.col("rate") - whole).cast("int")
    return joined.withColumn("copies", (whole + extra).cast("int")).drop("__mix_source", "rate")


def mix_sources(docs: DataFrame, seed: str = "mix", **shares) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, same columns."""
    counted = mixed_counts(docs, seed, **shares)
    mixed = counted.withColumn("__mix_copy", F.explode(F.expr("array_repeat(0, copies)")))
    return mixed.select(*(F.col(f"`{name}`") for name in docs.columns))
