"""Hard negatives of anchors by exact scores from a residue number system.

Vectors are whole numbers. Their products are taken modulo a few small primes, one float32
matrix product each: residues are so small that no sum leaves the whole numbers float32
holds. The Chinese remainder theorem gives back the exact signed scores.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.store import written

#: whole numbers below this are exact in float32
_FLOAT32_WHOLE = 1 << 24
#: dimensions multiplied before residues are taken again
_DEPTH = 1024
#: squared lengths from here on could give scores beyond BIGINT
_LONGEST = float(1 << 60)


@dataclass(frozen=True)
class Settings:
    scale: int = 256  # a number x becomes floor(scale * x)
    positives: int = 5  # best rows of the anchor's label
    negatives: int = 3  # best rows of other labels in the window
    least_percent: int = 50  # of the positive's score
    most_percent: int = 95
    anchors_per_block: int = 4096
    rows_per_block: int = 8192


def primes_for(bound: int, depth: int) -> list[int]:
    """Largest primes first, until their product tells all of -bound..bound apart.

    ``depth`` products of balanced residues of each prime stay exact in float32.
    """
    half = int(np.sqrt((_FLOAT32_WHOLE - 1) / max(1, min(depth, _DEPTH))))
    largest = 2 * half + 1
    sieve = np.ones(largest + 1, bool)
    sieve[:2] = False
    for p in range(2, int(largest**0.5) + 1):
        sieve[p * p :: p] &= ~sieve[p]
    found, product = [], 1
    for p in reversed(np.flatnonzero(sieve).tolist()):
        if product > 2 * bound:
            break
        found.append(p)
        product *= p
    if product <= 2 * bound:
        raise OverflowError(f"no primes below {largest} hold scores up to {bound}")
    return found


def _balanced(values: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p-1)/2 to (p-1)/2; of 2, from 0 to 1."""
    half = (p - 1) // 2
    return (values + half) % p - half


def residue_product(left: np.ndarray, right: np.ndarray, p: int) -> np.ndarray:
    """left @ right.T modulo p, as balanced residues."""
    total = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, left.shape[1], _DEPTH):
        a = _balanced(left[:, at : at + _DEPTH], p).astype(np.float32)
        b = _balanced(right[:, at : at + _DEPTH], p).astype(np.float32)
        total = _balanced(total + (a @ b.T).astype(np.int64), p)
    return total


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, every row of ``left`` with every one of ``right``.

    No product exceeds the longest of both sides multiplied; so many primes are taken. Digits
    in mixed radix, each balanced, add up to the signed score.
    """

    def longest(side: np.ndarray) -> float:
        return float(np.sqrt((side.astype(np.float64) ** 2).sum(1).max(initial=0)))

    bound = int(longest(left) * longest(right) * (1 + 1e-9)) + 1
    score, radix = np.zeros((len(left), len(right)), np.int64), 1
    for p in primes_for(bound, left.shape[1]):
        away = residue_product(left, right, p) - score % p
        score += _balanced(away * pow(radix, -1, p), p) * radix
        radix *= p
    return score


def _share(percent: int, score: np.ndarray) -> np.ndarray:
    """floor(percent * score / 100) without leaving BIGINT."""
    return percent * (score // 100) + percent * (score % 100) // 100


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    labels = table.column("label").to_numpy()
    numbers = table.column("numbers").combine_chunks().flatten().to_numpy()
    return ids, labels, numbers.astype(np.int64).reshape(len(ids), -1)


#: scores held at once in a task
_CELLS = 1 << 21


def _first(owner: np.ndarray, most: int) -> np.ndarray:
    """True for the first ``most`` entries of each run of equal owners."""
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    place = np.arange(len(owner)) - np.repeat(starts, np.diff([*starts, len(owner)]))
    return place < most


def _best_positives(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Per anchor of a cell, the ``most`` best rows of its label; equal scores by id."""

    def pick(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if len(anchors) and len(rows):
            ids, labels, numbers = _vectors(anchors)
            others, other_labels, other_numbers = _vectors(rows)
            step = max(1, _CELLS // len(others))
            for at in range(0, len(ids), step):
                part = slice(at, at + step)
                score = exact_scores(numbers[part], other_numbers)
                same = (labels[part, None] == other_labels) & (ids[part, None] != others)
                low = np.where(same, score, np.iinfo(np.int64).min)
                k = max(0, len(others) - most)
                edge = np.partition(low, k, axis=1)[:, k : k + 1]
                i, j = np.nonzero(same & (low >= edge))
                order = np.lexsort((others[j], -score[i, j], i))
                i, j = i[order], j[order]
                if len(i):
                    kept = _first(i, most)
                    i, j = i[kept], j[kept]
                    found.append((ids[part][i], others[j], score[i, j]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(
            dict(zip(("anchor_id", "positive_id", "positive_score"), columns, strict=True))
        )

    return pick


_NEGATIVES = "anchor_id bigint, positive_id bigint, positive_score bigint, " \
    "negative_id bigint, negative_score bigint"


def _best_negatives(settings: Settings) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Per anchor and positive of a cell, the best rows of other labels in the window."""
    most = settings.negatives

    def pick(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, int, int]] = []
        if len(anchors) and len(rows):
            ids, labels, numbers = _vectors(anchors)
            others, other_labels, other_numbers = _vectors(rows)
            positives = anchors.column("positives").to_pylist()
            scores = [np.array([p["positive_score"] for p in own], np.int64) for own in positives]
            # the score of a negative lies from floor to ceiling of the window, both included
            least = [-_share(settings.least_percent, -s) for s in scores]
            greatest = [_share(settings.most_percent, s) for s in scores]
            low = np.array([x.min() for x in least])
            high = np.array([x.max() for x in greatest])
            step = max(1, _CELLS // len(others))
            for at in range(0, len(ids), step):
                part = slice(at, at + step)
                score = exact_scores(numbers[part], other_numbers)
                fits = (score >= low[part, None]) & (score <= high[part, None])
                i, j = np.nonzero(fits & (labels[part, None] != other_labels))
                order = np.lexsort((others[j], -score[i, j], i))
                i, j = i[order], j[order]
                falling = -score[i, j]
                ends = np.searchsorted(i, np.arange(len(score) + 1))
                for a in range(len(score)):
                    own = falling[ends[a] : ends[a + 1]]
                    spots = np.searchsorted(own, -greatest[at + a])
                    for p, spot in enumerate(spots.tolist()):
                        one = positives[at + a][p]
                        for value in range(spot, min(spot + most, len(own))):
                            if -own[value] < least[at + a][p]:
                                break
                            row = others[j[ends[a] + value]]
                            found.append(
                                (ids[at + a], one["positive_id"], one["positive_score"],
                                 row, -own[value])
                            )
        columns = list(zip(*found, strict=True)) if found else [()] * 5
        names = [part.split()[0] for part in _NEGATIVES.split(", ")]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

    return pick


def whole_rows(vectors: DataFrame, settings: Settings) -> DataFrame:
    """vec_id, label and numbers of the rows that take part, one row per vec_id.

    ``vectors`` has vec_id, label and embedding. Rows that share an id count as the one with
    the smallest label, then vector.
    """
    x = F.col("vector")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= _LONGEST))
    whole = F.transform(x, lambda c: F.floor(c * settings.scale).cast("double"))
    squared = F.aggregate(F.col("whole"), F.lit(0.0), lambda a, c: a + c * c)
    rows = (
        vectors.select(
            F.col("vec_id").cast("bigint").alias("vec_id"),
            F.col("label").cast("bigint").alias("label"),
            F.col("embedding").cast("array<double>").alias("vector"),
        )
        .where("vec_id IS NOT NULL AND label IS NOT NULL")
        .where((F.size("vector") > 0) & ~bad)
        .select("vec_id", "label", whole.alias("whole"))
        .where(squared < _LONGEST)
        .select("vec_id", F.struct("label", F.col("whole").cast("array<int>").alias("whole")).alias("row"))
    )
    single = rows.groupBy("vec_id").agg(F.min("row").alias("row"))
    return single.select(
        "vec_id", F.col("row.label").alias("label"), F.col("row.whole").alias("numbers")
    )


def _blocks(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def _cells(
    anchors: DataFrame,
    rows: DataFrame,
    blocks: tuple[int, int],
    pick: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
) -> DataFrame:
    """``pick`` of every block of anchors with every block of rows of the same length.

    A cell is one group of a cogroup: it holds one block of each side, bounded by the block
    sizes, and can be run again anywhere.
    """

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        place = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
        return df.withColumn("length", F.size("numbers")).withColumns(
            {own: place, other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))}
        )

    n, m = blocks
    keys = ("length", "anchor_block", "row_block")
    left = dealt(anchors, "anchor_block", n, "row_block", m)
    right = dealt(rows, "row_block", m, "anchor_block", n)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pick, schema)


def hard_negatives(
    vectors: DataFrame, anchor: Column | str, settings: Settings | None = None
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``vectors`` has vec_id, label and embedding; ``anchor`` is a condition on vec_id and label.
    A row's score is the inner product with the anchor of whole numbers floor(scale * x); higher
    scores come first, equal ones by smaller vec_id. An anchor's positives are its best other
    rows of the same label. For each of them the best rows of other labels are returned whose
    score lies between ``least_percent`` and ``most_percent`` of the positive's, ranked from 1.

    No part take rows with a null id, label or vector, with a null or non-finite number, with
    an empty vector, or so long that scores could leave BIGINT (squared length from 2^60).
    Vectors of different lengths do not meet. Rows that share an id count once, as the one with
    the smallest label, then vector. An anchor without other rows of its label, or without
    any in the window, returns nothing. Other columns are dropped; an empty table gives an
    empty result.

    Blocks of anchors meet blocks of rows, in cells of bounded size; each sends on the best few
    of an anchor (or of an anchor and positive), which a window ranks over all cells. The
    work is anchors times rows, as asked for; no block or score is left out.
    """
    settings = settings or Settings()
    rows = written(whole_rows(vectors, settings), "negatives-rows")
    anchors = rows.where(anchor)
    blocks = (
        _blocks(anchors.count(), settings.anchors_per_block),
        _blocks(rows.count(), settings.rows_per_block),
    )
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = (
        _cells(
            anchors, rows, blocks, _best_positives(settings.positives),
            "anchor_id bigint, positive_id bigint, positive_score bigint",
        )
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= settings.positives)
        .groupBy(F.col("anchor_id").alias("vec_id"))
        .agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    )
    asked = written(anchors.join(positives, "vec_id"), "negatives-asked")
    hardest = Window.partitionBy("anchor_id", "positive_id").orderBy(
        F.desc("negative_score"), "negative_id"
    )
    return (
        _cells(asked, rows, blocks, _best_negatives(settings), _NEGATIVES)
        .withColumn("rank", F.row_number().over(hardest))
        .where(F.col("rank") <= settings.negatives)
        .select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
        )
    )
