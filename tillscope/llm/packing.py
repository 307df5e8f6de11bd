"""Best-fit packing of token pieces under several capacities at once.

A sequence has room for tokens, documents and attention cost (the sum of squared
lengths). Pieces of one length are alike in all three, so packing works on the counts
per length: classes of equal sequences instead of single ones. The counts have one row
per length, at most as many as a sequence has tokens, however many documents there are;
which document takes which place is then decided where the documents are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tillscope.llm.store import written
from tillscope.llm.tokens import ENCODED_BYTES, text_parts, tokens

_PIECE = "doc_id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most, and how much each residual counts.

    The defaults for documents and attention can never be exceeded before the tokens
    are, so the tokens alone decide how many sequences there are.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"  # smallest residual norm, or "dot": largest dot-product

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.float64)


@dataclass
class _Open:
    """So many sequences that all hold the same lengths."""

    count: int
    residual: np.ndarray
    held: list[tuple[int, int]]  # length, how often


def plan_sequences(counts: dict[int, int], capacity: Capacity) -> list[tuple[int, list]]:
    """Classes of sequences, (how many, [(length, how often)]), for ``counts`` of lengths.

    Longest first; each length goes to the open class that fits it best by the rule
    over the weighted, normalised residuals, and a class is filled with as many of
    them as every capacity allows. What fits nowhere opens new sequences. A piece that
    exceeds a capacity by itself is refused.
    """
    full, weights = capacity.vector(), np.array(capacity.weights)
    opened: list[_Open] = []
    closed: list[_Open] = []
    crowded = 64  # classes at which alike ones are merged and full ones put aside
    for length in sorted(counts, reverse=True):
        item = np.array([length, 1, length * length], np.float64)
        if (item > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        left = counts[length]
        residuals = np.array([x.residual for x in opened]).reshape(-1, 3)
        while left:
            fits = (residuals >= item).all(1) if len(opened) else np.zeros(0, bool)
            if fits.any():
                if capacity.rule == "dot":
                    score = -((residuals / full) * (item / full) * weights).sum(1)
                else:
                    score = ((((residuals - item) / full) ** 2) * weights).sum(1)
                best = int(np.argmin(np.where(fits, score, np.inf)))
                taken = opened[best]
            else:
                taken = _Open(max(1, left // int((full // item).min())), full.copy(), [])
                opened.append(taken)
                residuals = np.vstack([residuals, full])
                best = len(opened) - 1
            each = int((taken.residual // item).min())
            if taken.count * each <= left:
                used, rest = taken.count, None
            elif left >= each:  # some sequences of the class get all they can hold
                used, rest = left // each, taken.count - left // each
            else:
                each, used, rest = left, 1, taken.count - 1
            if rest:
                opened.append(_Open(rest, taken.residual.copy(), list(taken.held)))
                residuals = np.vstack([residuals, taken.residual])
            taken.count = used
            taken.residual = taken.residual - each * item
            taken.held = [*taken.held, (length, each)]
            residuals[best] = taken.residual
            left -= used * each
        if len(opened) >= crowded:
            opened = _merged(opened)
            closed += [x for x in opened if (x.residual < 1).any()]
            opened = [x for x in opened if (x.residual >= 1).all()]
            crowded = 64 + len(opened) * 5 // 4
    return [(x.count, x.held) for x in closed + opened]


def _merged(opened: list[_Open]) -> list[_Open]:
    """One class for sequences that hold the same; it keeps the list short."""
    found: dict[tuple, _Open] = {}
    for x in opened:
        key = tuple(x.held)
        if key in found:
            found[key].count += x.count
        else:
            found[key] = x
    return list(found.values())


@dataclass
class Places:
    """Where the pieces of each length go, by their rank among that length.

    Ranks from ``first`` on, ``rank - first`` sequences after ``sequence``, at ``offset``;
    sorted by length and first rank. Its size follows the classes, not the documents.
    """

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def places(plan: list[tuple[int, list]]) -> Places:
    rows, given, sequence = [], {}, 0
    for count, held in plan:
        offset = 0
        for length, often in held:
            for _ in range(often):
                rows.append((length, given.get(length, 0), sequence, offset))
                given[length] = given.get(length, 0) + count
                offset += length
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Places(*table.T)


def token_pieces(
    docs: DataFrame, vocabulary: str, kind: str, end_id: int | None, most: int
) -> DataFrame:
    """Whole documents as pieces of at most ``most`` tokens: doc_id, piece, start, length,
    ids_crc32. A null or empty text has the end id alone, or no piece without one."""
    ending = b"" if end_id is None else np.array([end_id], "<u2").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(vocabulary, kind).encode_all
        for batch in batches:
            known = batch.column(0).to_pylist()
            rows: list[list[int | None]] = [[], [], [], [], []]
            for begin, end, texts in text_parts(batch.column(1), ENCODED_BYTES):
                for name, own_ids in zip(known[begin:end], encode(texts), strict=True):
                    ids = np.frombuffer(own_ids + ending, "<u2")
                    for piece, start in enumerate(range(0, len(ids), most)):
                        own = ids[start : start + most]
                        crc = zlib.crc32(own.astype("<u4").tobytes())
                        values = (name, piece, start, len(own), crc)
                        for column, value in zip(rows, values, strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, pa.int64()) for column in rows],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return source.mapInArrow(pieces, _PIECE)


def best_fit_pack(pieces: DataFrame, capacity: Capacity | None = None) -> DataFrame:
    """``pieces`` (a column length, 1 to the capacity of tokens) with sequence_id and offset.

    Sequences are numbered from 0 and filled without gaps from offset 0, under every
    capacity. All pieces are packed; equal rows get places of their own, an empty table
    gives an empty one. Other columns pass through; columns named sequence_id or offset
    are replaced. The pieces are written once, numbered per task and length; then only
    counts per task and length move. What goes through the driver is one count per
    length, and what is broadcast is the plan, whose size depends on the lengths.
    """
    capacity = capacity or Capacity()
    mine = ("sequence_id", "offset", "__task", "__turn")
    columns = [c for c in pieces.columns if c not in mine]
    whole = pieces.withColumn("length", F.col("length").cast("bigint"))
    numbered = _numbered(whole.select(*(f"`{c}`" for c in columns)))
    table = written(numbered, "packing-pieces")
    counts = table.groupBy("__task", "length").agg(F.count("*").alias("n"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    plan = plan_sequences({r["length"]: r["n"] for r in totals}, capacity)
    earlier = Window.partitionBy("length").orderBy("__task")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        "__task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before")
    )
    ranked = table.join(before, ["__task", "length"]).withColumn(
        "__rank", F.col("__before") + F.col("__turn")
    )
    return _placed(ranked, columns, places(plan))


def _numbered(pieces: DataFrame) -> DataFrame:
    """Adds the task and the turn of each row among the task's rows of its length."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_numpy()
            turns = np.empty(len(lengths), np.int64)
            for i, length in enumerate(lengths.tolist()):
                turns[i] = seen.get(length, 0)
                seen[length] = turns[i] + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(turns), task)), pa.array(turns)],
                names=[*batch.schema.names, "__task", "__turn"],
            )

    schema = _with_longs(pieces.schema, "__task", "__turn")
    return pieces.mapInArrow(number, schema)


def _with_longs(schema: StructType, *names: str) -> StructType:
    return StructType([*schema.fields, *(StructField(name, LongType()) for name in names)])


def _placed(ranked: DataFrame, columns: list[str], table: Places) -> DataFrame:
    shared = ranked.sparkSession.sparkContext.broadcast(table)
    width = int(table.first.max()) + 2 if len(table.first) else 2
    chosen = ranked.select(*(f"`{c}`" for c in columns), "__rank")
    schema = _with_longs(chosen.drop("__rank").schema, "sequence_id", "offset")
    at_length = columns.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = t.length * width + t.first
        for batch in batches:
            rank = batch.column(len(columns)).to_numpy()
            wanted = batch.column(at_length).to_numpy() * width + np.minimum(rank, width - 1)
            at = np.searchsorted(keys, wanted, side="right") - 1
            found = [t.sequence[at] + rank - t.first[at], t.offset[at]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *map(pa.array, found)],
                names=[*columns, "sequence_id", "offset"],
            )

    return chosen.mapInArrow(place, schema)
