"""Token ids of a corpus as coded frames in Parquet, in ascending order of document.

A row is a frame: the documents it holds, how many ids each has, and their ids coded
by ``rans``. Frames stand alone, so any number of tasks read them at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.rans import decode_frame, encode_frame
from tillscope.llm.tokens import ENCODED_BYTES, text_parts, tokens

#: a frame is closed at the first document that ends beyond so many ids
FRAME_IDS = 1 << 21
_FRAME = "part int, seq int, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, data binary"
_DOCUMENT = "part int, seq int, doc_id bigint, ahead bigint, n_tokens bigint, ids_crc32 bigint"


def _schema(text: str) -> pa.Schema:
    kinds = {
        "int": pa.int32(),
        "bigint": pa.int64(),
        "binary": pa.binary(),
        "array<bigint>": pa.list_(pa.int64()),
    }
    return pa.schema([(n, kinds[k]) for n, k in (field.split() for field in text.split(", "))])


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_token_store(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    kind: str = "bytes",
    end_id: int | None = None,
    frame_ids: int = FRAME_IDS,
) -> None:
    """Encode ``docs`` (doc_id, text) and write their frames to ``path``.

    Every row is a document of its own, in ascending order of doc_id, null first, rows
    of one id in order of text. Null and empty texts have no ids of their own;
    ``end_id`` is appended to each document. Other columns are ignored. An empty table
    gives no frames. A task holds one frame of ids and one range of texts at a time; texts move
    once, to their place in the order.
    """
    ending = b"" if end_id is None else np.array([end_id], "<u2").tobytes()
    schema = _schema(_FRAME)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        encode = tokens(vocabulary, kind).encode_all
        ids: list[bytes] = []
        names: list[int | None] = []
        held = 0

        def closed() -> pa.RecordBatch:
            lengths = [len(x) // 2 for x in ids]
            data = encode_frame(np.frombuffer(b"".join(ids), "<u2"))
            row = [part, seq, names[:], lengths, sum(lengths), data]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema
            )

        for batch in batches:
            known = batch.column(0).to_pylist()
            for begin, end, texts in text_parts(batch.column(1), ENCODED_BYTES):
                for name, own in zip(known[begin:end], encode(texts), strict=True):
                    ids.append(own + ending)
                    names.append(name)
                    held += len(ids[-1]) // 2
                    if held >= frame_ids:
                        yield closed()
                        seq += 1
                        ids.clear()
                        names.clear()
                        held = 0
        if ids:
            yield closed()

    ordered = (
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(frames, _FRAME).write.parquet(path)


def read_token_store(frames: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents of a store: doc_id, start, n_tokens, ids_crc32, and ids if asked for.

    ``start`` counts the ids of all documents before it. A damaged frame raises.
    Frames are decoded where they are read; only counts, one row per frame, move.
    """
    kind = _DOCUMENT + (", ids binary" if with_ids else "")
    schema = _schema(kind)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_frame(row["data"])
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                spans = [ids[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(lengths)
                columns = [
                    pa.array([row["part"]] * n, pa.int32()),
                    pa.array([row["seq"]] * n, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(begins),
                    pa.array(lengths),
                    pa.array([ids_crc32(x) for x in spans], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([x.astype("<u4").tobytes() for x in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    sizes = frames.groupBy("part", "seq").agg(F.sum("n_ids").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.join(before, "part").select(
        "part", "seq", (F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("at")
    )
    found = frames.select("part", "seq", "doc_ids", "lengths", "data").mapInArrow(documents, kind)
    ids = ["ids"] if with_ids else []
    return found.join(places, ["part", "seq"]).select(
        "doc_id", (F.col("at") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32", *ids
    )
