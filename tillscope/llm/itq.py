"""Near duplicates of vectors by iterative quantisation and multi-index Hamming tables.

A rotation, learned from a bounded sample, turns each vector into a balanced binary
code. A code is cut into parts, one table per part; vectors whose codes agree in some
part but for one bit, and differ little in all, are compared by their exact cosine.

Codes that agree in a part but for one bit agree in all pieces of the part but one. So a
table deals each vector once for every piece, by the bits of the other pieces, and whoever
may meet is together: pairs are compared where they are found and never leave the task,
which returns a row per vector at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.components import components
from tillscope.llm.store import written

_HASH_SPACE = 1 << 30
#: numbers that a task compares at a time, pairs of codes, and codes that are many for one
_NUMBERS, _PAIRS, _MANY = 1 << 16, 1 << 16, 32


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.95  # vectors link from here on
    sample: int = 10_000  # different vectors of each length that the rotation is learned from
    bits: int = 64  # of a code, no more than a vector has numbers
    tables: int = 4  # parts of a code
    farthest: int = 20  # bits in which the codes of compared vectors may differ
    rounds: int = 30  # of rotation learning
    seed: int = 7
    together: int = 1 << 22  # numbers that a task holds; what exceeds them is met block by block


@dataclass
class Rotation:
    """Vectors of one length to codes: centre, then project and rotate."""

    centre: np.ndarray
    turn: np.ndarray

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as int64, bit i set where component i is positive."""
        ones = ((unit(vectors) - self.centre) @ self.turn) > 0
        weights = np.uint64(1) << np.arange(ones.shape[1], dtype=np.uint64)
        return (ones * weights).sum(1, dtype=np.uint64).view(np.int64)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by the largest number first, so that squares stay finite."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def learn_rotation(vectors: np.ndarray, settings: Settings) -> Rotation:
    """Alternate between signs of the rotated principal components and the rotation
    nearest to them; starts from a seeded random rotation, so reruns agree."""
    bits = min(settings.bits, vectors.shape[1])
    sample = unit(vectors)
    centre = sample.mean(0) if len(sample) > 1 else np.zeros(vectors.shape[1])
    _, axes = np.linalg.eigh((sample - centre).T @ (sample - centre))
    axes = axes[:, ::-1][:, :bits]
    flat = (sample - centre) @ axes
    rng = np.random.default_rng(settings.seed)
    turn, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    for _ in range(settings.rounds):
        left, _, right = np.linalg.svd(flat.T @ np.where(flat @ turn > 0, 1.0, -1.0))
        turn = left @ right
    return Rotation(centre, axes @ turn)


def code_parts(bits: int, tables: int) -> list[tuple[int, int]]:
    """First bit and number of bits of each part; no part is empty."""
    edges = np.linspace(0, bits, min(tables, bits) + 1).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _usable(vector: Column) -> Column:
    """No null, NaN or infinite number, and some number that is not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _sampled(classes: DataFrame, per_length: int) -> DataFrame:
    """At most ``per_length`` vectors of each length, by hash; only ids are ranked, and one
    row of each length says up to where."""
    narrow = classes.select("node", "length")
    counts = narrow.groupBy("length").count()
    place = F.pmod("node", F.lit(_HASH_SPACE))
    likely = narrow.join(counts, "length").where(
        place * F.col("count") < F.lit(2 * per_length * _HASH_SPACE)
    )
    order = Window.partitionBy("length").orderBy(place, "node")
    chosen = likely.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_length)
    spot = F.struct(place.alias("place"), F.col("node").alias("at"))
    last = chosen.groupBy("length").agg(F.max(spot).alias("last"), F.first("count").alias("count"))
    return classes.join(F.broadcast(last), "length").where(spot <= F.col("last")).select(
        "length", "count", place.alias("place"), "node", "vector"
    )


def _matrix(vectors: pa.Array, length: int) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, length).astype(np.float64)


def _models(classes: DataFrame, settings: Settings) -> dict[int, tuple[int, Rotation]]:
    """By length, how many vectors there are and their rotation.

    A rotation is learned in a task; the driver gets its matrix, not the sample.
    """

    def learn(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("place", "ascending"), ("node", "ascending")]).combine_chunks()
        length = key[0].as_py()
        model = learn_rotation(_matrix(group["vector"].combine_chunks(), length), settings)
        return pa.table({
            "length": pa.array([length], pa.int32()),
            "count": group["count"][:1],
            "centre": pa.array([model.centre.tobytes()], pa.binary()),
            "turn": pa.array([np.ascontiguousarray(model.turn).tobytes()], pa.binary()),
        })

    fitted = _sampled(classes, settings.sample).groupBy("length").applyInArrow(
        learn, "length int, count bigint, centre binary, turn binary"
    )
    return {
        r["length"]: (
            r["count"],
            Rotation(np.frombuffer(r["centre"]), np.frombuffer(r["turn"]).reshape(r["length"], -1)),
        )
        for r in fitted.collect()
    }


@dataclass(frozen=True)
class Table:
    """One part of the codes of a length, and the pieces that the part is cut into."""

    before: list[tuple[int, int]]  # parts of earlier tables
    first: int
    pieces: list[tuple[int, int]]  # first bit within the part, and number of bits

    def place(self, codes: np.ndarray, piece: int) -> np.ndarray:
        """The bits of the part outside ``piece``: what those who may meet have in common."""
        kept = (1 << sum(size for _, size in self.pieces)) - 1
        at, size = self.pieces[piece]
        kept ^= ((1 << size) - 1) << at
        return (codes >> np.uint64(self.first)) & np.uint64(kept)


def _tables(length: int, count: int, settings: Settings) -> list[Table]:
    """Parts are cut into two pieces, or as many as keep a place of ``count`` vectors small."""
    parts = code_parts(min(settings.bits, length), settings.tables)
    made = []
    for k, (first, size) in enumerate(parts):
        cut = min(2, size)
        while cut < size and count * length >> (size - -(-size // cut)) > settings.together:
            cut += 1
        made.append(Table(parts[:k], first, code_parts(size, cut)))
    return made


def _bits(codes: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    first, size = part
    return (codes >> np.uint64(first)) & np.uint64((1 << size) - 1)


def _dealt(
    classes: DataFrame,
    models: dict[int, tuple[int, Rotation]],
    numbers: list[int],
    settings: Settings,
    blocks: dict[tuple, int] | None = None,
) -> DataFrame:
    """Vectors of the tables ``numbers`` by length, table, piece and place.

    Without ``blocks`` only the places. With them also the vectors; a place of several blocks
    goes to a task for every two of them, ``low`` and ``high``, of which ``block`` is the row's.
    """
    shared = classes.sparkSession.sparkContext.broadcast((models, blocks))
    schema = "length int, number int, piece int, place bigint"
    if blocks is not None:
        kind = dict(classes.dtypes)["vector"]
        schema += f", low int, high int, block int, node bigint, code bigint, copies bigint, vector {kind}"
    names = [x.split()[0] for x in schema.split(", ")]

    def put(own: pa.RecordBatch, key: tuple, places: np.ndarray, codes: np.ndarray, blocks: dict | None):
        first = [pa.array(np.full(len(own), x, np.int32)) for x in key]
        if blocks is None:
            yield pa.RecordBatch.from_arrays([*first, pa.array(places)], names)
            return
        parts = np.array([blocks.get((*key, p), 1) for p in places.tolist()], np.uint64)
        block = (own["node"].to_numpy().view(np.uint64) % parts).astype(np.int32)
        for other in range(int(parts.max())):
            at = np.flatnonzero(parts > other)
            taken, mine = own.take(pa.array(at)), block[at]
            ends = np.minimum(mine, other), np.maximum(mine, other), mine
            yield pa.RecordBatch.from_arrays(
                [
                    *(x[: len(at)] for x in first),
                    pa.array(places[at]),
                    *(pa.array(x.astype(np.int32)) for x in ends),
                    taken["node"],
                    pa.array(codes[at].view(np.int64)),
                    taken["copies"],
                    taken["vector"],
                ],
                names,
            )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, blocks = shared.value
        for batch in batches:
            for length in pa.compute.unique(batch["length"]).to_pylist():
                count, model = models[length]
                own = batch.filter(pa.compute.equal(batch["length"], length))
                codes = model.codes(_matrix(own["vector"], length)).view(np.uint64)
                for number, table in enumerate(_tables(length, count, settings)):
                    for piece in range(len(table.pieces)) if number in numbers else ():
                        places = table.place(codes, piece).view(np.int64)
                        yield from put(own, (length, number, piece), places, codes, blocks)

    return classes.select("length", "node", "copies", "vector").mapInArrow(emit, schema)


def _crowded(
    classes: DataFrame, models: dict[int, tuple[int, Rotation]], numbers: list[int], settings: Settings
) -> dict[tuple, int]:
    """How many blocks the places take that hold more than a task should."""
    place = ["length", "number", "piece", "place"]
    places = _dealt(classes, models, numbers, settings).groupBy(*place).count()
    most = F.greatest(F.lit(1), F.floor(F.lit(settings.together) / F.col("length")))
    blocks = F.ceil(F.col("count") / most).cast("int").alias("blocks")
    crowded = places.where(F.col("count") > most).select(*place, blocks).collect()
    return {tuple(r)[:4]: r["blocks"] for r in crowded}


def _near(
    local: np.ndarray, codes: np.ndarray, bits: int, equal: bool, farthest: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of spots of the sorted ``local`` whose numbers differ in one bit, or, where
    ``equal``, in none, and whose codes differ in ``farthest`` bits at most; each pair once.

    Rows of one number that ask for many are held against them as a rectangle, the others
    pair by pair, some ``_PAIRS`` at a time.
    """
    for flip in [0] * equal + [1 << i for i in range(bits)]:
        ask = np.arange(len(local)) if flip == 0 else np.flatnonzero(local & flip == 0)
        wanted = local[ask] | flip
        low = ask + 1 if flip == 0 else np.searchsorted(local, wanted)
        high = np.searchsorted(local, wanted, "right")
        starts = np.flatnonzero(np.diff(wanted, prepend=-1))
        stops = np.append(starts[1:], len(ask))
        first = np.searchsorted(local, wanted[starts]) if len(starts) else starts
        wide = (high[starts] - first >= _MANY) & (stops - starts >= 2)
        for k in np.flatnonzero(wide).tolist():
            rows, at, end = ask[starts[k] : stops[k]], int(first[k]), int(high[starts[k]])
            step = max(1, _PAIRS // (end - at))
            for i in range(0, len(rows), step):
                some, own = rows[i : i + step], codes[rows[i : i + step], None]
                begin = at if flip else int(some[0]) + 1
                left, right = np.nonzero(np.bitwise_count(own ^ codes[None, begin:end]) <= farthest)
                if len(left):
                    left, right = some[left], right + begin
                    if not flip:
                        once = left < right
                        left, right = left[once], right[once]
                    yield left, right
        single = np.flatnonzero(np.repeat(~wide, stops - starts))
        ask, low, sizes = ask[single], low[single], (high - low)[single]
        ends = np.cumsum(sizes)
        done = 0
        while done < len(ask):
            before = int(ends[done - 1]) if done else 0
            upto = max(done + 1, int(np.searchsorted(ends, before + _PAIRS, "right")))
            some = sizes[done:upto]
            left = np.repeat(ask[done:upto], some)
            shift = np.repeat(low[done:upto] - (ends[done:upto] - some - before), some)
            right = np.arange(len(left)) + shift
            close = np.bitwise_count(codes[left] ^ codes[right]) <= farthest
            yield left[close], right[close]
            done = upto


def _gathered(
    pairs: Iterator[tuple[np.ndarray, np.ndarray]], least: int = 1 << 13
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, ``least`` and more at a time."""
    held, n = [], 0
    for some in pairs:
        held.append(some)
        n += len(some[0])
        if n >= least:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _join_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Give all that ``left`` and ``right`` link the smallest of their labels, in place;
    a label is the spot of a row that has it as its own."""
    while True:
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


def _links(
    vectors: np.ndarray,
    codes: np.ndarray,
    block: np.ndarray | None,
    table: Table,
    piece: int,
    settings: Settings,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with enough cosine that meet in ``table``, in no earlier one and by ``piece``.

    Rows are of one place; with ``block`` only pairs of different blocks are asked for.
    """
    at, size = table.pieces[piece]
    local = _bits(codes, (table.first + at, size)).astype(np.int64)
    order = np.argsort(local, kind="stable")
    codes, vectors = codes[order], unit(vectors[order])
    block = None if block is None else block[order]
    head = vectors[:, :16].astype(np.float32)
    widest = 2 - 2 * settings.cosine + 1e-5  # square of a distance; if a part exceeds it, the whole does
    step = max(1, _NUMBERS // vectors.shape[1])
    near = _near(local[order], codes, size, piece == 0, settings.farthest)
    for left, right in _gathered(near):
        met = np.ones(len(left), bool)
        if block is not None:
            met &= block[left] != block[right]
        for part in table.before:
            met &= np.bitwise_count(_bits(codes[left] ^ codes[right], part)) > 1
        left, right = left[met], right[met]
        for i in range(0, len(left), 1 << 12):
            a, b = left[i : i + (1 << 12)], right[i : i + (1 << 12)]
            gap = head.take(a, 0) - head.take(b, 0)
            likely = np.einsum("ij,ij->i", gap, gap) <= widest
            a, b = a[likely], b[likely]
            for j in range(0, len(a), step):
                one, two = a[j : j + step], b[j : j + step]
                close = (vectors[one] * vectors[two]).sum(1) >= settings.cosine
                if close.any():
                    yield order[one[close]], order[two[close]]


def _compared(
    dealt: DataFrame, models: dict[int, tuple[int, Rotation]], settings: Settings
) -> DataFrame:
    """node, root and n of every vector that links with one of its place: the smallest node
    its links there lead to, and how many vectors those linked directly stand for."""
    counts = {length: count for length, (count, _) in models.items()}

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        length, number, piece, _, low, high = (x.as_py() for x in key)
        table = _tables(length, counts[length], settings)[number]
        order = np.argsort(group["node"].to_numpy())
        node, copies, block = (group[x].to_numpy()[order] for x in ("node", "copies", "block"))
        labels, n = np.arange(len(node)), np.zeros(len(node), np.int64)
        if len(node) > 1:
            codes = group["code"].to_numpy()[order].view(np.uint64)
            vectors = _matrix(group["vector"].combine_chunks(), length)[order]
            block = None if low == high else block
            for left, right in _links(vectors, codes, block, table, piece, settings):
                np.add.at(n, left, copies[right])
                np.add.at(n, right, copies[left])
                _join_labels(labels, left, right)
        linked = n > 0
        return pa.table({"node": node[linked], "root": node[labels[linked]], "n": n[linked]})

    places = dealt.groupBy("length", "number", "piece", "place", "low", "high")
    return places.applyInArrow(compare, "node bigint, root bigint, n bigint")


def itq_near_duplicates(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    settings: Settings | None = None,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``.

    Two rows link when the cosine of their vectors, in double precision, is at least
    ``settings.cosine`` and the tables let them meet: codes that agree in one part but for
    one bit. No pair below links. n_links counts the other rows linked directly,
    component_id is the smallest vec_id that links lead to, kept says it is the row's own.

    Vectors that are null, empty or zero, or hold a null or non-finite number, link with
    nothing; vectors of different lengths do not link. Equal vectors are one class that
    links within itself and is compared once, however many there are. A null vec_id gives a
    null component, kept false and no links; rows that share a vec_id are rows of their own.
    Other columns are dropped; an empty table gives an empty one. Each rotation is fitted in
    a task from ``settings.sample`` vectors of its length; every vector is indexed. The driver
    gets a rotation of each length, and a row for each place that more than a task holds.
    """
    settings = settings or Settings()
    given = F.col(f"`{embedding}`")
    kind = "float" if dict(vectors.select(given.alias("x")).dtypes)["x"] == "array<float>" else "double"
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"),
        given.cast(f"array<{kind}>").alias("vector"),
    )
    able = F.col("vec_id").isNotNull() & _usable(F.col("vector"))
    # adding 0.0 makes one zero of the two
    plain = F.when(able, F.transform("vector", lambda x: x + F.lit(0.0).cast(kind)))
    name = F.xxhash64(F.col("vector").cast("array<double>"))
    rows = rows.withColumn("vector", plain).withColumn(
        "node", F.when(F.col("vector").isNotNull(), name)
    )
    classes = written(
        rows.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min("vec_id").alias("vec_id"),
            F.count("*").alias("copies"),
            F.any_value("vector").alias("vector"),
        )
        .withColumn("length", F.size("vector")),
        "itq-classes",
    )
    models = _models(classes, settings)
    ids = rows.select("vec_id", "node")
    if not models:
        return _result(ids.withColumn("component", F.lit(None).cast("bigint")).withColumn(
            "n_links", F.lit(0).cast("bigint")))
    numbers = list(range(max(len(_tables(n, count, settings)) for n, (count, _) in models.items())))
    blocks = _crowded(classes, models, numbers, settings)
    found = None
    for number in numbers:  # one after the other: of one at a time the vectors lie on disk
        dealt = _dealt(classes, models, [number], settings, blocks)
        own = written(_compared(dealt, models, settings), "itq-links")
        found = own if found is None else found.union(own)
    others = found.groupBy("node").agg(F.sum("n").alias("others"))
    links = found.select(F.col("node").alias("u"), F.col("root").alias("v"))
    joined = components(links)
    least = classes.select("node", "vec_id")
    names = joined.join(least, "node").groupBy("component").agg(F.min("vec_id").alias("least"))
    named = joined.join(names, "component").select("node", F.col("least").alias("component"))
    known = (
        classes.select("node", "vec_id", "copies")
        .join(others, "node", "left")
        .join(named, "node", "left")
        .select(
            "node",
            F.coalesce("component", "vec_id").alias("component"),
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        )
    )
    return _result(ids.join(known, "node", "left"))


def _result(rows: DataFrame) -> DataFrame:
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return rows.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
