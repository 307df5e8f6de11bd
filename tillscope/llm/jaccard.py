"""Jaccard join of documents on word shingles, by a blocked sparse matrix product.

The matrix has a row per different shingle set and a column per shingle. Its product
with its own transpose holds the overlaps. Only columns that can matter are multiplied:
of a set of n, any n - o + 1 shingles in an order shared by all sets hold one of every
o it shares with another, so rare shingles come first and each set keeps just the start
of its list. Entries of the product are counted per block of columns and dropped when
size and count show that the full overlap cannot reach the bound; the rest are counted
on the whole sets.

Components need no product entry inside a component. So blocks are first multiplied
with one leader row each. Blocks that then still hold several components are gathered by
their largest one, so that sets which share a hundred shingles meet once and not a hundred
times, and are multiplied in tiles of bounded size on incidence rows folded to a few bits
a shingle, which bound every overlap from above. What passes is counted on the whole sets:
first, of each tile, a spanning forest of the closest pairs of two components, fewer than
the tile has rows; in the end all pairs of components that are still apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.components import members, settled
from tillscope.llm.shingles import mixed, set_key, shingle_sets
from tillscope.llm.store import written
from tillscope.llm.tokens import text_parts
from tillscope.llm.workers import give_back, turn_to

#: two sets link when 100 * overlap >= PERCENT * union
PERCENT = 75
#: sets of up to SMALL_MOST shingles are indexed on all of them, sets of more than
#: SMALL_LEAST on the LOW share with the smallest hashes; a pair that can link has both
#: its sets in one of the two indexes
SMALL_MOST, SMALL_LEAST = 96, 72
LOW = 0.4
_LOW_BOUND = int(LOW * (1 << 64)) - (1 << 63)
#: rows of a task looked at together for shingles so frequent that they are dealt out
_ROWS = 1 << 17
_SALTS = 64
#: sets on either side of a tile
TILE = 1024
#: bits of a set's bitmap a shingle, and the fewest and most, powers of two; see _bitmap
_BITS, _FEWEST_BITS, _MOST_BITS = 4, 512, 1 << 16
#: pairs whose bitmaps are compared at once
_COMPARED = 1 << 15

_SIGNATURE = "doc_id bigint, n_shingles bigint, node bigint"
_POSTING = "shingle bigint, salt int, node bigint, sizes bigint"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and shingle sets of a few documents at a time."""
    turn_to("jaccard")
    for batch in batches:
        names = batch.column(0).to_pylist()
        for a, b, texts in text_parts(batch.column(1)):
            yield names[a:b], shingle_sets(texts)
        give_back()  # the worker lives on beside the next stage


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for names, sets in _documents(batches):
        columns = [names, [len(s) for s in sets], [set_key(s) if len(s) else None for s in sets]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n_shingles", "node"]
        )


def prefix_length(n: int, percent: int) -> int:
    """How many of n shingles, first in the order, meet every set that can link."""
    return n - -(-n * percent // 100) + 1


def _postings(percent: int):
    def indexed(own: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """Shingles of each index the set is in, the index in the lowest bit, and their number below the bound."""
        n = len(own)
        if n <= SMALL_MOST:
            yield (own & ~np.int64(1)) | np.int64(1), n
        if n > SMALL_LEAST:
            low = int(np.searchsorted(own, _LOW_BOUND))
            yield own[: max(low, prefix_length(n, percent))] & ~np.int64(1), low

    def dealt(shingles: list, nodes: list, sizes: list, held: int) -> Iterator[pa.RecordBatch]:
        counts = [len(s) for s in shingles]
        shingle = np.concatenate(shingles)
        node = np.repeat(np.array(nodes, np.int64), counts)
        size = np.repeat(np.array(sizes, np.int64), counts)
        found, where, often = np.unique(shingle, return_inverse=True, return_counts=True)
        hot = often >= max(16, held // 256)
        turn = (mixed(node.view(np.uint64)) % np.uint64(_SALTS)).astype(np.int32) + 1
        salt = np.where(hot[where], turn, 0).astype(np.int32)
        marks = found[hot]  # tell the rows that other tasks did not deal out
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([shingle, marks])),
                pa.array(np.concatenate([salt, np.zeros(len(marks), np.int32)])),
                pa.concat_arrays([pa.array(node), pa.nulls(len(marks), pa.int64())]),
                pa.array(np.concatenate([size, np.zeros(len(marks), np.int64)])),
            ],
            names=["shingle", "salt", "node", "sizes"],
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within the task
        shingles, nodes, sizes, rows = [], [], [], 0
        for names, sets in _documents(batches):
            for name, own in zip(names, sets, strict=True):
                if name is None or not len(own):
                    continue
                key = set_key(own)
                if key in seen:
                    continue
                seen.add(key)
                for part, low in indexed(own):
                    shingles.append(part)
                    nodes.append(key)
                    sizes.append((len(own) << 32) | low)
                    rows += len(part)
            if rows >= _ROWS:
                yield from dealt(shingles, nodes, sizes, len(nodes))
                shingles, nodes, sizes, rows = [], [], [], 0
        if rows:
            yield from dealt(shingles, nodes, sizes, len(nodes))

    return emit


def _index(docs: DataFrame, percent: int) -> DataFrame:
    """shingle, node, n: the start of each set's list, where another set may have it too.

    The order is: shingles below the bound by how many sets have them, then the others by
    hash. What only one set has, in however many copies, comes first and is counted, not
    kept. Frequent shingles are dealt over many tasks; they come last, by hash. Copies leave
    before the rows are dealt anew, once, by set.
    """
    postings = docs.mapInArrow(_postings(percent), _POSTING)
    block = Window.partitionBy("shingle", "salt")
    shared = (
        postings.withColumn("often", F.count("*").over(block))
        .withColumn("marked", F.max(F.col("node").isNull()).over(block))
        .withColumn("several", F.min("node").over(block) < F.max("node").over(block))
        .where("node IS NOT NULL AND (salt > 0 OR marked OR several)")
        .select(
            "shingle",
            "salt",
            "node",
            "sizes",
            F.when((F.col("salt") > 0) | F.col("marked"), F.lit(1 << 62))
            .otherwise(F.col("often"))
            .alias("often"),
        )
        .distinct()
        .drop("salt")
        .repartition("node")
    )
    index = F.col("shingle").bitwiseAND(1)
    below = (index == 1) | (F.col("shingle") < F.lit(_LOW_BOUND))
    own = Window.partitionBy("node", "index")
    n, low = F.shiftright("sizes", 32), F.col("sizes").bitwiseAND((1 << 32) - 1)
    start = n - F.ceil(n * percent / 100) + 1
    ranked = (
        shared.withColumn("index", index.cast("int"))
        .groupBy("node", "index", "shingle")
        .agg(F.max("often").alias("often"), F.max("sizes").alias("sizes"))
        .withColumn("below", below)
        .withColumn("alone", low - F.sum(F.col("below").cast("bigint")).over(own))
        .withColumn(
            "place",
            F.row_number().over(own.orderBy(F.col("below").desc(), "often", "shingle")),
        )
        .where(~F.col("below") | (F.col("alone") + F.col("place") <= start))
    )
    return ranked.select("shingle", "node", n.alias("n"), start.alias("p"))


def _reachable(percent: int) -> Column:
    """Whether counted common prefix shingles leave the overlap that the sizes need."""
    needed = F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent))
    return F.col("common") + F.greatest(F.col("n") - F.col("p"), F.col("n2") - F.col("p2")) >= needed


def _similar_sizes(percent: int) -> Column:
    return F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent


def _bitmap(own: np.ndarray) -> bytes:
    """The parity of how many of a set's shingles fall on each of a power of two of places.

    Two bitmaps of one length differ in at most as many places as their sets differ in
    shingles. The halves of a longer one, XOR-ed, are that of half the length.
    """
    size = _FEWEST_BITS
    while size < min(_BITS * len(own), _MOST_BITS):
        size *= 2
    places = (own.view(np.uint64) >> np.uint64(7)) % np.uint64(size)
    counts = np.bincount(places.astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, hashes (the whole set) and bits of the documents in ``wanted`` (doc_id, node)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("jaccard")
        for batch in batches:
            asked = batch.column(0).to_pylist()
            for a, b, texts in text_parts(batch.column(1)):
                found = [
                    (node, own)
                    for node, own in zip(asked[a:b], shingle_sets(texts), strict=True)
                    if len(own) and set_key(own) == node
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([node for node, _ in found], pa.int64()),
                        pa.array([own for _, own in found], pa.list_(pa.int64())),
                        pa.array([_bitmap(own) for _, own in found], pa.binary()),
                    ],
                    names=["node", "hashes", "bits"],
                )
            give_back()

    texts = docs.join(wanted.hint("shuffle_hash"), "doc_id").select("node", "text")
    return texts.mapInArrow(emit, "node bigint, hashes array<bigint>, bits binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (u, v and what else they carry) whose whole sets overlap enough.

    Pairs are written first: while they are few, Spark sends them to the sets, and only
    sets that a pair asks for move.
    """
    pairs = written(pairs, "jaccard-pairs")
    left = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("left")), "u")
    right = pairs.select("u", "v").join(
        sets.select(F.col("node").alias("v"), F.col("hashes").alias("right")), "v"
    )
    common = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - common
    return left.join(right, ["u", "v"]).where(common * 100 >= union * percent).select(*pairs.columns)


def _leader_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Each set's best leader: u, v.

    A leader is one set per shingle and class of sizes, as wide as 4 : 3.
    """
    sized = rows.withColumn("class", F.floor(F.log("n") / F.log(F.lit(4 / 3))))
    leaders = sized.groupBy("shingle", "class").agg(
        F.min(F.struct(F.xxhash64("node").alias("o"), "node", "n", "p")).alias("leader")
    )
    met = (
        sized.join(leaders, ["shingle", "class"])
        .where("node <> leader.node")
        .groupBy("node", "n", "p", F.col("leader.node").alias("v"))
        .agg(
            F.count("*").alias("common"),
            F.max("leader.n").alias("n2"),
            F.max("leader.p").alias("p2"),
        )
        .where(_similar_sizes(percent) & _reachable(percent))
    )
    best = met.groupBy("node").agg(F.max(F.struct("common", "v")).alias("best"))
    return best.select(F.col("node").alias("u"), F.col("best.v").alias("v"))


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the component of their node, itself where it hangs on none of the settled ``links``."""
    found = links.select(F.col("u").alias("linked"), F.col("v").alias("component"))
    joined = rows.drop("component").join(found, F.col("node") == F.col("linked"), "left")
    return joined.withColumn("component", F.coalesce("component", "node")).drop("linked")


def _gathered(rows: DataFrame) -> DataFrame:
    """major, node, n: once each, the sets of blocks of several components, by a block's largest one."""
    counted = rows.groupBy("shingle", "component").agg(F.count("*").alias("k"))
    blocks = counted.groupBy("shingle").agg(
        F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("several")
    )
    mixed_blocks = blocks.where("several > 1").select("shingle", F.col("top.component").alias("major"))
    return rows.join(mixed_blocks, "shingle").select("major", "node", "n").distinct()


def _tiles(gathered: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of the tiles (major, i, j): on the left all sets but those of the widest component, on
    the right all sets of one ``major``. Sets of one component only leave."""
    counted = gathered.groupBy("major", "component").agg(F.count("*").alias("k"))
    shape = (
        counted.groupBy("major")
        .agg(
            F.max(F.struct("k", "component")).alias("top"),
            F.sum("k").alias("held"),
            F.count("*").alias("several"),
        )
        .where("several > 1")
        .select(
            "major",
            F.col("top.component").alias("widest"),
            F.ceil((F.col("held") - F.col("top.k")) / TILE).alias("lefts"),
            F.ceil(F.col("held") / TILE).alias("rights"),
        )
    )
    bits = sets.select("node", "bits").dropDuplicates(["node"])
    placed = (
        gathered.join(shape, "major")
        .join(bits, "node")
        .withColumn("wide", F.col("component") == F.col("widest"))
        .withColumn("slot", F.xxhash64("node"))
    )

    def side(rows: DataFrame, own: str, count: str, other: str, others: str, left: bool) -> DataFrame:
        return rows.select(
            "major",
            "node",
            "n",
            "component",
            "bits",
            "wide",
            F.lit(left).alias("left"),
            F.expr(f"pmod(slot, {count})").alias(own),
            F.explode(F.expr(f"sequence(0L, {others} - 1)")).alias(other),
        )

    lefts = side(placed.where("not wide"), "i", "lefts", "j", "rights", True)
    return lefts.unionByName(side(placed, "j", "rights", "i", "lefts", False))


def _forest(one: np.ndarray, two: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of links between ``one`` and ``two``, a spanning forest of those that come first in ``order``."""
    names, ends = np.unique(np.concatenate([one, two]), return_inverse=True)
    a, b = ends[: len(one)][order], ends[len(one) :][order]
    tree, kept = np.arange(len(names)), []
    while True:
        open_ = np.flatnonzero(tree[a] != tree[b])
        if not len(open_):
            return np.concatenate([order[k] for k in kept]) if kept else order[:0]
        pairs = np.stack([tree[a[open_]], tree[b[open_]]], 1)
        trees, first = np.unique(pairs.ravel(), return_index=True)
        chosen = first // 2
        kept.append(open_[np.unique(chosen)])
        parent = np.arange(len(names))
        parent[trees] = pairs[chosen].sum(1) - trees
        # links have one order, so trees that chose each other are the only cycles
        mutual = (parent[parent] == np.arange(len(names))) & (np.arange(len(names)) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        tree = parent[tree]


def _multiplied(percent: int, closest: bool):
    """The pairs of one tile that sizes and bitmaps do not rule out."""

    def parted(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        """Nodes, sizes, components, whether widest, and bitmaps, of each length of bitmaps."""
        columns = [table.column(c).to_numpy() for c in ("node", "n", "component", "wide")]
        bits = table.column("bits").to_pylist()
        lengths = np.array([len(b) for b in bits], np.int64)
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            maps = np.frombuffer(b"".join(bits[k] for k in at), "<u8").reshape(len(at), -1)
            yield *(c[at] for c in columns), maps

    def pairs(left: tuple, right: tuple) -> Iterator[tuple[np.ndarray, ...]]:
        node, n, component, _, maps = left
        node2, n2, component2, wide2, maps2 = right
        words = min(maps.shape[1], maps2.shape[1])
        maps, maps2 = _folded(maps, words), _folded(maps2, words)
        few = _FEWEST_BITS // 64
        short, short2 = _folded(maps, few), _folded(maps2, few)
        step = max(1, _COMPARED // len(node2))
        for a in range(0, len(node), step):
            own = slice(a, a + step)
            both = n[own, None] + n2
            spare = both - 2 * -(-both * percent // (100 + percent))
            fits = np.minimum(n[own, None], n2) * 100 >= np.maximum(n[own, None], n2) * percent
            fits &= component[own, None] != component2
            fits &= wide2 | (node[own, None] < node2)
            if not fits.any():
                continue
            apart = np.bitwise_count(short[own, None] ^ short2).sum(2, dtype=np.int64)
            i, j = np.nonzero(fits & (apart <= spare))
            for b in range(0, len(i), 1 << 12):
                i2, j2 = i[b : b + (1 << 12)], j[b : b + (1 << 12)]
                far = np.bitwise_count(maps[a + i2] ^ maps2[j2]).sum(1, dtype=np.int64)
                ok = far <= spare[i2, j2]
                i2, j2, far = i2[ok] + a, j2[ok], far[ok]
                yield node[i2], node2[j2], component[i2], component2[j2], far / (n[i2] + n2[j2])

    def tile(table: pa.Table) -> pa.Table:
        side = table.column("left").to_numpy()
        lefts = list(parted(table.filter(pa.array(side))))
        rights = list(parted(table.filter(pa.array(~side))))
        found = [[], [], [], [], []]
        for left in lefts:
            for right in rights:
                if max(left[4].shape[1], right[4].shape[1]) > 2 * min(left[4].shape[1], right[4].shape[1]):
                    continue  # more than twice the bits, too different in size
                for part in pairs(left, right):
                    for column, values in zip(found, part, strict=True):
                        column.append(values)
        u, v, one, two, far = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in found)
        if closest and len(u):
            kept = _forest(one, two, np.lexsort((v, u, far)))
            u, v, one, two = u[kept], v[kept], one[kept], two[kept]
        del lefts, rights, found
        give_back()
        ends = {"u": np.minimum(u, v), "v": np.maximum(u, v), "one": np.minimum(one, two), "two": np.maximum(one, two)}
        return pa.table({name: pa.array(column, pa.int64()) for name, column in ends.items()})

    return tile


def _tile_pairs(gathered: DataFrame, sets: DataFrame, percent: int, closest: bool) -> DataFrame:
    """u, v of the different components one, two that may link: all, or of each tile a forest of the ``closest``."""
    tiles = _tiles(gathered, sets).groupBy("major", "i", "j")
    schema = "u bigint, v bigint, one bigint, two bigint"
    return tiles.applyInArrow(_multiplied(percent, closest), schema).distinct()


def ngram_jaccard(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Words are lower-cased in A-Z; a set holds the distinct shingles of five words, or the
    whole sequence of fewer. Documents link when the Jaccard similarity of their sets is at
    least ``percent`` / 100; component_id is the smallest doc_id that links lead to. All
    links between components are found; none inside one is needed.

    Null and empty texts have an empty set and link with nothing. Equal sets are one
    row of the product, so repeated rows and copies cost nothing. A null doc_id gives a null
    component and links nothing; rows that share a doc_id are documents of their own.
    Other columns are dropped; an empty table gives an empty one. ``percent`` is 75 to 100: the
    sizes that split the two indexes are right for no smaller one.
    """
    if not PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {PERCENT} to 100")
    source = docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    signatures = written(source.mapInArrow(_signatures, _SIGNATURE), "jaccard-signatures")
    nodes = written(
        signatures.where("node IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id")),
        "jaccard-nodes",
    )
    index = written(_index(source, percent), "jaccard-index")
    twos = index.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1")
    index = written(index.join(twos.select("shingle"), "shingle"), "jaccard-blocks")
    wanted = index.select("node").distinct().join(nodes, "node")
    sets = written(_sets(source, wanted), "jaccard-sets")

    links = settled(_verified(_leader_pairs(index, percent), sets, percent))
    gathered = written(_gathered(_labelled(index, links)), "jaccard-gathered")
    for closest in (True, False):
        labelled = written(_labelled(gathered, links), "jaccard-labelled")
        found = _verified(_tile_pairs(labelled, sets, percent, closest), sets, percent)
        # a link between two components links their smallest nodes: fewer links, fewer rounds
        links = settled(links.union(found.select("one", "two")))
    joined = members(links)
    labels = joined.join(nodes, "node").groupBy("component").agg(F.min("doc_id").alias("label"))
    known = nodes.join(joined.join(labels, "component").select("node", "label"), "node", "left")
    known = known.select("node", F.coalesce("label", "doc_id").alias("component_id"))
    named = signatures.join(known, "node", "left")
    return named.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
