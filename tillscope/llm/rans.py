"""Static range asymmetric numeral coding of token ids, in numpy.

A frame is a run of ids with one frequency table. It is cut into segments of
``SEGMENT`` ids; ``BLOCK`` segments make a block with a word stream of its own. In a
block ``LANES`` coder states take turns, so a step codes one id of every lane of every
block at once. At the start of each segment the encoder notes the states and its place
in the stream: from such a checkpoint a decoder can begin, and all segments of a frame
are decoded side by side. Each block carries the crc32 of its ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 16
SEGMENT = 4096
BLOCK = 8
#: frequencies of a frame add up to 2 ** SCALE; more than there are 16-bit ids
SCALE = 20
_LOW = np.uint64(1 << 31)  # states stay in [2**31, 2**63), words have 32 bits
_MAGIC = b"rANS"
_HEAD = struct.Struct("<4sQII")


class Damaged(ValueError):
    """A frame whose bytes or checksums do not fit together."""


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, ascending, and their frequencies scaled to 2 ** SCALE.

    Each gets at least 1; what rounding leaves over or takes too much is settled on
    the most frequent ones.
    """
    found = np.bincount(ids, minlength=1)
    symbols = np.flatnonzero(found)
    counts = found[symbols]
    total = 1 << SCALE
    scaled = np.maximum(1, (counts.astype(np.float64) * total / counts.sum()).astype(np.int64))
    order = np.argsort(-scaled, kind="stable")
    missing = total - int(scaled.sum())
    for at in order:
        if not missing:
            break
        change = missing if missing > 0 else max(missing, 1 - int(scaled[at]))
        scaled[at] += change
        missing -= change
    return symbols.astype(np.uint16), scaled.astype(np.uint32)


def _starts(frequencies: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(frequencies)[:-1]]).astype(np.uint64)


def encode_frame(ids: np.ndarray) -> bytes:
    """All ids (unsigned 16-bit) of a frame as bytes; an empty frame is a header."""
    ids = np.ascontiguousarray(ids, np.uint16)
    if not len(ids):
        return _HEAD.pack(_MAGIC, 0, 0, 0)
    symbols, scaled = frequency_table(ids)
    segments = -(-len(ids) // SEGMENT)
    blocks = -(-segments // BLOCK)
    steps = SEGMENT // LANES
    padded = np.full(blocks * BLOCK * SEGMENT, symbols[np.argmax(scaled)], np.uint16)
    padded[: len(ids)] = ids
    # a step's ids of all blocks and lanes lie side by side
    rows = padded.reshape(blocks, BLOCK * steps, LANES).transpose(1, 0, 2).copy()
    frequency, start = np.ones(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
    frequency[symbols], start[symbols] = scaled, _starts(scaled)
    last = (segments - (blocks - 1) * BLOCK) * steps  # steps of the last, maybe short, block
    states = np.full((blocks, LANES), _LOW, np.uint64)
    words = np.zeros(rows.shape, np.uint32)
    given = np.zeros(rows.shape, bool)
    noted = np.zeros((blocks, BLOCK, LANES), np.uint64)
    half, total = np.uint64(32), np.uint64(1 << SCALE)
    room = np.uint64(63 - SCALE)
    for segment in range(BLOCK - 1, -1, -1):
        live = blocks if segment * steps < last else blocks - 1
        if not live:
            continue
        own = rows[segment * steps : (segment + 1) * steps, :live]
        f, begin = frequency[own], start[own]
        limit, rest = f << room, total - f
        x = states[:live]
        for step in range(steps - 1, -1, -1):
            at = segment * steps + step
            full = x >= limit[step]
            given[at, :live] = full
            words[at, :live] = x  # the low 32 bits
            x = x >> (full * half)
            # the quotient moves up by SCALE bits, the remainder stays
            x = x + x // f[step] * rest[step] + begin[step]
        states[:live] = x
        noted[:live, segment] = x
    words = words.transpose(1, 0, 2)
    given = given.transpose(1, 0, 2)
    parts = [
        _HEAD.pack(_MAGIC, len(ids), len(symbols), blocks),
        symbols.astype("<u2").tobytes(),
        scaled.astype("<u4").tobytes(),
    ]
    for block in range(blocks):
        held = min(BLOCK, segments - block * BLOCK)
        stream = words[block][given[block]]
        places = given[block].reshape(BLOCK, -1).sum(1)
        places = np.concatenate([[0], np.cumsum(places)[:-1]])[:held]
        own = ids[block * BLOCK * SEGMENT : (block + 1) * BLOCK * SEGMENT]
        parts += [
            struct.pack("<III", zlib.crc32(own.astype("<u2").tobytes()), len(stream), held),
            places.astype("<u4").tobytes(),
            noted[block, :held].astype("<u8").tobytes(),
            stream.astype("<u4").tobytes(),
        ]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def decode_frame(data: bytes) -> np.ndarray:
    """The ids of a frame; Damaged if its bytes or any block's checksum do not fit."""
    if len(data) < _HEAD.size:
        raise Damaged("frame is cut off")
    magic, count, n_symbols, blocks = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise Damaged("not a frame")
    if not count:
        return np.zeros(0, np.uint16)
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise Damaged("frame has changed")
    at = _HEAD.size
    symbols = np.frombuffer(data, "<u2", n_symbols, at)
    at += 2 * n_symbols
    scaled = np.frombuffer(data, "<u4", n_symbols, at)
    at += 4 * n_symbols
    checks, places, states, streams, begin = [], [], [], [], 0
    for _ in range(blocks):
        check, length, held = struct.unpack_from("<III", data, at)
        at += 12
        places.append(np.frombuffer(data, "<u4", held, at).astype(np.int64) + begin)
        at += 4 * held
        states.append(np.frombuffer(data, "<u8", held * LANES, at).reshape(held, LANES))
        at += 8 * held * LANES
        streams.append(np.frombuffer(data, "<u4", length, at))
        at += 4 * length
        begin += length
        checks.append(check)
    place = np.concatenate(places)
    stream = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    state = np.concatenate(states).astype(np.uint64)
    owner = np.repeat(np.arange(n_symbols, dtype=np.uint16), scaled)
    frequency, start = scaled.astype(np.uint64), _starts(scaled)
    steps = SEGMENT // LANES
    found = np.zeros((steps, len(state), LANES), np.uint16)
    slots = np.uint64((1 << SCALE) - 1)
    for step in range(steps):
        slot = state & slots
        symbol = owner[slot]
        found[step] = symbol
        state = frequency[symbol] * (state >> np.uint64(SCALE)) + slot - start[symbol]
        short = state < _LOW
        taken = np.cumsum(short, axis=1)
        word = stream[np.minimum(place[:, None] + taken - 1, len(stream) - 1)]
        state = np.where(short, (state << np.uint64(32)) | word, state)
        place += taken[:, -1]
    ids = symbols[found.transpose(1, 0, 2).reshape(-1)[:count]]
    for block, check in enumerate(checks):
        own = ids[block * BLOCK * SEGMENT : (block + 1) * BLOCK * SEGMENT]
        if zlib.crc32(own.astype("<u2").tobytes()) != check:
            raise Damaged(f"block {block} has changed")
    return ids
