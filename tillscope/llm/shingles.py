"""Sets of word shingles as sorted 64-bit hashes, for whole batches in numpy."""

from __future__ import annotations

import functools

import numpy as np

#: words of a shingle
WORDS = 5
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD1342543DE82EF95)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    result = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        result.append(np.multiply.accumulate(steps))
    return result[0], result[1]


def _chunk_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of ``data``; words end at its end."""
    size = _CHUNK
    while size < len(data) + 1:
        size *= 2
    power, inverse = _powers(size)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    begin, end = edge[::2], edge[1::2]
    values = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    raw = (total[end] - total[begin]) * inverse[begin]
    return mixed(raw + (end - begin).astype(np.uint64) * _STEP), begin


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word; a long text is read in chunks cut at a space."""
    found, places, at = [], [], 0
    view = np.frombuffer(data, np.uint8)
    while at < len(view):
        end = min(at + _CHUNK, len(view))
        while end < len(view):  # no word is cut
            gap = np.flatnonzero(_SPACE[view[end : end + _CHUNK]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + _CHUNK, len(view))
        words, begin = _chunk_words(view[at:end])
        found.append(words)
        places.append(begin + at)
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(places)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (int64) of each text.

    Words are lower-cased in A-Z only. A text of fewer than five words is one shingle,
    its whole sequence; a text without words has none. Hashes of sequences of other
    lengths never meet but by chance, 1 in 2 ** 64.
    """
    encoded = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
    ends = np.cumsum([len(x) + 1 for x in encoded]) if encoded else np.zeros(0, np.int64)
    words, places = word_hashes(b"\n".join(encoded))
    bounds = np.concatenate([[0], np.searchsorted(places, ends)])
    full = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
    for k in range(WORDS if len(full) else 0):
        full = full * _STEP + words[k : k + len(full)]
    full = mixed(full ^ np.uint64(WORDS))
    result = []
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = last - first
        if n >= WORDS:
            own = full[first : last - WORDS + 1]
        elif n:
            value = np.zeros(1, np.uint64)
            for k in range(first, last):
                value = value * _STEP + words[k : k + 1]
            own = mixed(value ^ np.uint64(n))
        else:
            own = np.zeros(0, np.uint64)
        result.append(np.unique(own.view(np.int64)))
    return result


def set_key(hashes: np.ndarray) -> int:
    """A 64-bit key of a set of hashes; equal sets have equal keys."""
    own = hashes.view(np.uint64)
    both = np.array(
        [
            np.add.reduce(mixed(own), dtype=np.uint64),
            np.bitwise_xor.reduce(mixed(own ^ _STEP)),
        ],
        np.uint64,
    )
    size = np.full(1, len(own), np.uint64)
    key = mixed(both[:1] ^ mixed(both[1:] + mixed(size)))
    return int(key.view(np.int64)[0])
