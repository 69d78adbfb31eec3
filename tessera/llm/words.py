"""Words of whole batches of texts as 64-bit hashes, in numpy: no object for each word, no cache.

A word is a run of bytes that are no separators, ASCII letters lower-cased. Its hash is a
polynomial over random numbers that stand for bytes, mixed. All is done in slices of bounded
size, however long a text is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are hashed at once.
SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S32, _S29 = np.uint64(32), np.uint64(29)
_CODES = np.random.default_rng(20).integers(1, 1 << 64, 256, np.uint64) | np.uint64(1)
_CODES[65:91] = _CODES[97:123]
_POWERS: list[np.ndarray] = []

#: Separators: white space of ASCII; all of ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)])) for x in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S32)
    x *= _MIX
    x ^= x >> _S29
    return x


@dataclass
class Words:
    """``hashes``, and the bytes ``starts`` to ``ends`` in ``data``, of each word; text k has the
    words ``first[k]`` to ``first[k + 1]``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def text(self, start: int, end: int) -> bytes:
        """The bytes from word ``start`` to before word ``end``."""
        return self.data[self.starts[start] : self.ends[end - 1]].tobytes()


def words_of(column: pa.Array, separators: np.ndarray) -> Words:
    """The words of a string column (null: none)."""
    column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    hashes, starts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    low, last = int(bounds[0]), int(bounds[-1])
    while low < last:
        high = min(last, low + SLICE)
        if high < last:
            high = _break(data, bounds, separators, low, high, last)
        found = _hashed(data[low:high], bounds[np.searchsorted(bounds, low) : np.searchsorted(bounds, high)] - low, separators)
        hashes.append(found[0]), starts.append(found[1] + low), ends.append(found[2] + low)
        low = high
    begin = np.concatenate(starts)
    return Words(np.concatenate(hashes), begin, np.concatenate(ends), np.searchsorted(begin, bounds), data)


def _break(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray, low: int, high: int, last: int) -> int:
    """A place near ``high`` where no word goes on."""
    bound = int(bounds[np.searchsorted(bounds, high, side="right") - 1])
    if bound > low:
        return bound
    for at in range(high, last, 4096):  # a separator, or the text's end, whichever comes first
        end = min(last, at + 4096)
        stops = np.flatnonzero(separators[data[at:end]])
        stop = at + int(stops[0]) if len(stops) else last
        after = int(bounds[min(np.searchsorted(bounds, at, side="right"), len(bounds) - 1)])
        if min(stop, after) < end or end == last:
            return min(stop, after, last)
    return last


def _hashed(data: np.ndarray, texts: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = ~separators[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    texts = texts[texts < len(data)]
    begins[texts] = solid[texts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    at = np.flatnonzero(solid)
    first = np.searchsorted(at, starts)
    powers, inverses = _powers(len(at))
    sums = np.add.reduceat(_CODES[data[at]] * powers[: len(at)], first)
    ends = np.append(first[1:], len(at))
    return mixed(sums * inverses[first]), starts, at[ends - 1] + 1


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each ``width`` words that follow each other."""
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, np.uint64(width))
    for i in range(width):
        out = (out ^ hashes[i : i + n]) * _MULTIPLY
        out ^= out >> _S29
    return mixed(out)


#: Bits of a key within its block of 64, and of the filter for each key; the most blocks (8 MB).
HASHES, BITS_A_KEY, MOST_BLOCKS = 4, 12, 1 << 20


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A blocked Bloom filter of the 64-bit hashes in ``column``, of bounded size: of more than some
    millions of keys it passes others too, so that an exact join must follow it."""
    count, blocks = keys.count(), 1
    while blocks * 64 < count * BITS_A_KEY and blocks < MOST_BLOCKS:
        blocks *= 2
    key, mask = F.col(column), F.lit(0).cast("bigint")
    for i in range(HASHES):
        bit = F.shiftrightunsigned(key, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    block = F.shiftrightunsigned(key, 30).bitwiseAND(F.lit(blocks - 1))
    found = keys.groupBy(block.cast("int").alias("block")).agg(F.bit_or(mask).alias("bits")).toArrow()
    out = np.zeros(blocks, np.uint64)
    out[found.column("block").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def may_hold(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the hashes the filter passes."""
    keys, mask, one, low = keys.view(np.uint64), np.uint64(0), np.uint64(1), np.uint64(63)
    for i in range(HASHES):
        mask = mask | (one << ((keys >> np.uint64(6 * i)) & low))
    return blocks[(keys >> np.uint64(30)) & np.uint64(len(blocks) - 1)] & mask == mask
