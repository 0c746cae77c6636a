"""Words of many texts at once, on the bytes of Arrow string columns.

A block is some consecutive rows of a column, at most about BLOCK_BYTES long unless one text is longer. Word borders,
hashes and counts come from a few array operations over the block's bytes instead of a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII digits, letters and everything beyond ASCII.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Everything but space, tab, line feed, vertical tab, form feed and carriage return.
VISIBLE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])

_BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        factors = np.full(2 * n, _BASE, dtype=np.uint64)
        factors[0] = 1
        _powers = np.cumprod(factors, dtype=np.uint64)
    return _powers


@dataclass
class Block:
    """Rows ``first`` up to ``last`` of a column: their bytes, and where each row starts among them (one more at the end)."""

    first: int
    last: int
    data: np.ndarray
    rows: np.ndarray


@dataclass
class Words:
    """``starts``/``ends``: byte places of words; ``rows[i]:rows[i+1]`` are the words of row i; ``codes``: 64-bit hashes."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    codes: np.ndarray


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column in order; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        last = min(last, n)
        yield Block(first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last


def words(block: Block, kind: np.ndarray) -> Words:
    """Words of a block: longest runs of bytes of ``kind`` within a row, with ASCII letters in lower case."""
    data = LOWER[block.data]
    inside = kind[data]
    n = len(data)
    cuts = block.rows[1:-1]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[cuts[cuts < n]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(block.rows), np.int64), none.astype(np.uint64))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    step = np.ones(n, dtype=np.int64)
    step[0] = 0
    step[starts[1:]] = 1 - np.diff(starts)
    if starts[0]:
        step[starts[0]] = 1 - starts[0]
    place = np.cumsum(step)
    values = _BYTE_CODES[data] * powers(int(place.max()) + 1)[place]
    values[~inside] = 0
    codes = mix64(np.add.reduceat(values, starts) ^ (ends - starts).astype(np.uint64))
    return Words(starts, ends, np.searchsorted(starts, block.rows), codes)
