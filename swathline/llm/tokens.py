"""Token hashes of whole columns of text, in numpy over the column's own bytes.

Tokens are runs of bytes other than space and \\t to \\r, A-Z lowered: both rules are about single bytes, so UTF-8
need not be decoded.  A token's hash is the sum of fixed random numbers, one for each byte and place in the token,
mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_PLACES = 64
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _value(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix((place.astype(np.uint64) << np.uint64(8)) + byte + np.uint64(0x9E3779B97F4A7C15))


_TABLE = _value(np.tile(np.arange(256, dtype=np.uint64), _PLACES), np.repeat(np.arange(_PLACES), 256))
#: The hash that ends a text; no token is empty.
END = np.uint64(mix(np.array([0x5EED], dtype=np.uint64))[0])


def slices(column: pa.Array, size: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, row offsets within them) of some rows at a time, about `size` bytes or one row; null is empty."""
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    ends = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + size, side="right")) - 1)
        yield raw[ends[row] : ends[to]], ends[row : to + 1] - ends[row]
        row = to


def hashes(raw: np.ndarray, rows: np.ndarray, end: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens and the number of tokens of each row; with `end`, each row closes with END."""
    n = len(rows) - 1
    solid = ~_GAP[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = rows[:-1][rows[:-1] < rows[1:]]
    first[heads] = solid[heads]  # a token doesn't go on into the next row
    at = np.flatnonzero(solid)
    starts = np.flatnonzero(first[at])
    if len(starts):
        size = np.diff(np.append(starts, len(at)))
        place = np.arange(len(at)) - np.repeat(starts, size)
        byte = _LOW[raw[at]]
        value = _TABLE[np.minimum(place, _PLACES - 1) * 256 + byte]
        far = np.flatnonzero(place >= _PLACES)
        if len(far):
            value[far] = _value(byte[far].astype(np.uint64), place[far])
        out = mix(np.add.reduceat(value, starts) + size.astype(np.uint64))
        counts = np.diff(np.searchsorted(at[starts], rows))
    else:
        out, counts = np.zeros(0, np.uint64), np.zeros(n, dtype=np.int64)
    if not end:
        return out, counts
    closed = np.full(len(out) + n, END, dtype=np.uint64)
    closed[np.arange(len(out)) + np.repeat(np.arange(n), counts)] = out
    return closed, counts + 1
