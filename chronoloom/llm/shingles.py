"""Vectorised hashing of word shingles over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased.  All words of
a column are hashed at once: every byte value has a random 64-bit code, codes are weighted by the
powers of an odd number, and a word's hash is the difference of two prefix sums divided by the
power at its start (odd numbers have inverses modulo 2^64), then finalised with its length.

Defined results: a null or blank text has no words and no shingles; a text of fewer than ``n``
words has one shingle, its whole word sequence; a text of any length is hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes hashed at once; a longer text is a piece of its own.
PIECE_BYTES = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
for _upper in range(65, 91):
    _CODE[_upper] = _CODE[_upper + 32]
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(int(_BASE), -1, 2**64))
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class _Powers:
    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            size = max(n, PIECE_BYTES + (1 << 16))
            self.power, self.inverse = (np.full(size, b, dtype=U) for b in (_BASE, _BASE_INVERSE))
            self.power[0] = self.inverse[0] = U(1)
            np.cumprod(self.power, out=self.power)
            np.cumprod(self.inverse, out=self.inverse)
            self.n = size
        return self.power[:n], self.inverse[:n]


_powers = _Powers()


def _text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the column and the len+1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, count=len(column) + 1, offset=column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, ends


def _piece(raw: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of some texts, in order, and len+1 offsets of each text's."""
    docs = len(bounds) - 1
    solid = ~_SPACE[raw]
    first = solid.copy()
    last = solid.copy()
    if len(raw):
        opens = np.zeros(len(raw) + 1, dtype=bool)
        opens[bounds] = True
        first[1:] &= ~solid[:-1] | opens[1:-1]
        last[:-1] &= ~solid[1:] | opens[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum(_CODE[raw] * power[: len(raw)], out=sums[1:])
    words = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U) * _PLACE[63])
    at = np.searchsorted(start, bounds)
    counts = np.diff(at)
    owner = np.repeat(np.arange(docs), counts)
    if len(words) >= n:
        full = len(words) - n + 1
        joined = words[:full] * _PLACE[0]
        for j in range(1, n):
            joined += words[j : j + full] * _PLACE[j]
        whole = owner[:full] == owner[n - 1 :]
        hashes, owner_of = mix(joined[whole]), owner[:full][whole]
    else:
        hashes, owner_of = np.zeros(0, U), np.zeros(0, np.int64)
    if len(brief := np.flatnonzero((counts > 0) & (counts < n))):
        with np.errstate(over="ignore"):
            made = [mix(np.array([(words[at[d] : at[d + 1]] * _PLACE[: counts[d]]).sum(dtype=U) + _PLACE[32 + counts[d] % 30]], dtype=U))[0] for d in brief]
        where = np.searchsorted(owner_of, brief)
        hashes, owner_of = np.insert(hashes, where, np.array(made, dtype=U)), np.insert(owner_of, where, brief)
    return hashes, np.searchsorted(owner_of, np.arange(docs + 1))


def shingle_pieces(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, hashes, offsets) for runs of texts of about PIECE_BYTES."""
    raw, ends = _text_buffers(column)
    at = 0
    while at < len(ends) - 1:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE_BYTES, side="right")) - 1)
        bounds = ends[at : stop + 1] - ends[at]
        hashes, offsets = _piece(raw[ends[at] : ends[stop]], bounds, n)
        yield at, hashes, offsets
        at = stop


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    for _, hashes, offsets in shingle_pieces(column, n):
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            yield np.unique(hashes[a:b])
