"""Vectorised helpers over Arrow string columns: bytes, words, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_PRIME = 2**31 - 1
_BASES = (1259876921, 873940217)  # drawn at random below the prime

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: nearby inputs give unrelated outputs."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(29))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


_CODE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_CODES = (_CODE % U(_PRIME), (_CODE >> U(31)) % U(_PRIME))


_KEEP = 1 << 22  # powers that a process keeps of each base


@lru_cache(maxsize=8)
def _kept(make, base: int) -> list[np.ndarray]:
    return [np.zeros(0, U)]


def _first(make, base: int, n: int) -> np.ndarray:
    """The first n powers of a base: of the longest array so far, as pieces of different kinds take turns."""
    have = _kept(make, base)
    if len(have[0]) >= n:
        return have[0][:n]
    made = make(base, 1 << max(16, int(n).bit_length()))
    if len(made) <= _KEEP:
        have[0] = made
    return made[:n]


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of a base modulo the prime, by doubling."""
    out = np.ones(n, np.uint32)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * U(pow(base, done, _PRIME)) % U(_PRIME)
        done += more
    return out


def powers(base: int, n: int) -> np.ndarray:
    return _first(_powers, base, n)


class Rolling:
    """Hash of any slice of a sequence in constant time each: two polynomials modulo a prime, at bases drawn at random.

    Two different slices of n items agree in both with a probability of (n / 2**31)**2 at
    most over the choice of bases, whatever their structure.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = []
        small = values.dtype != np.uint8 and n and int(values.max()) < _PRIME  # the second polynomial is 0
        for k, base in enumerate(_BASES):
            if small and k:
                self.sums.append(np.zeros(n + 1, U))
                continue
            coded = _CODES[k][values] if values.dtype == np.uint8 else values if small else (values >> U(31 * k)) % U(_PRIME)
            coded = coded * powers(base, n)
            over = coded >> U(31)
            coded &= U(_PRIME)
            coded += over  # the same modulo the prime, below 2**32
            sums = np.zeros(n + 1, U)
            np.cumsum(coded, out=sums[1:])
            self.sums.append(sums)
        self.back = [powers(pow(base, -1, _PRIME), n + 1) for base in _BASES]

    def raw(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        a, b = ((s[hi] - s[lo]) % U(_PRIME) * back[lo] % U(_PRIME) for s, back in zip(self.sums, self.back, strict=True))
        return a << U(31) | b

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix(self.raw(lo, hi) + (hi - lo).astype(U) * U(_ODD))


def loose(values: np.ndarray, width: int) -> np.ndarray:
    """A cheap hash of every slice of one width, by its start: to choose and to group slices, not to tell that they are equal."""
    coded = _CODE[values] if values.dtype == np.uint8 else values
    n = len(values) - width + 1
    return mix(_wrapped(coded, width)[:n] + U(width))


def _wrapped(coded: np.ndarray, width: int) -> np.ndarray:
    """Polynomials modulo 2**64 of every slice of one width."""
    sums = np.zeros(len(coded) + 1, U)
    np.cumsum(coded * _first(_odd_powers, _ODD, len(coded)), out=sums[1:])
    n = len(sums) - width
    return (sums[width:] - sums[:n]) * _first(_odd_powers, pow(_ODD, -1, 1 << 64), n)


def _odd_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each begins. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows [i, j) of at most about `limit` bytes (one row at least), so that memory follows the limit and not the batch."""
    data, offsets = utf8(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of several texts; none crosses texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        ink = np.zeros(len(data) + 1, bool)
        ink[:-1] = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty_like(ink)
        before[0], before[1:] = False, ink[:-1]
        self.starts = np.flatnonzero(ink & (~before | edge))
        self.ends = np.flatnonzero(before & (~ink | edge))
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.counts)
        self.ink = ink[:-1]

    def hashes(self, rolling: Rolling) -> np.ndarray:
        return rolling(self.starts, self.ends)


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def arrow_rows(table: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) if not isinstance(v, pa.Array) else v for v, f in zip(table.values(), schema, strict=True)], schema=schema)
