"""Words of whole Arrow text columns by array operations: where they are, their 64-bit hashes, and a table of hashes.

A word's hash is a polynomial over random numbers that stand for its bytes, taken from prefix sums over many words at
once, then mixed. Two different words share a hash with a probability of about 2^-64, as for any hash of that size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPAN = 1 << 17  # bytes hashed at once
SPACE_BYTES = b" \t\n\r\x0b\x0c"
BASE, INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SYMBOLS = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, element by element."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def table_of(members: bytes) -> np.ndarray:
    """A truth value per byte."""
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


SPACE = table_of(SPACE_BYTES)
SPLIT = table_of(SPACE_BYTES + bytes(range(0x1C, 0x20)))  # as str.split cuts, within ASCII


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows in them; null is the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "") if len(column) else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """text_bytes of the column in lower case (simple mappings), with a blank for each byte of white space outside ASCII."""
    data, offsets = text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    wide = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(wide):
        data = data.copy()
        end = len(data) - 1
        a, b, c = data[wide].astype(np.int64), data[np.minimum(wide + 1, end)].astype(np.int64), data[np.minimum(wide + 2, end)].astype(np.int64)
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        code = (a << 16) | (b << 8) | c
        three = np.isin(code, [0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]) | ((code >= 0xE28080) & (code <= 0xE2808A))
        for at, n in ((wide[two], 2), (wide[three], 3)):
            for k in range(n):
                data[at + k] = 0x20
    return data, offsets


def row_groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words of each row."""
    return runs(~space[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are inside of words, cut at rows, and the number of runs of each row."""
    n = len(inside)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    border = offsets[(offsets > 0) & (offsets < n)]
    first[border] = inside[border]
    last[border - 1] = inside[border - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, offsets))


def hash_words(words: list[str]) -> np.ndarray:
    """hash_ranges of words that are given as strings."""
    own = [w.encode() for w in words]
    stops = np.cumsum([len(w) for w in own], dtype=np.int64)
    starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)[: len(own)]
    return hash_ranges(np.frombuffer(b"".join(own), dtype=np.uint8), starts, stops)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def made(n: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for base in (BASE, INVERSE):
            x = np.full(n, base, dtype=U)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        return out[0], out[1]

    if not _POWERS:
        _POWERS.extend(made(SPAN + 4096))
    return (_POWERS[0], _POWERS[1]) if n <= len(_POWERS[0]) else made(n)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range; ranges ascend and don't overlap. Never zero."""
    out = np.zeros(len(starts), dtype=U)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts):
            a = int(starts[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, a + SPAN, side="right")))
            part = data[a : int(ends[hi - 1])]
            power, inverse = _powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, dtype=U)
            np.cumsum(_SYMBOLS[part] * power[: len(part)], out=sums[1:])
            s, e = starts[lo:hi] - a, ends[lo:hi] - a
            out[lo:hi] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(U)
            lo = hi
        out = mix(out)
    out[out == 0] = 1
    return out


class HashTable:
    """Numbers by 64-bit hash: open addressing in two arrays, read and filled by array operations. It grows by itself."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.values = np.zeros(1 << bits, dtype=U), np.zeros(1 << bits, dtype=np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        mask, shift = (1 << self.bits) - 1, U(64 - self.bits)
        slot = (keys >> shift).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        todo = np.flatnonzero((there != keys) & (there != 0))
        while len(todo):
            at = (slot[todo] + 1) & mask
            slot[todo] = at
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New, distinct keys."""
        if 2 * (self.used + len(keys)) > 1 << self.bits:
            old = self.keys != 0
            k, v = self.keys[old], self.values[old]
            while 2 * (self.used + len(keys)) > 1 << self.bits:
                self.bits += 1
            self.keys, self.values, self.used = np.zeros(1 << self.bits, dtype=U), np.zeros(1 << self.bits, dtype=np.int64), 0
            self._put(k, v)
        self._put(keys, values)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.used += len(keys)
        mask, slot = (1 << self.bits) - 1, (keys >> U(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = keys[free]  # of several keys for one slot, the last stays
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & mask
