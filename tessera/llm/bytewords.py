"""Words and shingles of Arrow text columns, hashed over their UTF-8 bytes by numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_000_000
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _separators(kind: str) -> np.ndarray:
    """space: white space of ASCII; alnum: all of ASCII but digits and letters."""
    sep = np.zeros(256, bool)
    if kind == "space":
        sep[list(SPACES)] = True
    else:
        sep[:128] = True
        sep[48:58] = sep[65:91] = sep[97:123] = False
    return sep


_SEP = {k: _separators(k) for k in ("space", "alnum")}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(CHUNK_BYTES * 2, 1 << (n + 1).bit_length()))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about limit bytes: first row, end row, bytes, offsets into them (nulls are empty)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """The words of a chunk: starts and ends in bytes, row of each, 64-bit hashes, and the words of each row."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, kind: str, lower: bool = True):
        rows = len(offsets) - 1
        self.raw = _LOWER[raw] if lower else raw
        n = len(raw)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~_SEP[kind][raw]
        edge = np.zeros(n + 1, bool)  # a row starts here
        edge[offsets] = True
        self.starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)  # words of row r: first[r] to first[r + 1]
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(rows), self.count)
        power, inverse = powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.raw] * power[:n], out=total[1:])
        self.hash = mix((total[self.ends] - total[self.starts]) * inverse[self.starts])

    def grams(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of width words inside a row, and the index of their first words."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = np.zeros(n, np.uint64)
        for i in range(width):
            out = out * _MUL + self.hash[i : i + n]
        at = np.flatnonzero(self.row[:n] == self.row[width - 1 :])
        return mix(out[at] + np.uint64(width)), at

    def sets(self, width: int) -> list[np.ndarray]:
        """Each row's set: its distinct shingles, sorted; with fewer words, the whole sequence as one."""
        grams, at = self.grams(width)
        bounds = np.searchsorted(at, self.first)
        out = []
        for r in range(len(self.count)):
            if self.count[r] >= width:
                out.append(np.unique(grams[bounds[r] : bounds[r + 1]]))
            elif self.count[r] == 0:
                out.append(np.zeros(0, np.uint64))
            else:
                h = np.zeros(1, np.uint64)
                for x in self.hash[self.first[r] : self.first[r + 1]]:
                    h = h * _MUL + x
                out.append(mix(h + np.uint64(self.count[r])))
        return out
