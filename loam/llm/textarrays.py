"""Words of Arrow string columns as numpy arrays of 64-bit hashes, a block of rows at a time.

A word is a maximal run of ASCII letters, ASCII digits and characters beyond ASCII, lower-cased.
All functions see whole texts; a block only bounds how many rows are in numpy at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

P = np.uint64(0x9E3779B97F4A7C15 | 1)
P_INV = np.uint64(pow(int(P), -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}

IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[128:] = True
for _lo, _hi in ((48, 57), (65, 90), (97, 122)):
    IS_WORD[_lo : _hi + 1] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            for key, base in (("p", P), ("i", P_INV)):
                a = np.full(size, base, dtype=np.uint64)
                a[0] = 1
                _POW[key] = np.multiply.accumulate(a)
    return _POW["p"], _POW["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of one block: row of each, byte range in ``data``, and the hash of its bytes."""

    first: int  # index of the block's first row in its batch
    rows: int
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray  # lower-cased bytes
    prefix: np.ndarray  # running sums for hash_range
    counts: np.ndarray  # words per row
    offsets: np.ndarray  # byte offsets of the rows in data

    def hash_range(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, inv = _powers(len(self.data) + 1)
        with np.errstate(over="ignore"):
            h = (self.prefix[end] - self.prefix[start]) * inv[start]
            return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def hashes(self) -> np.ndarray:
        return self.hash_range(self.start, self.end)


def blocks(col: pa.Array, block_bytes: int = 1 << 20) -> Iterator[Words]:
    """Blocks of whole rows of about ``block_bytes`` bytes; a longer row has a block to itself."""
    if col.null_count:
        col = pc.fill_null(col, "")
    low = pc.utf8_lower(col)
    if isinstance(low, pa.ChunkedArray):
        low = pa.concat_arrays(low.chunks)
    if not len(low):
        return
    offsets = np.frombuffer(low.buffers()[1], dtype=np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    body = low.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(low):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes, side="right")) - 1)
        to = min(to, len(low))
        yield words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray, first: int = 0) -> Words:
    rows, n = len(offsets) - 1, len(data)
    is_word = np.zeros(n + 2, dtype=bool)
    is_word[1:-1] = IS_WORD[data]
    lead, tail = is_word[1:] & ~is_word[:-1], is_word[:-1] & ~is_word[1:]
    inner = offsets[1:-1]
    cut = np.unique(inner[(inner > 0) & (inner < n)])
    joined = cut[is_word[cut] & is_word[cut + 1]]  # a word would run over the end of a row
    lead[joined] = True
    tail[joined] = True
    start, end = np.flatnonzero(lead), np.flatnonzero(tail)
    power, _ = _powers(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(first, rows, row, start, end, data, prefix, np.bincount(row, minlength=rows), offsets)


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``width`` words in a row, repeats kept; a row with fewer words has its one run of them all."""
    h = w.hashes()
    out_row, out_hash = [], []
    if len(h) >= width:
        same = w.row[: len(h) - width + 1] == w.row[width - 1 :]
        acc = np.zeros(len(same), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                acc = acc * P + h[k : k + len(same)]
        out_row.append(w.row[: len(same)][same])
        out_hash.append(mix(acc[same]))
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(short):
        begin = np.cumsum(w.counts) - w.counts
        got = np.empty(len(short), dtype=np.uint64)
        for j, r in enumerate(short):
            acc = 0
            for x in h[begin[r] : begin[r] + w.counts[r]].tolist():
                acc = (acc * int(P) + x) & (2**64 - 1)
            got[j] = acc
        out_row.append(short)
        out_hash.append(mix(got ^ np.uint64(0x5851F42D4C957F2D)))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, hsh = np.concatenate(out_row), np.concatenate(out_hash)
    if len(out_row) > 1:
        order = np.argsort(row, kind="stable")
        row, hsh = row[order], hsh[order]
    return row, hsh


def distinct_per_row(row: np.ndarray, hsh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same pairs sorted by row and hash, each once."""
    order = np.lexsort((hsh, row))
    row, hsh = row[order], hsh[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (hsh[1:] != hsh[:-1])
    return row[new], hsh[new]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def plain_blocks(col: pa.Array, block_bytes: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes with A-Z lower-cased, offsets of the rows in them) of blocks of whole rows; a longer row has a block to itself."""
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    body = col.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = min(len(col), max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes, side="right")) - 1))
        yield at, LOWER[data[offsets[at] : offsets[to]]], offsets[at : to + 1] - offsets[at]
        at = to


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal runs of bytes that are ``inside``; none goes beyond its row."""
    n = len(inside)
    padded = np.zeros(n + 2, dtype=bool)
    padded[1:-1] = inside
    lead, tail = padded[1:] & ~padded[:-1], padded[:-1] & ~padded[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    joined = cut[padded[cut] & padded[cut + 1]]
    lead[joined] = tail[joined] = True
    start, end = np.flatnonzero(lead), np.flatnonzero(tail)
    return np.searchsorted(offsets, start, side="right") - 1, start, end


def coded(data: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each run, distinct runs as strings): runs are compared whole, not by hashes."""
    ends = np.zeros(len(start) + 1, dtype=np.int32)
    np.cumsum(end - start, out=ends[1:])
    strings = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(data[inside])).dictionary_encode()
    return strings.indices.to_numpy(), strings.dictionary
