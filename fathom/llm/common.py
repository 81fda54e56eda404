"""Shared plumbing: table access, durable intermediate tables, and text buffers for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from fathom.sources.index_store import forget, scope, shared_dir, stored
from fathom.sources.tables import reachable, table

__all__ = ["blocks", "forget", "mixed", "powers", "reachable", "scope", "shared_dir", "span_hashes", "stored", "table", "utf8", "word_spans"]
#: Bytes of text that one numpy pass handles at a time.
BLOCK_BYTES = 1 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about `size` bytes; a longer row has a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finaliser (three xor-shifts, two odd multipliers): every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: The white space that separates words, as bytes.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
IS_SPACE = np.isin(np.arange(256), list(SPACES))
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BASE = 0x5851F42D4C957F2D
_LETTERS = mixed(np.arange(256), 3) | np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2^64, kept for the next call."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES // 2)
        _powers.clear()
        with np.errstate(over="ignore"):
            for base in (_BASE, pow(_BASE, -1, 2**64)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers.append(np.multiply.accumulate(steps))
    return _powers[0][:n], _powers[1][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of each word in rows that lie one after the other from offsets[0] on; positions count from there."""
    text = data[offsets[0] : offsets[-1]]
    if not len(text):
        none = np.zeros(0, np.int64)
        return none, none, none
    inner = ~IS_SPACE[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[offsets - offsets[0]] = True
    starts, ends = inner.copy(), inner.copy()
    starts[1:] &= ~inner[:-1] | edge[1:-1]
    ends[:-1] &= ~inner[1:] | edge[1:-1]
    first, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, end, np.searchsorted(offsets - offsets[0], first, side="right") - 1


def span_hashes(text: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: a polynomial in randomised letters, from running sums, then mixed.

    Spans are in order and disjoint; a long text is hashed in pieces of about BLOCK_BYTES, so memory does not follow it.
    """
    out, at = np.zeros(len(first), np.uint64), 0
    while at < len(first):
        low = int(first[at])
        upto = max(at + 1, int(np.searchsorted(end, low + BLOCK_BYTES, side="right")))
        piece = text[low : end[upto - 1]]
        up, down = powers(len(piece))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[piece] * up, dtype=np.uint64)])
            out[at:upto] = mixed((sums[end[at:upto] - low] - sums[first[at:upto] - low]) * down[first[at:upto] - low])
        at = upto
    return out
