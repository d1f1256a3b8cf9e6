"""Packed numbers that travel in rows, and rows that arrive by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np


def planes(numbers: np.ndarray) -> bytes:
    """Unsigned numbers by planes of bytes, compressed: high bytes that are alike shrink to little."""
    import zstandard

    top = int(numbers.max(initial=0))
    wide = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    raw = numbers.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T.tobytes()
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(raw)


def unplanes(raw: bytes) -> np.ndarray:
    import zstandard

    each = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    return np.ascontiguousarray(each.T).view(f"<u{raw[0]}").ravel()


def squeeze(ascending: np.ndarray) -> bytes:
    """Ascending unsigned numbers as differences."""
    return planes(np.diff(ascending, prepend=np.uint64(0)))


def unsqueeze(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw), dtype=np.uint64)


def by_first(batches: Iterator, flush: Callable[[list[tuple]], Iterator]) -> Iterator:
    """flush(rows) for the rows of each value of the first column, which is sorted."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != key and rows:
                yield from flush(rows)
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield from flush(rows)
