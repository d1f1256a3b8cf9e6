"""Words and word hashes of whole texts, shared by the operators on word sequences."""

from __future__ import annotations

import numpy as np

def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, as UTF-8: bytes.lower and bytes.split treat just these."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. A word is hashed in less time than it is found in a table of words."""
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words; the whole sequence as one if it is shorter; none if it is empty."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = _finish(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k] + np.uint64(n))
    return out
