"""Benchmark decontamination by greedy string tiling.

Seeds are windows of MIN_MATCH words that a document shares with a benchmark
item. For each (document, item) with a seed, greedy string tiling marks the
longest common run of words that no earlier tile overlaps, again and again,
so passages in another order count in full. Runs are found by running
Karp-Rabin: hashes of all windows of a search length come from running sums, the
search length falls from one tile's length to the next that occurs, and a
window's words are compared before it is marked. Memory is a few numbers a
word, whatever repeats. An item whose words are covered to COVERAGE or more is leaked.

Defined results: a null or empty text or item shares nothing; an item with
fewer words than a seed is one seed of its own; of equally long runs the first in the item, then in the document, is
marked; rows with a repeated doc_id are judged each;
null ids stay null; empty tables give an empty result; extra columns are
ignored by ``leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import windows, word_hashes, words

MIN_MATCH = 5
COVERAGE = 0.5
#: Benchmark characters that one block holds. Larger benchmarks are gone through in blocks, so what a task holds is bounded.
BLOCK_CHARS = 32_000_000


_BASE = 0x9E3779B97F4A7C15


class _Runs:
    """Karp-Rabin hashes of the windows of a word sequence, and which words are marked."""

    def __init__(self, words: np.ndarray):
        self.words, self.n = words, len(words)
        powers = np.full(self.n + 1, _BASE, np.uint64)
        powers[0] = 1
        # Running sums of word * base^place; a window's sum is brought to one scale by the powers that it lacks.
        self.powers = np.cumprod(powers, dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * self.powers[: self.n], dtype=np.uint64)])
        self.marks = np.zeros(self.n + 1, np.int64)

    def free(self, size: int) -> np.ndarray:
        """Starts of the windows of this size without a marked word."""
        return np.flatnonzero(self.marks[size:] == self.marks[: self.n - size + 1])

    def hashes(self, starts: np.ndarray, size: int, top: np.ndarray) -> np.ndarray:
        return (self.sums[starts + size] - self.sums[starts]) * top[len(top) - 1 - starts]

    def mark(self, start: int, size: int) -> None:
        self.marks[start + 1 : start + size] += np.arange(1, size)
        self.marks[start + size :] += size


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in doc, length), longest first, none overlapping in either."""
    item, doc = np.asarray(item, np.uint64), np.asarray(doc, np.uint64)
    tiles: list[tuple[int, int, int]] = []
    least = min(least, len(item))
    if not least or len(doc) < least:
        return tiles
    with np.errstate(over="ignore"):
        a, b = _Runs(item), _Runs(doc)
        top = a.powers if a.n >= b.n else b.powers

        def windows_of(size):
            i, j = a.free(size), b.free(size)
            return i, a.hashes(i, size, top), j, b.hashes(j, size, top)

        def occurs(size):
            _, x, _, y = windows_of(size)
            return bool(len(x) and len(y) and np.isin(x, y).any())

        size = min(a.n, b.n)
        while True:
            # A run of some length holds runs of all smaller ones: the longest length is found by halving.
            low, high = least - 1, size
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if occurs(mid) else (low, mid - 1)
            size = low
            if size < least:
                return tiles
            i, x, j, y = windows_of(size)
            order = np.argsort(y, kind="stable")
            y, j = y[order], j[order]
            at, stop = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
            gone: dict[int, int] = {}  # how far each group of equal hashes is used up
            taken, end = bytearray(b.n), -1
            for k in np.flatnonzero(stop > at).tolist():
                p, first = int(i[k]), int(at[k])
                if p < end:
                    continue
                for g in range(gone.get(first, first), int(stop[k])):
                    q = int(j[g])
                    if taken[q] or taken[q + size - 1]:  # windows of one size: an overlap reaches an end
                        if g == gone.get(first, first):
                            gone[first] = g + 1
                        continue
                    if np.array_equal(item[p : p + size], doc[q : q + size]):
                        tiles.append((p, q, size))
                        a.mark(p, size)
                        b.mark(q, size)
                        taken[q : q + size] = b"\1" * size
                        end = p + size
                        break
            size -= 1


class Benchmark:
    """Items of one block, and the sorted hashes of their seeds with the items of each."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.items = [(key, word_hashes(words(text))) for key, text in items]
        seeds, owner = [], []
        self.short: dict[int, list[int]] = {}
        for k, (_, h) in enumerate(self.items):
            if 0 < len(h) < least:
                self.short.setdefault(len(h), []).append(k)
            got = np.unique(windows(h, least))
            seeds.append(got)
            owner.append(np.full(len(got), k))
        seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.least = seeds[order], np.concatenate(owner)[order] if len(order) else order, least

    def leaked(self, text: str | None, coverage: float) -> list[tuple]:
        """(item, coverage, tiles, words matched) of each leaked item, by its place."""
        h = word_hashes(words(text))
        if not len(h) or not len(self.seeds):
            return []
        got = [windows(h, self.least)] if len(h) >= self.least else []
        got += [windows(h, n) for n in self.short if n <= len(h)]
        hit = np.concatenate(got) if got else np.zeros(0, np.uint64)
        low = np.searchsorted(self.seeds, hit)
        low[low == len(self.seeds)] = 0
        hit = np.unique(hit[self.seeds[low] == hit])
        if not len(hit):
            return []
        a, b = np.searchsorted(self.seeds, hit, "left"), np.searchsorted(self.seeds, hit, "right")
        some = sorted({int(k) for x, y in zip(a, b) for k in self.owner[x:y]})
        out = []
        for k in some:
            key, item = self.items[k]
            tiles = tile(item, h, self.least)
            matched = sum(n for _, _, n in tiles)
            if matched and matched >= coverage * len(item):
                out.append((key, matched / len(item), len(tiles), matched))
        return out


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator:
    """The benchmark, a stated query set, in broadcast blocks of BLOCK_CHARS at most; the driver holds one of them at a time."""
    sc, block, size = benchmark.sparkSession.sparkContext, [], 0
    for key, said in benchmark.select(F.col(item).cast("long"), text).toLocalIterator():
        if said:
            if size + len(said) > BLOCK_CHARS and block:
                yield sc.broadcast(block)
                block, size = [], 0
            block.append((key, said))
            size += len(said)
    yield sc.broadcast(block)


def _match(docs: DataFrame, sent, least: int, coverage: float, key: str) -> DataFrame:
    def match(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bench = Benchmark(sent.value, least)
        for batch in batches:
            rows = [(k, *x) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in bench.leaked(t, coverage)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [key, "item_id", "coverage", "n_tiles", "matched_words"])

    return docs.mapInArrow(match, f"{key} long, item_id long, coverage double, n_tiles long, matched_words long")


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document and item that it leaks."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    found = [_match(slim, block, least, coverage, "doc_id") for block in _blocks(benchmark, "item_id", "text")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The documents that leak no item, with all their columns: the judgement is made row by row, without a join."""
    names, out = docs.columns, docs
    for block in _blocks(benchmark, "item_id", "text"):

        def keep(batches: Iterator, sent=block) -> Iterator:
            import pyarrow as pa

            bench = Benchmark(sent.value, least)
            for batch in batches:
                yield batch.filter(pa.array([not bench.leaked(t, coverage) for t in batch.column(names.index("text")).to_pylist()], pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
