"""Bounded-space online best-fit packing of token pieces into sequences.

A packer holds a fixed number of open bins, in a bitset keyed by free space. A
piece goes to the open bin with the least free space that holds it. When all
bins are open and none holds the piece, the fullest one closes.

Defined results: a null or empty text is one piece of only the end id; repeated
rows are packed each; a null id packs as any other; an empty table gives an
empty result; extra columns are ignored. Pieces are cut from the end, so
that only the first piece of a long document may be shorter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .token_ids import encoder

CAPACITY = 2048
OPEN_BINS = 1024
END = 0
#: Pieces that one packer takes; more pieces make more packers.
PER_PACKER = 250_000


class BestFit:
    """Open bins by free space: a bitset of the spaces that occur, and the bins of each."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.open, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        found = self.bins[space].pop()
        if not self.bins[space]:
            self.bits &= ~(1 << space)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} does not fit a sequence of {self.capacity}")
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            found = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            found, space = self.made, self.capacity
            self.made += 1
        if left := space - length:
            self.bins[left].append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.capacity - space


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        enc, tail = encoder(tokenizer), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.stream(batch.column(1).to_pylist())):
                ids += tail
                n = len(ids) // 4
                first = n % capacity or min(n, capacity)
                at = 0
                for k, stop in enumerate(range(first, n + 1, capacity)):
                    rows.append((doc, k, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])))
                    at = stop
            made = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))] if rows else []
            if made:
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(held: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_packer: int = PER_PACKER) -> DataFrame:
    """held (written, with doc_id, piece, length) with sequence_id and offset.

    Pieces are dealt evenly by hash. Each packer takes its own in rounds of about open_bins pieces, also dealt by
    hash, and in a round the longest first: so long pieces do not close the open bins before short ones arrive, and a
    re-run of a lost task gives the same sequences. Sequence ids of different packers do not meet.
    """
    n = held.count()
    packers = max(1, math.ceil(n / per_packer))
    rounds = max(1, math.ceil(n / packers / open_bins))
    names = held.columns

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            put = [fit.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + b for b, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())],
                [*names, "sequence_id", "offset"],
            )

    dealt = held.repartition(packers, F.xxhash64("doc_id", "piece", "ids_crc32")) if packers > 1 else held.coalesce(1)
    turn = F.pmod(F.xxhash64(F.lit("round"), "doc_id", "piece", "ids_crc32"), F.lit(rounds))
    ordered = dealt.sortWithinPartitions(turn, F.desc("length"), "doc_id", "piece", "ids_crc32")
    schema = held.schema.add("sequence_id", "long").add("offset", "long")
    return ordered.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(store.materialise(pieces(docs, tokenizer), "pieces"))
