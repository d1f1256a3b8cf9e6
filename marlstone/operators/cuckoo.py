"""Cuckoo filters over key sets: a fast answer for keys that are surely new, and snapshots of the filters.

A filter never denies a key that it holds. So what it denies is new without a join, and only what it does not deny is
confirmed against the exact table. Keys are dealt to shards by hash, so a filter is bounded and is built in one task.
"""

from __future__ import annotations

import gzip
import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS, KICKS, LOAD = 4, 500, 0.9
_MAGIC = b"CKOO0001"


class Full(ValueError):
    """The filter has no room for a key."""


class CuckooFilter:
    """16-bit fingerprints in buckets of SLOTS; a fingerprint's two buckets add up to an odd number of its own, modulo an even count."""

    def __init__(self, buckets: int):
        self.n = buckets + buckets % 2
        self.table = np.zeros((self.n, SLOTS), "<u2")

    @classmethod
    def for_keys(cls, count: int) -> CuckooFilter:
        return cls(max(2, int(count / SLOTS / LOAD) + 1))

    @staticmethod
    def _print(key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 >> 48 & 0xFFFF) or 1

    def _places(self, key: int) -> tuple[int, int, int]:
        fp, first = self._print(key), key % self.n
        return fp, first, self._other(first, fp)

    def _other(self, at: int, fp: int) -> int:
        return ((fp * 0x5BD1E995 | 1) - at) % self.n

    def add(self, key: int, draw: np.random.Generator) -> None:
        fp, a, b = self._places(key)
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = fp
                return
        at = a if draw.random() < 0.5 else b
        for _ in range(KICKS):
            slot = int(draw.integers(SLOTS))
            fp, self.table[at, slot] = int(self.table[at, slot]), fp
            at = self._other(at, fp)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = fp
                return
        raise Full(f"no room after {KICKS} moves")

    def may_hold(self, key: int) -> bool:
        fp, a, b = self._places(key)
        return bool((self.table[a] == fp).any() or (self.table[b] == fp).any())

    def snapshot(self) -> bytes:
        """Header, digest and the compressed table."""
        raw = self.table.tobytes()
        return _MAGIC + struct.pack("<Q", self.n) + hashlib.sha256(raw).digest() + gzip.compress(raw, 6, mtime=0)

    @classmethod
    def restore(cls, raw: bytes) -> CuckooFilter:
        """The filter of a snapshot; ValueError if it is cut short or altered."""
        try:
            n, digest, table = struct.unpack_from("<Q", raw, 8)[0], raw[16:48], gzip.decompress(raw[48:])
        except (struct.error, OSError, EOFError) as broken:
            raise ValueError("a snapshot is cut short") from broken
        if raw[:8] != _MAGIC or hashlib.sha256(table).digest() != digest or len(table) != 2 * SLOTS * n:
            raise ValueError("a snapshot is altered")
        made = cls(n)
        made.table = np.frombuffer(table, "<u2").reshape(n, SLOTS).copy()
        return made


def build_filter(keys: list[int]) -> CuckooFilter:
    """A filter of all keys; one that comes out full is built anew with more room."""
    size = len(keys)
    while True:
        made, draw = CuckooFilter.for_keys(size), np.random.default_rng(7)
        try:
            for k in keys:
                made.add(k, draw)
            return made
        except Full:
            size = int(size * 1.3) + 8


def _sharded(df: DataFrame, column: str, shards: int) -> DataFrame:
    h = F.xxhash64(column)
    return df.withColumn("shard", F.pmod(h, F.lit(shards)).cast("int")).withColumn("hash", h)


def filters(known: DataFrame, column: str, shards: int = 64) -> DataFrame:
    """(shard, snapshot) of the known keys: the exact store rebuilt as filters."""

    def build(key, table):
        import pyarrow as pa

        made = build_filter([x & 0x7FFFFFFFFFFFFFFF for x in table.column("hash").to_pylist()])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "snapshot": pa.array([made.snapshot()], pa.binary())})

    own = _sharded(known.select(column).where(F.col(column).isNotNull()).distinct(), column, shards).select("shard", "hash")
    return own.groupBy("shard").applyInArrow(build, "shard int, snapshot binary")


def new_keys(candidates: DataFrame, known: DataFrame, column: str, snapshots: DataFrame, shards: int = 64) -> DataFrame:
    """Distinct candidate keys that known does not hold, with how it was told: denied by a filter, or confirmed by the table.

    A shard whose snapshot is missing or does not restore denies nothing, so all its keys are confirmed.
    """
    own = _sharded(candidates.select(column).where(F.col(column).isNotNull()).distinct(), column, shards).select("shard", "hash", column)

    def probe(key, left, right):
        import pyarrow as pa

        try:
            held = CuckooFilter.restore(right.column("snapshot")[0].as_py()) if len(right) else None
        except ValueError:
            held = None
        maybe = [held is None or held.may_hold(x & 0x7FFFFFFFFFFFFFFF) for x in left.column("hash").to_pylist()]
        return left.drop_columns(["shard", "hash"]).append_column("maybe", pa.array(maybe, pa.bool_()))

    schema = own.select(column).schema.add("maybe", "boolean")
    told = own.groupBy("shard").cogroup(snapshots.groupBy("shard")).applyInArrow(probe, schema)
    exact = known.select(F.col(column).alias("known_key")).distinct()
    sure = told.where("not maybe").select(column, F.lit("denied").alias("how"))
    left = told.where("maybe").join(exact, F.col(column) == F.col("known_key"), "left_anti").select(column, F.lit("confirmed").alias("how"))
    return sure.unionByName(left)
