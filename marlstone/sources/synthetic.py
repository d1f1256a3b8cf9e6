"""Seeded corpora, made by rule on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _unit(seed: int, *salt):
    """A number in [0, 1) fixed by the row's id and the seed."""
    return F.pmod(F.xxhash64("id", F.lit(seed), *map(F.lit, salt)), F.lit(1 << 52)) / float(1 << 52)


def long_tail_pairs(spark: SparkSession, rows: int, keys: int, actors: int, seed: int = 7) -> DataFrame:
    """(k, actor): keys fall off as u^4, so a few are hot."""
    k = F.floor(F.pow(_unit(seed, 1), 4.0) * keys).cast("long")
    return spark.range(rows).select(k.alias("k"), F.floor(_unit(seed, 2) * actors).cast("long").alias("actor"))


def zipf_keys(spark: SparkSession, rows: int, keys: int, power: float = 1.08, seed: int = 7) -> DataFrame:
    """(id, k): keys of a Zipf-like law by the inverse of its continuous distribution."""
    a = 1.0 - power
    top = float(keys) ** a
    return spark.range(rows).select("id", F.least(F.lit(keys - 1), F.floor(F.pow(1 + _unit(seed) * (top - 1), 1 / a) - 1)).cast("long").alias("k"))


def search_corpus(spark: SparkSession, rows: int, words: list[str], seed: int = 7) -> DataFrame:
    """(id, name): four words each."""
    w = F.array(*map(F.lit, words))
    pick = lambda i: F.element_at(w, F.floor(_unit(seed, i) * len(words)).cast("int") + 1)
    return spark.range(rows).select("id", F.concat_ws(" ", *[pick(i) for i in range(4)]).alias("name"))
