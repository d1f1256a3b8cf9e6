"""A corpus pipeline over documents: quality rules, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller writes as Parquet and reads again as
the next stage's docs. A stage's intermediate tables go when the next one begins.

1. quality rules: documents that the adaptive rules reject go;
2. n-gram Jaccard join: of each group of linked documents the smallest doc_id stays;
3. benchmark decontamination: documents that leak a benchmark item go;
4. secret scans: live-looking secrets are masked in the text, and n_chars follows it;
5. best-fit packing: the result, one row for each piece.

No SQL here gives run()'s rows (KLL sketches, tiling and packing have none), so ORACLE_SQL is None and the tests hold
the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, jaccard_join, packing, quality_rules, secret_scan, store
from marlstone.llm.queries import tokenizer_path


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    store.enter_scope("stage-1", docs)
    return quality_rules.filter_quality(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    store.enter_scope("stage-2", docs)
    return jaccard_join.keep_one(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    store.enter_scope("stage-3", docs)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    store.enter_scope("stage-4", docs)
    masked = secret_scan.mask_live(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    store.enter_scope("stage-5", docs)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", _quality),
    ("n-gram Jaccard join", _near_duplicates),
    ("benchmark decontamination", _decontaminate),
    ("secret scans", _secrets),
    ("best-fit packing", _pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = store.materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            store.drop(before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    store.drop(docs)  # the last stage has written its pieces
    store.leave_scope()
    return out
