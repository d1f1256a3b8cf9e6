"""Readers of files in the engine's formats, as DataFrames. Files are dealt one by one; each is decoded in its task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import codecs


def decoded(files: DataFrame, decode: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of decode(content) for each row of files (path, content)."""

    want = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [(path, *x) for x in decode(raw)]
                for at in range(0, len(rows), 50_000):
                    columns = zip(*rows[at : at + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, want)], schema=want)

    return files.select("path", "content").mapInArrow(run, schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def _batch(raw: bytes):
    day, hour, pairs = codecs.decode_batch(raw)
    return ((day * 24 + hour, h, a) for h, a in pairs)


def heat_batches(spark: SparkSession, path: str) -> DataFrame:
    return decoded(_files(spark, path), _batch, "path string, unix_hour long, info_hash binary, actor long")


def overlays(spark: SparkSession, path: str) -> DataFrame:
    return decoded(_files(spark, path), codecs.decode_overlay, "path string, kind string, info_hash binary")


def spool(spark: SparkSession, path: str) -> DataFrame:
    return decoded(_files(spark, path), lambda raw: ((i, p) for i, p in enumerate(codecs.decode_spool(raw)[0])), "path string, ordinal long, payload binary")


def runtime_lines(lines: DataFrame) -> DataFrame:
    """(ts, values) of lines (value) '<time> runtime 30s: k=v ...'; other lines are left out."""
    from ..functions.text import key_values

    line = r"^(\S+(?: \S+)?)\s+runtime \d+s: (.*)$"
    found = lines.select(F.regexp_extract("value", line, 1).alias("ts"), F.regexp_extract("value", line, 2).alias("rest")).where("ts <> ''")
    return found.select(F.try_to_timestamp(F.col("ts")).alias("ts"), key_values(F.col("rest")).alias("values"))


def runtime_log(spark: SparkSession, path: str) -> DataFrame:
    return runtime_lines(spark.read.text(path))


def host_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, nanValue="nan")


def run_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines that parse and have a manifest and a result."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("manifest is not null and result is not null")


def strict_json(df: DataFrame, column: str, schema: str, keys: list[str]) -> DataFrame:
    """(parsed, error): a body must parse and have just the given keys, each once."""
    found = F.json_object_keys(column)
    parsed = F.from_json(column, schema)
    bad = F.when(found.isNull(), "not an object").when(F.size(F.array_except(found, F.array(*map(F.lit, keys)))) > 0, "unknown key").when(F.size(found) != F.size(F.array_distinct(found)), "repeated key")
    return df.select("*", parsed.alias("parsed"), bad.alias("error"))
