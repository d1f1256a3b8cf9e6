"""Intermediate tables and files in the folder that driver and executors share.

Lineage is cut by writing a table here and reading it again, so a lost
executor costs a re-read and not a recomputation. Operators drop what nothing reads any more; what a
query's result still reads stays until release() is called or the stage that made it has ended.
"""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_UNSET = ""
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders made in each scope, for release(). A scope belongs to its thread, so queries may run side by side.
_MADE: dict[str, list[str]] = {}
_scope: ContextVar[str] = ContextVar("scope", default="query")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one in local mode; on a cluster that is an error,
    as other machines do not see the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", _UNSET)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found else "file://" + posixpath.abspath(found)


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = posixpath.join(shared_dir(spark), f"{name.replace(' ', '-')}-{uuid.uuid4().hex}")
    _MADE.setdefault(_scope.get(), []).append(path)
    return path


def _write(df: DataFrame, path: str) -> DataFrame:
    """Write df and read it again. The write's shuffle files go when it is done, not when the driver next collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN)
    conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again."""
    return _write(df, new_dir(df.sparkSession, name))


def drop(*tables: DataFrame) -> None:
    """Remove what materialise wrote for tables; nothing may read them afterwards."""
    for df in tables:
        for folder in {posixpath.dirname(f) for f in df.inputFiles()}:
            own = folder.split("://")[-1].split(":")[-1].lstrip("/")
            remove(df.sparkSession, next((p for made in _MADE.values() for p in made if p.split("://")[-1].lstrip("/") == own), folder))


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    for made in _MADE.values():
        if path in made:
            made.remove(path)


def release(spark: SparkSession, *in_use: DataFrame, scope: str | None = None) -> None:
    """Remove the folders made so far (in one scope, if it is named) but those that the tables in_use still read."""
    read = [f.split("://")[-1] for t in in_use for f in t.inputFiles()]
    for own in [scope] if scope is not None else list(_MADE):
        for path in list(_MADE.get(own, ())):
            if not any(path.split("://")[-1] in f for f in read):
                remove(spark, path)


def enter_scope(name: str, docs: DataFrame) -> None:
    """Begin a stage: earlier stages' folders go, unless docs still reads from them."""
    for scope in [s for s in _MADE if s.startswith("stage")]:
        release(docs.sparkSession, docs, scope=scope)
    _scope.set(name)


def leave_scope() -> None:
    _scope.set("query")


def filesystem(uri: str):
    """(pyarrow file system, path) for a URI of the shared folder; works on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
