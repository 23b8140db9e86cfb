"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list[str]] = []


def folder(spark: SparkSession) -> str:
    """This application's own folder under spark.checkpoint.dir; where that is unset, and only on one machine, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all its machines share")
        base = f"file://{tempfile.mkdtemp(prefix='docspark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/docspark-{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete what this application has written so far, once no result of it is to be read any more."""
    delete(spark, folder(spark))


def written(df: DataFrame, name: str = "table", compression: str = "snappy") -> DataFrame:
    """df, written to the shared folder and read back: it is computed once, and a lost executor costs nothing. It stays until clear()."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._docspark_path = path
    if _open:
        _open[-1].append(path)
    return out


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is written within goes at its end, but for the tables that were passed to the function it gives.

    For operators that write several tables on the way to one: whatever is kept must be written itself, and read no other.
    """
    paths: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._docspark_path)
        return df

    _open.append(paths)
    try:
        yield keep
    finally:
        _open.pop()
        for path in set(paths) - set(kept):
            delete(spark, path)
        if _open:  # whoever is around this one may let go of them
            _open[-1].extend(kept)
