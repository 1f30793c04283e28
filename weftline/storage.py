"""Tables kept between stages, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables written since the innermost ``finished`` began.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder only where that is
    unset and the master is local, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = os.path.join(tempfile.gettempdir(), f"weftline-{os.getpid()}")
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the plan is
    cut there and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weftline/{name}-{uuid.uuid4().hex}"
    if (written := _written.get()) is not None:
        written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a stored table; nothing happens if it isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, as a stored table; the tables it stored on its way are deleted."""
    token = _written.set(paths := [])
    try:
        out = make()
    finally:
        _written.reset(token)
    try:
        return stored(out, name)
    finally:
        for path in paths:
            delete(out.sparkSession, path)


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Arrow batches of at most n rows in what is executed inside: for wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(n, int(before)) if int(before) > 0 else n)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
