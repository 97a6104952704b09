"""Tables between steps, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees. Only in local mode, where one machine runs all, is one made if none is set."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-terrabrook-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str, outside: bool = False) -> str:
    """A path in the shared folder that no other call uses; within run_folder, and unless it is asked for outside of it, in that folder."""
    folder = None if outside else _FOLDER.get()
    return f"{folder or shared_dir(spark) + '/terrabrook'}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """What is saved within goes to one folder, which is removed at the end. A result must be written, or saved outside, before that."""
    path = f"{shared_dir(spark)}/terrabrook/run-{uuid.uuid4().hex}"
    token = _FOLDER.set(path)
    try:
        yield path
    finally:
        _FOLDER.reset(token)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, name: str, outside: bool = False) -> DataFrame:
    """df as a table in the shared folder: the lineage is cut, and a lost executor takes nothing with it."""
    path = scratch_path(df.sparkSession, name, outside)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
