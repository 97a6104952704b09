"""Results kept as tables, for requests that are made again.

A result is named by a fingerprint of its plan, of parameters, and of the input files as they are (path, length, time of change). Its generations are marker files beside the
tables: `1.json`, `2.json` and so on, each made by the file system's exclusive create, so of several who compute the same result one wins and the others read that one's table.
A generation older than its time to live is made anew; tables that others may still read are removed by `sweep` alone. Empty results aren't kept unless asked for.
Everything lies in the folder that all machines share and is reached through Spark's file systems.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Mapping
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .scratch import shared_dir


class _Files:
    """The shared folder's file system."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def at(self, path: str) -> tuple[Any, Any]:
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, path: str) -> list[str]:
        fs, p = self.at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def status(self, path: str) -> tuple[str, int, int]:
        fs, p = self.at(path)
        s = fs.getFileStatus(p)
        return s.getPath().toString(), s.getLen(), s.getModificationTime()

    def read(self, path: str) -> str:
        fs, p = self.at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Whether the file wasn't there and is now."""
        fs, p = self.at(path)
        try:
            stream = fs.create(p, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, path: str) -> None:
        fs, p = self.at(path)
        fs.delete(p, True)


def fingerprint(df: DataFrame, params: Mapping[str, Any]) -> str:
    """Equal for equal plans over unchanged files with equal parameters."""
    files = _Files(df.sparkSession)
    plan = df._jdf.queryExecution().analyzed().canonicalized().treeString()
    state = [plan, json.dumps(params, sort_keys=True, default=str), df.schema.json(), *sorted(files.status(f) for f in df.inputFiles())]
    return hashlib.sha256(repr(state).encode()).hexdigest()


def _generation(name: str) -> int:
    return int(name[:-5]) if name.endswith(".json") and name[:-5].isdigit() else 0


def cached(df: DataFrame, params: Mapping[str, Any], ttl: float = 600.0, keep_empty: bool = False, now: float | None = None) -> DataFrame:
    """df, or the table of the same result if one younger than `ttl` seconds is kept."""
    spark, now = df.sparkSession, time.time() if now is None else now
    files, root = _Files(spark), f"{shared_dir(spark)}/terrabrook/cache/{fingerprint(df, params)}"
    last = max(map(_generation, files.names(root)), default=0)
    if last:
        entry = json.loads(files.read(f"{root}/{last}.json") or "{}")
        if entry and now - entry["made"] < ttl:
            return spark.read.schema(df.schema).parquet(entry["table"])
    table = f"{root}/table-{uuid.uuid4().hex}"
    df.write.parquet(table)
    made = spark.read.schema(df.schema).parquet(table)
    if not keep_empty and made.isEmpty():
        return made
    if files.create(f"{root}/{last + 1}.json", json.dumps({"made": now, "table": table, "ttl": ttl})):
        return made
    for _ in range(50):  # someone else was first; their marker may still be empty
        if text := files.read(f"{root}/{last + 1}.json"):
            files.delete(table)
            return spark.read.schema(df.schema).parquet(json.loads(text)["table"])
        time.sleep(0.1)
    return made


def sweep(spark: SparkSession, grace: float = 3600.0, now: float | None = None) -> int:
    """Removes results that are past their time by `grace` seconds. Returns how many."""
    files, now, gone = _Files(spark), time.time() if now is None else now, 0
    top = f"{shared_dir(spark)}/terrabrook/cache"
    for name in files.names(top):
        markers = [m for m in files.names(f"{top}/{name}") if _generation(m)]
        entries = {m: json.loads(files.read(f"{top}/{name}/{m}") or "{}") for m in markers}
        old = [m for m, e in entries.items() if e and now - e["made"] > e["ttl"] + grace]
        if len(old) == len(markers):
            files.delete(f"{top}/{name}")
        else:
            for m in old:
                if _generation(m) < max(map(_generation, markers)):  # the last one keeps its number
                    files.delete(entries[m]["table"])
                    files.delete(f"{top}/{name}/{m}")
        gone += len(old)
    return gone
