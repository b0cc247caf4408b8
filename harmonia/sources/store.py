"""Caches keyed by what a result depends on, result files, run records and versioned folders."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def identity(of: dict[str, Any]) -> str:
    """Twelve hex digits of a canonical JSON document."""
    return hashlib.blake2b(json.dumps(of, sort_keys=True, separators=(",", ":"), default=str).encode(), digest_size=6).hexdigest()


def cached(spark: SparkSession, folder: str, name: str, of: dict[str, Any], compute: Callable[[], DataFrame]) -> DataFrame:
    """A Parquet table computed once for each identity.  The manifest is a column-less sibling table
    written last through Spark, so a broken write is never served and any file system works."""
    path = f"{folder.rstrip('/')}/{name}.k{identity(of)}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(done):
        compute().write.mode("overwrite").parquet(path)
        spark.createDataFrame([(json.dumps(of, sort_keys=True, default=str),)], "identity string").coalesce(1).write.mode("overwrite").json(f"{path}.manifest")
    return spark.read.parquet(path)


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small text file of any file system that Spark reads; None if there is none."""
    where, fs = _file(spark, path)
    if not fs.exists(where):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file next to its place and move it there."""
    where, fs = _file(spark, path)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(where, False)
    if not fs.rename(draft, where):
        raise OSError(f"can't write {path}")


def digest(values: np.ndarray) -> str:
    return hashlib.blake2b(np.ascontiguousarray(values, float).tobytes(), digest_size=16).hexdigest()


def table_text(rows: np.ndarray) -> str:
    return "\n".join(" ".join(f"{x:.18e}" for x in np.atleast_1d(r)) for r in rows) + "\n"


def versioned(spark: SparkSession, base: str, name: str, overwrite: int | None = None) -> str:
    """v0, v1, ...: the highest one there is while ``name`` isn't in it, else the next; or the one asked for.

    Gaps between numbers don't matter."""
    where, fs = _file(spark, base)
    if overwrite is not None:
        path = f"{base}/v{overwrite}"
    else:
        there = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        last = max((int(x[1:]) for x in there if x[:1] == "v" and x[1:].isdigit()), default=None)
        path = f"{base}/v{last or 0}"
        if last is not None and fs.exists(_file(spark, f"{path}/{name}")[0]):
            path = f"{base}/v{last + 1}"
    fs.mkdirs(_file(spark, path)[0])
    return path


class RunRecord:
    """Parameters, derived values and provenance of a run; written even when the run fails."""

    def __init__(self, params: dict[str, Any]):
        self.parts: dict[str, dict] = {"parameters": dict(params), "derived": {}, "provenance": {}}

    def add(self, part: str, **values) -> None:
        self.parts[part].update(values)

    def write(self, spark: SparkSession, path: str) -> None:
        import yaml

        put_text(spark, path, yaml.safe_dump(json.loads(json.dumps(self.parts, default=str)), sort_keys=False))
