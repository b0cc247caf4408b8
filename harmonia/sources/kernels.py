"""Precomputed kernels in a folder: a Parquet table by channel pair and distance, and what they were made for.

``<folder>/kernels`` holds (i, j, v) partitioned by ch1, ch2 and d; ``<folder>/manifest.json`` names the identity
(mask, multipole, band limits, selection) and is written last, so kernels without one are never served."""

from __future__ import annotations

import io
import json
import re
import warnings
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import get_text, put_text

SCHEMA = "i int, j int, v double, ch1 string, ch2 string, d int"
# Names of kernel files of older caches, and the letters they used for direct and leaked legs.
FILE = re.compile(r"([A-Z]{2})x([A-Z]{2})_(\d+)x(\d+)\.(npy|txt)$")
OLD_LETTERS = {"E": "D", "B": "L"}


class IdentityError(ValueError):
    """Kernels on disk that were made for something else."""


def manifest(spark: SparkSession, folder: str) -> dict[str, Any] | None:
    text = get_text(spark, f"{folder}/manifest.json")
    return None if text is None else json.loads(text)


def differences(found: dict[str, Any], wanted: dict[str, Any]) -> list[str]:
    """Fields in which two identities differ; fields that only one of them names can't be compared and warn."""
    unknown = sorted(k for k in wanted if k not in found)
    if unknown:
        warnings.warn(f"kernels don't say {unknown}; taken on trust", stacklevel=3)
    return [f"{k}: {found[k]!r} on disk, {wanted[k]!r} now" for k in sorted(wanted) if k in found and found[k] != wanted[k]]


def write_kernels(spark: SparkSession, folder: str, kernels: DataFrame, identity: dict[str, Any]) -> int:
    """Add kernels (ch1, ch2, d, i, j, v) that the folder doesn't hold; returns how many (pair, distance) it holds then."""
    folder = folder.rstrip("/")
    said = manifest(spark, folder)
    if said is not None:
        if wrong := differences(said["identity"], identity):
            raise IdentityError("; ".join(wrong))
        held = spark.createDataFrame([tuple(x) for x in said["kernels"]], "ch1 string, ch2 string, d int")
        kernels = kernels.join(F.broadcast(held), ["ch1", "ch2", "d"], "left_anti")  # bounded by pairs times distances
    kernels.select("i", "j", "v", "ch1", "ch2", "d").repartition("ch1", "ch2", "d").write.mode("append").partitionBy("ch1", "ch2", "d").parquet(f"{folder}/kernels")
    every = _table(spark, folder)
    rows = every.groupBy("ch1", "ch2", "d").agg(F.max("j").alias("reach")).orderBy("ch1", "ch2", "d").collect()
    told = {"identity": identity, "reach": max((r.reach for r in rows), default=-1), "kernels": [[r.ch1, r.ch2, r.d] for r in rows]}
    put_text(spark, f"{folder}/manifest.json", json.dumps(told, sort_keys=True, indent=1))
    return len(rows)


def _table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{folder}/kernels").select("ch1", "ch2", "d", "i", "j", "v")


def read_kernels(spark: SparkSession, folder: str, identity: dict[str, Any], pairs: Sequence[tuple[str, str]] = (), dmax: int = 0) -> DataFrame:
    """(ch1, ch2, d, i, j, v) of a folder made for ``identity`` that has all ``pairs``, in either order, at all distances below ``dmax``."""
    folder = folder.rstrip("/")
    said = manifest(spark, folder)
    if said is None:
        raise FileNotFoundError(f"no kernels in {folder}")
    if wrong := differences(said["identity"], identity):
        raise IdentityError("; ".join(wrong))
    held = {tuple(x) for x in said["kernels"]}
    lost = sorted({p for p in pairs for d in range(dmax) if (*p, d) not in held and (*p[::-1], d) not in held})
    if lost:
        raise ValueError(f"kernels are missing for {lost} below distance {dmax}")
    return _table(spark, folder).where(F.col("d") < dmax) if dmax else _table(spark, folder)


def reach(spark: SparkSession, folder: str) -> int:
    """The largest multipole that the kernels have."""
    said = manifest(spark, folder.rstrip("/"))
    if said is None:
        raise FileNotFoundError(f"no kernels in {folder}")
    return said["reach"]


def read_old(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, ch1, ch2, d, i, j, v) of kernel files ``XYxZW_<l>x<l'>.npy`` or ``.txt``, one task a file.

    Letters of older names are turned into today's, and the first multipole is the central one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name = FILE.search(path)
                if name is None:
                    continue
                one, two = ("".join(OLD_LETTERS.get(c, c) for c in name[k]) for k in (1, 2))
                k = np.load(io.BytesIO(body.as_py())) if name[5] == "npy" else np.loadtxt(io.BytesIO(body.as_py()), ndmin=2)
                i, j = (x.ravel().astype(np.int32) for x in np.indices(k.shape))
                n = len(i)
                columns = [[name[5]] * n, [one] * n, [two] * n, pa.array([int(name[4]) - int(name[3])] * n, pa.int32()), pa.array(i), pa.array(j), pa.array(k.ravel().astype(float))]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in columns], names=["kind", "ch1", "ch2", "d", "i", "j", "v"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_*x*.[nt]*").load(folder).select("path", "content")
    return files.mapInArrow(run, "kind string, ch1 string, ch2 string, d int, i int, j int, v double")


def convert(spark: SparkSession, old: str, folder: str, identity: dict[str, Any]) -> int:
    """Kernel files of an older cache into a folder of today's; text and binary files of one kernel must agree.
    What was written is read again and compared; returns how many (pair, distance) the folder holds."""
    every = read_old(spark, old)
    key = ["ch1", "ch2", "d", "i", "j"]
    off = F.max(F.when(F.greatest(F.abs("lo"), F.abs("hi")) > 0, (F.col("hi") - F.col("lo")) / F.greatest(F.abs("lo"), F.abs("hi"))).otherwise(0.0))
    spread = lambda df: df.groupBy(*key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    if (worst := spread(every).agg(off.alias("off")).first()[0] or 0.0) > 0:
        raise ValueError(f"text and binary kernels differ by up to {worst:.3e}")
    once = every.dropDuplicates(key).drop("kind")
    n = write_kernels(spark, folder, once, identity)
    again = spread(once.unionByName(_table(spark, folder.rstrip("/")).join(once.select("ch1", "ch2", "d").distinct(), ["ch1", "ch2", "d"], "left_semi")))
    bad = again.agg(off.alias("off"), F.min("n").alias("n")).first()
    if (bad.off or 0.0) > 0 or (bad.n or 2) < 2:
        raise ValueError(f"kernels read back differ by up to {bad.off!r}")
    return n
