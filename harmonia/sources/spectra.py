"""Spectrum, beam, window, transfer and noise inputs as long DataFrames (…, ell, v)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as C

# Meaning of the columns of 1-, 4- and 9-column spectrum files, and a mirror's fallback.
LAYOUTS = {1: ("TT",), 4: ("TT", "EE", "BB", "TE"), 9: ("TT", "EE", "BB", "TE", "TB", "EB", "ET", "BT", "BE")}
MIRROR = {"ET": "TE", "BT": "TB", "BE": "EB"}


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(ell, col, v) of a white-space table: first column the multipole, '#' starts a comment."""
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    parts = F.split(line, r"\s+")
    rows = spark.read.text(path).where(line != "").select(parts.alias("p"))
    each = rows.select(F.col("p")[0].cast("double").cast("int").alias("ell"), F.posexplode(F.slice("p", 2, 1 << 20)).alias("col", "x"))
    return each.select("ell", F.col("col").cast("int").alias("col"), F.col("x").cast("double").alias("v"))


def parse_fits_table(data: bytes) -> dict[str, np.ndarray]:
    """Columns of the first binary table of a FITS file; vector columns are flattened."""
    return parse_fits(data)[1]


def parse_fits(data: bytes) -> tuple[dict[str, str], dict[str, np.ndarray]]:
    """Header and columns of the first binary table of a FITS file."""
    at = 0
    while at < len(data):
        cards, k = {}, at
        while True:
            block = data[k : k + 2880].decode("ascii", "replace")
            k += 2880
            for i in range(0, len(block), 80):
                key, _, value = block[i : i + 80].partition("=")
                cards.setdefault(key.strip(), value.split("/")[0].strip().strip("'").strip())
            if "END" in cards or k >= len(data):
                break
        axes = [int(cards.get(f"NAXIS{i + 1}", 0)) for i in range(int(cards.get("NAXIS", 0) or 0))]
        size = abs(int(cards.get("BITPIX", 8))) // 8 * int(np.prod(axes)) if axes else 0
        if cards.get("XTENSION", "").startswith("BINTABLE"):
            kinds = {"E": ">f4", "D": ">f8", "J": ">i4", "K": ">i8", "I": ">i2", "B": "u1"}
            names, fields = [], []
            for i in range(int(cards["TFIELDS"])):
                form = cards[f"TFORM{i + 1}"]
                n = int(form[:-1] or 1)
                names.append(cards.get(f"TTYPE{i + 1}", f"c{i}"))
                fields.append((f"f{i}", kinds[form[-1]], (n,)))
            table = np.frombuffer(data[k : k + size], np.dtype(fields), count=axes[1])
            return cards, {n: table[f"f{i}"].astype(float).ravel() for i, n in enumerate(names)}
        at = k + -(-size // 2880) * 2880
    raise ValueError("no binary table in the FITS file")


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """(ell, col, v) of a FITS spectrum table that starts at multipole 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column(0):
                for k, v in enumerate(parse_fits_table(body.as_py()).values()):
                    n = np.arange(len(v), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(np.full(len(v), k, np.int32)), pa.array(v)], names=["ell", "col", "v"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "ell int, col int, v double")


def read_spectrum(spark: SparkSession, path: str) -> DataFrame:
    """Any spectrum file by its extension."""
    if path.endswith((".txt", ".dat")):
        return read_text(spark, path)
    if path.endswith((".fits", ".fit")):
        return read_fits(spark, path)
    if path.endswith(".npy"):
        raise NotImplementedError("spectra in .npy files are not read; use text or FITS")
    raise ValueError(f"unknown spectrum file type: {path}")


def checked(table: DataFrame, lmax: int, path: str) -> DataFrame:
    """The table up to lmax - 1: multipoles must be consecutive and reach it; missing low ones are 0."""
    s = table.where("col = 0").agg(F.min("ell"), F.max("ell"), F.count("*"), F.countDistinct("ell")).first()
    if s[0] is None:
        raise ValueError(f"{path} has no rows")
    if s[2] != s[3] or s[1] - s[0] + 1 != s[2]:
        raise ValueError(f"{path}: multipoles are not consecutive")
    if s[1] < lmax - 1:
        raise ValueError(f"{path} ends at multipole {s[1]}; {lmax - 1} is needed")
    grid = table.select("col").distinct().crossJoin(table.sparkSession.range(lmax).select(F.col("id").cast("int").alias("ell")))
    return grid.join(table, ["col", "ell"], "left").select("ell", "col", F.coalesce("v", F.lit(0.0)).alias("v"))


def by_stokes(table: DataFrame, wanted: Sequence[str], path: str) -> DataFrame:
    """(stokes, ell, v): pick columns by the file's layout; mirrors fall back, absent odd parity is 0."""
    n = table.agg(F.max("col")).first()[0] + 1
    if n not in LAYOUTS:
        raise ValueError(f"{path} has {n} spectrum columns; 1, 4 or 9 are understood")
    layout = LAYOUTS[n]
    pick = []
    for s in wanted:
        name = s if s in layout else MIRROR.get(s, s[::-1])
        if name in layout:
            pick.append((s, layout.index(name), 1.0))
        elif s in ("TB", "BT", "EB", "BE"):
            pick.append((s, 0, 0.0))
        else:
            raise ValueError(f"{path} has no {s} column")
    dim = table.sparkSession.createDataFrame(pick, "stokes string, col int, x double")
    return table.join(F.broadcast(dim), "col").select("stokes", "ell", (F.col("v") * F.col("x")).alias("v"))


def has_parity_odd(spark: SparkSession, path: str) -> bool:
    """Whether TB or EB is non-zero anywhere in the whole file."""
    t = read_spectrum(spark, path)
    n = t.agg(F.max("col")).first()[0]
    if n is None or n + 1 != 9:
        return False
    return bool(t.where(F.col("col").isin(*[k for k, s in enumerate(LAYOUTS[9]) if s in ("TB", "EB", "BT", "BE")]) & (F.col("v") != 0)).limit(1).count())


def grid(spark: SparkSession, lmax: int) -> DataFrame:
    return spark.range(lmax).select(F.col("id").cast("int").alias("ell"))


def signal(spark: SparkSession, source: Any, wanted: Sequence[str], lmax: int, units: str) -> DataFrame:
    """(stokes, ell, v) in C units from a file, a constant or a constant for each Stokes pair."""
    if isinstance(source, str):
        t = by_stokes(checked(read_spectrum(spark, source), lmax, source), wanted, source)
        return t.select("stokes", "ell", C.to_cl("ell", "v", units).alias("v"))
    if units == "Dl":
        raise ValueError("constant spectra can't be in Dl units")
    values = dict.fromkeys(wanted, 0.0 if source is None else float(source)) if not isinstance(source, Mapping) else source
    if unknown := set(values) - set(LAYOUTS[9]):
        raise ValueError(f"unknown spectra {sorted(unknown)}")
    dim = spark.createDataFrame([(s, float(values.get(s, values.get(s[::-1], 0.0)))) for s in wanted], "stokes string, v double")
    return grid(spark, lmax).crossJoin(F.broadcast(dim)).select("stokes", "ell", "v")


def per_pair(spark: SparkSession, template: str | None, pairs: Sequence[str], wanted: Sequence[str], lmax: int, units: str, default: float = 0.0) -> DataFrame:
    """(pair, stokes, ell, v) of one file for each frequency pair; without a template the default."""
    parts = []
    for p in pairs:
        t = signal(spark, None if template is None else template.format(p), wanted, lmax, units if template else "Cl")
        parts.append(t.select(F.lit(p).alias("pair"), "stokes", "ell", (F.col("v") if template else F.lit(float(default))).alias("v")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def beams(spark: SparkSession, source: Any, freqs: Sequence[str], lmax: int) -> DataFrame:
    """(f, ell, b): Gaussian beams of widths in arc minutes, a file with one column a frequency, or 1."""
    if isinstance(source, str):
        t = checked(read_spectrum(spark, source), lmax, source)
        dim = spark.createDataFrame([(f, k) for k, f in enumerate(freqs)], "f string, col int")
        return t.join(F.broadcast(dim), "col").select("f", "ell", F.col("v").alias("b"))
    if isinstance(source, Mapping):
        if lost := set(freqs) - set(source):
            raise ValueError(f"no beam for {sorted(lost)}")
        dim = spark.createDataFrame([(f, float(source[f])) for f in freqs], "f string, fwhm double")
        return grid(spark, lmax).crossJoin(F.broadcast(dim)).select("f", "ell", C.gaussian_beam("ell", "fwhm").alias("b"))
    dim = spark.createDataFrame([(f,) for f in freqs], "f string")
    return grid(spark, lmax).crossJoin(F.broadcast(dim)).select("f", "ell", F.lit(1.0).alias("b"))


def pixel_window(spark: SparkSession, source: Any, lmax: int) -> DataFrame:
    """(ell, pt, pp) from a file of one or two columns, else 1.  Tabulated windows by resolution
    aren't shipped: give their file."""
    if source is None:
        return grid(spark, lmax).select("ell", F.lit(1.0).alias("pt"), F.lit(1.0).alias("pp"))
    if not isinstance(source, str):
        raise NotImplementedError("pixel windows by resolution need their table; give its file")
    t = checked(read_spectrum(spark, source), lmax, source)
    wide = t.groupBy("ell").agg(F.max(F.when(F.col("col") == 0, F.col("v"))).alias("pt"), F.max(F.when(F.col("col") == 1, F.col("v"))).alias("p2"))
    return wide.select("ell", "pt", F.coalesce("p2", "pt").alias("pp"))


def transfer(spark: SparkSession, template: str | None, pairs: Sequence[str], wanted: Sequence[str], lmax: int) -> DataFrame:
    """(pair, stokes, ell, v) in [0, 1]; anything else fails and names the first bad multipole."""
    t = per_pair(spark, template, pairs, wanted, lmax, "Cl", 1.0)
    bad = t.where(F.isnan("v") | (F.col("v") < 0) | (F.col("v") > 1)).agg(F.min_by(F.struct("pair", "stokes", "ell", "v"), "ell").alias("b")).first()[0] if template else None
    if bad:
        raise ValueError(f"transfer function of {bad.pair} {bad.stokes} is {bad.v} at multipole {bad.ell}; it must lie in [0, 1]")
    return t


def noise(spark: SparkSession, source: Any, freqs: Sequence[str], lmax: int, units: str = "Cl") -> DataFrame:
    """(f, stokes, ell, v): white levels {f: s} (polarisation has twice the power), {f: [s_T, s_P]} or
    a file template by frequency pair; only equal fields of one frequency have noise."""
    letters = ("TT", "EE", "BB")
    if source is None:
        source = {}
    if isinstance(source, str):
        parts = per_pair(spark, source, [f + f for f in freqs], letters, lmax, units)
        dim = spark.createDataFrame([(f + f, f) for f in freqs], "pair string, f string")
        return parts.join(F.broadcast(dim), "pair").select("f", "stokes", "ell", "v")
    if unknown := set(source) - set(freqs):
        raise ValueError(f"noise is keyed by single frequencies; unknown {sorted(unknown)}")
    rows = []
    for f in freqs:
        level = source.get(f, 0.0)
        pair = isinstance(level, (list, tuple))
        t, p = (float(level[0]), float(level[1])) if pair else (float(level), float(level) * math.sqrt(2))
        rows += [(f, "TT", t), (f, "EE", p), (f, "BB", p)]
    dim = spark.createDataFrame(rows, "f string, stokes string, s double")
    return grid(spark, lmax).crossJoin(F.broadcast(dim)).select("f", "stokes", "ell", C.white_noise("s").alias("v"))


def corrections(spark: SparkSession, source: Any, wanted: Sequence[str], lmax: int) -> DataFrame:
    """(stokes, ell, v): product of the correction files, 1 where there is none."""
    paths = [] if source is None else [source] if isinstance(source, str) else list(source.values())
    out = signal(spark, 1.0, wanted, lmax, "Cl")
    for p in paths:
        t = by_stokes(checked(read_spectrum(spark, p), lmax, p), wanted, p).withColumnRenamed("v", "w")
        out = out.join(t, ["stokes", "ell"], "left").select("stokes", "ell", (F.col("v") * F.coalesce("w", F.lit(1.0))).alias("v"))
    return out
