"""Numerical kernels as Arrow tasks: what has no relational form runs in numpy, one task per chunk.

Inputs that every task needs (a mask or signal spectrum, one value per multipole) are collected
behind a bound: more than ``MOST_ROWS`` multipoles are refused."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import numerics as N

MOST_ROWS = 200_000


def vector(df: DataFrame, index: str, value: str, size: int | None = None) -> np.ndarray:
    """A bounded spectrum as an array, 0 where it has no row."""
    rows = df.select(F.col(index).cast("int"), F.col(value).cast("double")).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a spectrum of more than {MOST_ROWS} rows")
    out = np.zeros(max([size - 1 if size else 0, *[x[0] for x in rows]], default=0) + 1)
    for k, v in rows:
        out[k] = v
    return out[:size] if size else out


def _chunks(spark: SparkSession, n: int, per: int) -> DataFrame:
    return spark.range(0, n, per, max(1, -(-n // per))).select(F.col("id").cast("int").alias("start"))


def wigner_table(nodes: DataFrame, lmax: int, m: int, mp: int) -> DataFrame:
    """(mu, l, v) of d^l_{m mp} at each node; the recursion runs over whole Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mu = b.column(0).to_numpy()
            d = N.wigner_d(lmax, mu, m, mp)
            l = np.tile(np.arange(lmax + 1, dtype=np.int32), len(mu))  # noqa: E741
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mu, lmax + 1)), pa.array(l), pa.array(d.ravel())], names=["mu", "l", "v"])

    return nodes.select(F.col("mu").cast("double")).mapInArrow(run, "mu double, l int, v double")


def _long(parts: dict[str, np.ndarray], rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    for channel, block in parts.items():
        n = block.shape[1]
        l1, l2 = np.repeat(rows.astype(np.int32), n), np.tile(np.arange(n, dtype=np.int32), len(rows))
        yield pa.RecordBatch.from_arrays([pa.array([channel] * len(l1)), pa.array(l1), pa.array(l2), pa.array(block.ravel())], names=["channel", "l1", "l2", "v"])


def coupling_kernels(wl: DataFrame, lmax: int, *, symmetric: bool = False, rows_per_task: int = 256) -> DataFrame:
    """(channel, l1, l2, v): MASTER kernels of a mask spectrum ``wl(l, wl)``, a block of rows per task."""
    w = vector(wl, "l", "wl")
    make = N.xi_kernels if symmetric else N.master_kernels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in b.column(0).to_pylist():
                rows = np.arange(start, min(start + rows_per_task, lmax + 1))
                yield from _long(make(w, lmax, rows), rows)

    return _chunks(wl.sparkSession, lmax + 1, rows_per_task).mapInArrow(run, "channel string, l1 int, l2 int, v double")


def polspice(wl: DataFrame | None, lmax: int, theta_max: float, kind: int = 1, sigma: float | None = None, *, spark: SparkSession | None = None) -> DataFrame:
    """(channel, l1, l2, v) of the regularised kernels K0, Kp2, Km2, Kx, G0, Gp2, Gm2, Gx, Gdec, Gplus, Gminus."""
    w = None if wl is None else vector(wl, "l", "wl")
    spark = spark or wl.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _ in range(b.num_rows):
                yield from _long(N.polspice_kernels(w, lmax, theta_max, kind, sigma), np.arange(lmax + 1))

    return spark.range(1).select(F.col("id").cast("int").alias("start")).coalesce(1).mapInArrow(run, "channel string, l1 int, l2 int, v double")


def mode_power(wl: DataFrame, ell: int) -> DataFrame:
    """(m, p): what each order of degree ``ell`` sees of a mask that is symmetric about the pole, from ``wl(l, wl)`` as
    coefficients of its profile, sum (2 l + 1) / 4 pi wl P_l."""
    w = vector(wl, "l", "wl")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for degree in b.column(0).to_pylist():
                grid = N.Grid(len(w) - 1, len(w) - 1 + degree)
                window = np.repeat(N.mask_correlation(w, grid.mu)[:, None], grid.n_phi, axis=1)
                m = np.arange(-degree, degree + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(N.mode_power(window, grid, degree))], names=["m", "p"])

    return wl.sparkSession.range(ell, ell + 1, 1, 1).select(F.col("id").cast("int")).mapInArrow(run, "m int, p double")


def _spread(spark: SparkSession, units: list[tuple], schema: str) -> DataFrame:
    """One task for each unit, in the given order (dearest first)."""
    rows = spark.createDataFrame([(k, *u) for k, u in enumerate(units)], f"unit int, {schema}")
    return rows.repartitionByRange(max(1, min(len(units), 4096)), "unit")


def exact_rows(
    cl: DataFrame, mask: Callable[[np.ndarray, np.ndarray], np.ndarray], lmax: int, rows: Sequence[int], lw: int | None = None, modes_per_task: int = 64
) -> DataFrame:
    """(l1, l2, v): rows l2 of the exact TT covariance of a masked sky, ``modes_per_task`` modes of a row in a task, longest rows first.

    ``mask(mu, phi)`` gives the window on the grid; ``lw`` is its band limit (default lmax).  Parts of a row are
    summed by an aggregation, so a long row is not one long task."""
    c = vector(cl, "ell", "v", lmax + 1)
    lg = N.minimal_band(lmax, lw if lw is not None else lmax)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = N.Grid(lmax, lg)
        phi = 2 * np.pi * np.arange(grid.n_phi) / grid.n_phi
        window = mask(grid.mu[:, None], phi[None, :])
        for b in batches:
            for ell, first in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                v = N.exact_row(window, grid, c, ell, np.arange(first, min(first + modes_per_task, ell + 1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lmax + 1, dtype=np.int32)), pa.array([ell] * (lmax + 1), pa.int32()), pa.array(v)], names=["l1", "l2", "v"])

    units = [(int(x), k) for x in sorted(rows, reverse=True) for k in range(0, int(x) + 1, modes_per_task)]
    parts = _spread(cl.sparkSession, units, "ell int, first int").mapInArrow(run, "l1 int, l2 int, v double")
    return parts.groupBy("l1", "l2").agg(F.sum("v").alias("v"))


def exact_rows_polarised(
    spectra: DataFrame, mask: Callable[[np.ndarray, np.ndarray], np.ndarray], lmax: int, rows: Sequence[int], blocks: Sequence[tuple[str, str]], lw: int | None = None
) -> DataFrame:
    """(left, right, l1, l2, v): rows l2 of the exact covariance of polarised spectra ``spectra(stokes, ell, v)``, a task for each row."""
    names = [r.stokes for r in spectra.select("stokes").distinct().collect()]
    cl = {s: vector(spectra.where(F.col("stokes") == s), "ell", "v", lmax + 1) for s in names}
    lg, wanted = N.minimal_band(lmax, lw if lw is not None else lmax), list(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = N.Grid(lmax, lg)
        phi = 2 * np.pi * np.arange(grid.n_phi) / grid.n_phi
        window = mask(grid.mu[:, None], phi[None, :])
        for b in batches:
            for ell in b.column(1).to_pylist():
                for (left, right), v in N.exact_row_polarised(window, grid, cl, ell, wanted).items():
                    n = lmax + 1
                    columns = [pa.array([left] * n), pa.array([right] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array([ell] * n, pa.int32()), pa.array(v)]
                    yield pa.RecordBatch.from_arrays(columns, names=["left", "right", "l1", "l2", "v"])

    asked = _spread(spectra.sparkSession, [(int(x),) for x in sorted(rows, reverse=True)], "ell int")
    return asked.mapInArrow(run, "left string, right string, l1 int, l2 int, v double")


def eigenvalues(matrix: DataFrame) -> DataFrame:
    """(g, k, value): ascending eigenvalues of each symmetrised binned matrix (a matrix fits one task)."""

    def run(table: pa.Table) -> pa.Table:
        i, j, v = (table.column(x).to_numpy() for x in ("l1", "l2", "v"))
        index = np.unique(np.concatenate([i, j]))
        m = np.zeros((len(index), len(index)))
        m[np.searchsorted(index, i), np.searchsorted(index, j)] = v
        value = np.linalg.eigvalsh((m + m.T) / 2)
        return pa.table({"g": [table.column("g")[0].as_py()] * len(value), "k": pa.array(np.arange(len(value), dtype=np.int32)), "value": value})

    return matrix.groupBy("g").applyInArrow(run, "g string, k int, value double")


def interpolate_nodes(g: DataFrame, lmax: int, dmax: int) -> DataFrame:
    """rho[l1, l2] = PCHIP over nodes in ln l at (l1 + l2) / 2, column min(|l1 - l2|, dmax); |l1 - l2| <= dmax."""

    def run(table: pa.Table) -> pa.Table:
        d = table.column("d")[0].as_py()
        order = np.argsort(table.column("node").to_numpy())
        node, value = table.column("node").to_numpy()[order], table.column("g").to_numpy()[order]
        l1 = np.arange(1, lmax + 1 - d, dtype=np.int32)
        v = N.pchip(np.log(node), value, np.log(l1 + d / 2))
        up = pa.table({"l1": l1, "l2": l1 + np.int32(d), "v": v})
        return up if d == 0 else pa.concat_tables([up, pa.table({"l1": l1 + np.int32(d), "l2": l1, "v": v})])

    return g.where(F.col("d") <= dmax).groupBy("d").applyInArrow(run, "l1 int, l2 int, v double")


def sandwich(blocks: DataFrame, left: np.ndarray, right: np.ndarray, keys: Sequence[str]) -> DataFrame:
    """L S R^T of each long block (keys, l1, l2, v), one block per task: the dense path of a leg transform."""
    names = list(keys)

    def run(table: pa.Table) -> pa.Table:
        m = np.zeros((left.shape[1], right.shape[1]))
        m[table.column("l1").to_numpy(), table.column("l2").to_numpy()] = table.column("v").to_numpy()
        out = left @ m @ right.T
        l1, l2 = np.indices(out.shape)
        head = {k: pa.repeat(table.column(k)[0], out.size) for k in names}
        return pa.table(head | {"l1": l1.ravel().astype(np.int32), "l2": l2.ravel().astype(np.int32), "v": out.ravel()})

    types = dict(blocks.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in names] + ["l1 int", "l2 int", "v double"])
    return blocks.groupBy(*names).applyInArrow(run, schema)
