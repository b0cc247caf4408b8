"""Masks on the sphere: ring geometry, mask spectra, precomputed couplings, ring filters and probes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import numerics as N


def ring_layout(nside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cos theta, first longitude, pixels) of the 4 nside - 1 rings of an equal-area pixelisation."""
    i = np.arange(1, 4 * nside)
    north = np.minimum(i, 4 * nside - i)
    cap = north < nside
    z = np.where(cap, 1 - north**2 / (3 * nside**2), 4 / 3 - 2 * north / (3 * nside))
    z = np.where(i > 2 * nside, -z, z)
    n = np.where(cap, 4 * north, 4 * nside)
    shift = np.where(cap, 0.5, np.where((i - nside) % 2 == 0, 0.5, 0.0))
    return z, shift * 2 * math.pi / n, n


def map_alm(values: np.ndarray, lmax: int, iterations: int = 3, block: int = 16) -> np.ndarray:
    """Coefficients a[l, m >= 0] of a ring-ordered map: equal weights, then Jacobi corrections.

    Legendre tables are made for ``block`` orders at a time and thrown away; pixels that aren't numbers, or
    are the marker of unseen ones, count as 0 (``clean`` counts them)."""
    values = clean(values)[0]
    nside = math.isqrt(len(values) // 12)
    if 12 * nside * nside != len(values):
        raise ValueError("not a whole sphere of equal-area pixels")
    z, phi0, n = ring_layout(nside)
    starts = np.concatenate([[0], np.cumsum(n)])
    m = np.arange(lmax + 1)
    turn = np.exp(1j * np.outer(phi0, m))

    def to_rings(x):
        return np.stack([np.fft.fft(x[starts[r] : starts[r + 1]])[m % n[r]] for r in range(len(z))]) * turn.conj()

    def to_map(rows):
        out = np.empty(len(values))
        phase = rows * turn * np.where(m == 0, 1, 2)
        for r in range(len(z)):
            spec = np.zeros(n[r], complex)
            np.add.at(spec, m % n[r], phase[r])
            out[starts[r] : starts[r + 1]] = (np.fft.ifft(spec) * n[r]).real
        return out

    def by_orders(work):
        for at in range(0, lmax + 1, block):
            own = np.arange(at, min(at + block, lmax + 1))
            for k, table in zip(own, N.harmonics(lmax, z, own), strict=True):
                work(k, table)

    a, left = np.zeros((lmax + 1, lmax + 1), complex), values
    for step in range(iterations + 1):
        rings, rows = to_rings(left) * (4 * math.pi / len(values)), np.zeros((len(z), lmax + 1), complex)

        def correct(k, table, rings=rings, rows=rows):
            a[:, k] += table.T @ rings[:, k]
            rows[:, k] = table @ a[:, k]

        by_orders(correct)
        if step < iterations:
            left = values - to_map(rows)
    return a


#: Fixed value: what maps hold where nothing was observed.
UNSEEN = -1.6375e30


def clean(values: np.ndarray) -> tuple[np.ndarray, int]:
    """The map with 0 in place of pixels that aren't finite or are marked unseen, and how many those are."""
    values = np.asarray(values, float)
    bad = ~np.isfinite(values) | (np.abs(values - UNSEEN) <= 1e-5 * abs(UNSEEN))
    return np.where(bad, 0.0, values), int(bad.sum())


def ring_order(values: np.ndarray) -> np.ndarray:
    """A map in nested order as one in ring order."""
    nside = math.isqrt(len(values) // 12)
    if 12 * nside * nside != len(values) or nside & (nside - 1):
        raise ValueError("not a whole sphere of nested pixels")
    p = np.arange(len(values))
    face, inside = p // (nside * nside), p % (nside * nside)
    x, y = np.zeros_like(p), np.zeros_like(p)
    for bit in range(nside.bit_length()):
        x |= (inside >> 2 * bit & 1) << bit
        y |= (inside >> 2 * bit + 1 & 1) << bit
    row, column = face // 4, face % 4
    ring = (row + 2) * nside - x - y - 1
    north = np.minimum(ring, 4 * nside - ring)
    cap = north < nside
    length = np.where(cap, north, nside)
    shift = np.where(cap, 0, (ring - nside) & 1)
    along = 2 * column + np.where(row == 1, 0, 1)
    place = ((along * length + (x - y) + 1 + shift) // 2 - 1) % (4 * length)
    before = np.concatenate([[0], np.cumsum(ring_layout(nside)[2])])[ring - 1]
    out = np.empty_like(np.asarray(values, float))
    out[before + place] = values
    return out


def nside_for(ell: int, spare: int = 100) -> int:
    """A resolution that carries multipoles up to ``ell`` with ``spare`` more: a power of two, 128 at least."""
    return max(128, 1 << (max(ell + spare, 2).bit_length() - 1))


def power(a: np.ndarray) -> np.ndarray:
    """C_l of coefficients with m >= 0."""
    l = np.arange(len(a))  # noqa: E741
    return ((np.abs(a[:, 0]) ** 2) + 2 * (np.abs(a[:, 1:]) ** 2).sum(axis=1)) / (2 * l + 1)


def field_of(a: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The real field (mu, phi) -> values of coefficients a[l, m >= 0], for columns of mu and rows of phi."""

    def field(mu: np.ndarray, phi: np.ndarray) -> np.ndarray:
        lmax = len(a) - 1
        norm = np.sqrt((2 * np.arange(lmax + 1) + 1) / (4 * math.pi))
        out = np.zeros((mu.size, phi.size))
        for m in range(lmax + 1):
            ring = (N.wigner_d(lmax, mu.ravel(), m, 0) * norm) @ a[:, m]
            out += (1 if m == 0 else 2) * (ring[:, None] * np.exp(1j * m * phi.ravel())[None, :]).real
        return out

    return field


def mask_spectra(spark: SparkSession, values: np.ndarray, lmax: int) -> DataFrame:
    """(which, l, wl) of the mask and of its square; values that aren't finite count as 0."""
    clean = np.where(np.isfinite(values), values, 0.0)
    rows = [(w, int(l), float(v)) for w, x in (("mask", clean), ("square", clean**2)) for l, v in enumerate(power(map_alm(x, lmax)))]  # noqa: E741
    return spark.createDataFrame(rows, "which string, l int, wl double")


@dataclass(frozen=True)
class Terms:
    """Which orders of the two multipoles, which of their pairs and which distances |M - m| a kernel needs."""

    orders: np.ndarray
    orders_prime: np.ndarray
    pairs: np.ndarray
    band: int

    def union(self, other: Terms) -> Terms:
        """What either needs; ``pairs`` is over all orders of both multipoles."""
        return Terms(np.union1d(self.orders, other.orders), np.union1d(self.orders_prime, other.orders_prime), self.pairs | other.pairs, max(self.band, other.band))


def select_terms(mask: np.ndarray, grid: N.Grid, alm: np.ndarray, ell: int, prime: int, tolerance: float, spin: int = 0) -> Terms:
    """Terms that carry the kernel at (ell, prime) up to a relative ``tolerance``; sharp for masks turned to the pole.

    Orders are kept by their share of the mask's power (a tenth of the tolerance of the largest), pairs by the
    product of both shares and the autocorrelation of the mask's azimuthal spectrum (a fortieth), and M by the
    share of that spectrum within the band (all but a tenth)."""
    if tolerance <= 0:
        raise ValueError("tolerance must be positive")
    top = alm.shape[1] - 1
    half = (np.abs(alm) ** 2).sum(axis=0)
    spectrum = np.concatenate([half[:0:-1], half]) / (half[0] + 2 * half[1:].sum())
    likeness = np.zeros(4 * max(top, ell + prime) + 1)
    middle = len(likeness) // 2
    likeness[middle - 2 * top : middle + 2 * top + 1] = np.correlate(spectrum, spectrum, "full")
    power, power_prime = (N.mode_power(mask, grid, x, spin) for x in (ell, prime))
    one, two = power >= tolerance / 10 * power.max(), power_prime >= tolerance / 10 * power_prime.max()
    m, mp = np.arange(-ell, ell + 1), np.arange(-prime, prime + 1)
    weight = np.outer(power, power_prime) * likeness[middle + m[:, None] - mp[None, :]]
    pairs = (weight >= tolerance / 40 * weight.max()) & np.outer(one, two)
    within = np.cumsum(half * np.where(np.arange(top + 1) == 0, 1, 2)) / (half[0] + 2 * half[1:].sum())
    band = min(int(np.searchsorted(within, 1 - tolerance / 10)), top)
    return Terms(m[one], mp[two], pairs, band)


def coupling_block(mask: np.ndarray, grid: N.Grid, ell: int, prime: int, pairs: Sequence[tuple[str, str]], terms: Terms | None = None, most_bytes: int = 1 << 29) -> dict[tuple[str, str], np.ndarray]:
    """K^{s1 s2}[L, L'] = Re sum_{mm'} Theta^{s1} conj Theta^{s2} at (ell, prime), Theta_{mm'} = sum_M X_m conj Y_m'.

    A mode pair and its mirror contribute alike, so m < 0 is left out.  Modes of both multipoles are held in
    blocks that take about ``most_bytes`` for each; with ``terms`` modes, mode pairs and M are left out."""
    orders = np.arange(ell + 1) if terms is None else terms.orders[terms.orders >= 0]
    primes = np.arange(-prime, prime + 1) if terms is None else terms.orders_prime
    band = None if terms is None else terms.band
    channels = sorted({c for p in pairs for c in p})
    left, right = ("".join(sorted({c[k] for c in channels})) for k in (0, 1))
    out = {p: np.zeros((grid.lmax + 1, grid.lmax + 1)) for p in pairs}
    block = max(1, most_bytes // (16 * (grid.lmax + 1) * (2 * grid.lmax + 1) * max(len(left), len(right))))
    for i in range(0, len(orders), block):
        m = orders[i : i + block]
        x = {k: v.transpose(1, 0, 2) for k, v in N.leg_modes(mask, grid, ell, m, left, band).items()}
        for j in range(0, len(primes), block):
            mp = primes[j : j + block]
            weight = np.where(m == 0, 1.0, 2.0)[:, None] * np.ones(len(mp))
            if terms is not None:
                weight = weight * terms.pairs[np.ix_(m + ell, mp + prime)]
                if not weight.any():
                    continue
            y = {k: v.conj().transpose(1, 2, 0) for k, v in N.leg_modes(mask, grid, prime, mp, right, band).items()}
            theta = {c: (np.matmul(x[c[0]], y[c[1]]) * np.sqrt(weight)).reshape(grid.lmax + 1, -1) for c in channels}
            for p in pairs:
                a, b = theta[p[0]], theta[p[1]]
                out[p] += a.real @ b.real.T + a.imag @ b.imag.T
    return out


def coupling_kernels(
    spark: SparkSession, mask: Callable, lmax: int, lw: int, ell: int, dmax: int, pairs: Sequence[tuple[str, str]], *, alm: np.ndarray | None = None, tolerance: float | None = None, first: int = 0
) -> DataFrame:
    """(ch1, ch2, d, i, j, v): kernels of the channel pairs at (ell, ell + d), d from ``first`` below ``dmax``, a task for each d.

    With ``tolerance`` and the mask's coefficients ``alm`` only the terms of ``select_terms`` are computed,
    for spin 0 and 2 where both occur."""
    spins = sorted({0 if x == "T" else 2 for p in pairs for c in p for x in c})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = N.Grid(lmax, N.minimal_band(lmax, lw))
        phi = 2 * np.pi * np.arange(grid.n_phi) / grid.n_phi
        w = mask(grid.mu[:, None], phi[None, :])
        for b in batches:
            for d in b.column(0).to_pylist():
                terms = None
                if tolerance is not None:
                    for s in spins:
                        own = select_terms(w, grid, alm, ell, ell + d, tolerance, s)
                        terms = own if terms is None else terms.union(own)
                for (one, two), k in coupling_block(w, grid, ell, ell + d, pairs, terms).items():
                    i, j = (x.ravel().astype(np.int32) for x in np.indices(k.shape))
                    n = len(i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([one] * n), pa.array([two] * n), pa.array([d] * n, pa.int32()), pa.array(i), pa.array(j), pa.array(k.ravel())],
                        names=["ch1", "ch2", "d", "i", "j", "v"],
                    )

    asked = spark.range(first, dmax, 1, max(1, dmax - first)).select(F.col("id").cast("int").alias("d"))
    return asked.mapInArrow(run, "ch1 string, ch2 string, d int, i int, j int, v double")


def pole_direction(values: np.ndarray) -> tuple[float, float]:
    """(theta, phi) of the mask's centroid or, for one that hardly has any, of the axis it lies around most closely."""
    z, phi0, n = ring_layout(math.isqrt(len(values) // 12))
    ring = np.repeat(np.arange(len(z)), n)
    along = np.arange(len(values)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    phi, height = phi0[ring] + 2 * math.pi * along / n[ring], z[ring]
    flat = np.sqrt(np.clip(1 - height**2, 0, None))
    at = np.stack([flat * np.cos(phi), flat * np.sin(phi), height])
    if values.sum() <= 0:
        raise ValueError("the mask has no weight")
    centre, spread = at @ values / values.sum(), (at * values) @ at.T / values.sum()
    axis = centre if np.linalg.norm(centre) >= CENTROID else np.linalg.eigh(spread)[1][:, 0]
    axis = axis / np.linalg.norm(axis)
    return float(np.arccos(np.clip(axis[2], -1, 1))), float(np.arctan2(axis[1], axis[0]))


#: Fixed value: shorter centroids say nothing of a mask's place.
CENTROID = 0.2


def nodes(lmax: int, first: int = 32, ratio: float = 1.25, cut: float | None = None, step: float | None = None, top_cut: float | None = None) -> list[int]:
    """Geometric nodes up to lmax - 1, denser between 0.95 and 2 times a high pass' cut and around a sharp low pass' one."""
    out, x = set(), float(first)
    while x < lmax - 1:
        out.add(round(x))
        x = max(x * ratio, x + 1)
    out.add(lmax - 1)
    for at, lo, hi in ((cut, 0.95, 2.0), (top_cut, 0.5, 1.05)):
        if at:
            out |= {round(v) for v in np.arange(lo * at, hi * at, step or at / 15) if 2 <= v < lmax - 1}
    return sorted(out)


def probe_coefficients(ell: int, count: int, seed: int) -> np.ndarray:
    """Rows of coefficients (m = 0..ell) of real unit fields of degree ``ell``.

    A whole orthonormal basis where 2 ell + 1 fields are no more than ``count``, else ``count`` Gaussian draws.
    Draw order (a probe's real parts, then its imaginary ones) is fixed, so equal seeds give equal probes."""
    turn = np.array([1, 1j]) / math.sqrt(2)
    if 2 * ell + 1 <= count:
        rows = np.kron(np.eye(ell + 1), turn[:, None])
        rows[0, 0] = 1
        return np.delete(rows, 1, axis=0)
    drawn = np.random.default_rng([seed, ell]).normal(size=(count, 2, ell + 1))
    rows = np.einsum("p,npm->nm", turn, drawn)
    rows[:, 0] = drawn[:, 0, 0]
    return rows


def probes(ell: int, lmax: int, count: int, seed: int) -> Iterator[np.ndarray]:
    """The fields of ``probe_coefficients`` one after the other, as full coefficients [l, m + lmax]."""
    sign = (-1.0) ** np.arange(ell + 1)
    for row in probe_coefficients(ell, count, seed):
        a = np.zeros((lmax + 1, 2 * lmax + 1), complex)
        a[ell, lmax - ell : lmax + 1] = (sign * row.conj())[::-1]
        a[ell, lmax : lmax + ell + 1] = row
        yield a


def filtered_sums(spark: SparkSession, mask: Callable, profile: Callable, lmax: int, lw: int, at: Sequence[int], count: int = 32, seed: int = 0, channels: Sequence[str] = ("00", "20", "EE")) -> DataFrame:
    """(channel, node, ell, f, u): filtered and unfiltered response sums of the probes, a task for each node.

    ``profile(M, sin theta)`` is any self-adjoint ring filter.  Only ``channels`` of
    00, 20 and EE are worked out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = N.Grid(lmax, lmax + lw)
        phi = 2 * np.pi * np.arange(grid.n_phi) / grid.n_phi
        w = mask(grid.mu[:, None], phi[None, :])
        modes = np.abs(np.fft.fftfreq(grid.n_phi, 1 / grid.n_phi))
        h = profile(modes[None, :], np.sqrt(1 - grid.mu**2)[:, None])
        filt = lambda x: np.fft.ifft(np.fft.fft(x, axis=1) * h, axis=1)
        same = lambda x: x
        to_e = lambda p: -(grid.analysis(p, 2) + grid.analysis(p.conj(), -2)) / 2
        n = lambda a: (np.abs(a) ** 2).sum(axis=1)
        for b in batches:
            for node in b.column(0).to_pylist():
                sums = {c: np.zeros((2, lmax + 1)) for c in channels}
                for z in probes(node, lmax, count, seed):
                    for k, g in enumerate((filt, same)):
                        if "00" in sums:
                            back = grid.analysis(g(w * grid.synthesis(z)))
                            sums["00"][k] += n(grid.analysis(w * g(grid.synthesis(back))))
                        if node >= 2 and {"20", "EE"} & set(sums):
                            e = to_e(g(w * grid.synthesis(-z, 2)))
                            if "20" in sums:
                                sums["20"][k] += n(grid.analysis(w * g(grid.synthesis(e))))
                            if "EE" in sums:
                                sums["EE"][k] += n(to_e(w * g(grid.synthesis(-e, 2))))
                for c, s in sums.items():
                    m = lmax + 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c] * m), pa.array([node] * m, pa.int32()), pa.array(np.arange(m, dtype=np.int32)), pa.array(s[0]), pa.array(s[1])],
                        names=["channel", "node", "ell", "f", "u"],
                    )

    units = [(k, int(x)) for k, x in enumerate(sorted(at, reverse=True))]
    asked = spark.createDataFrame(units, "unit int, node int").repartitionByRange(len(units), "unit").select("node")
    return asked.mapInArrow(run, "channel string, node int, ell int, f double, u double")
