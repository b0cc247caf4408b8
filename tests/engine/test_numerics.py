import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from harmonia.functions import numerics as N
from harmonia.operators import dense, relational as R, sky

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_wigner_orthogonality_and_closed_forms():
    mu, w = N.gauss_legendre(40)
    for m, mp in ((0, 0), (3, 2), (-4, 2), (1, -2), (0, 2), (5, 0)):
        d = N.wigner_d(20, mu, m, mp)
        low = max(abs(m), abs(mp))
        want = np.diag(np.r_[np.zeros(low), 2 / (2 * np.arange(low, 21) + 1)])
        assert np.abs((d * w[:, None]).T @ d - want).max() < 1e-12
    assert np.abs(N.wigner_d(4, mu, 2, -2)[:, 2] - (1 - mu) ** 2 / 4).max() < 1e-14


def test_full_sky_kernels_are_the_identity():
    for name, m in N.master_kernels(np.array([4 * math.pi]), 30).items():
        want = np.eye(31)
        if name != "TT":
            want[:2, :2] = 0
        assert np.abs(m - want).max() < 1e-10
    k = N.polspice_kernels(None, 25, math.pi, 2)
    for name in ("K0", "Kp2", "Km2", "Kx", "G0", "Gdec", "Gplus"):
        assert np.abs(k[name][2:, 2:] - np.eye(24)).max() < 1e-9, name
    assert np.abs(k["Gminus"]).max() < 1e-9


def test_row_sums_are_the_correlation_at_zero():
    wl = np.exp(-0.05 * np.arange(20))
    m = N.master_kernels(wl, 60)["TT"]
    assert m[5].sum() == pytest.approx(N.mask_correlation(wl, np.array([1.0]))[0], rel=1e-10)


def test_regularised_kernels_take_the_mask_out():
    wl = np.exp(-0.1 * np.arange(11) * (np.arange(11) + 1))
    k = N.polspice_kernels(wl, 40, math.radians(40), 1)
    m = N.master_kernels(wl, 40)["TT"]
    assert np.abs((k["G0"] @ m)[:20, :20] - k["K0"][:20, :20]).max() < 1e-6


def test_pchip_is_monotone_and_exact_on_lines():
    x = np.array([0.0, 1.0, 2.5, 4.0])
    assert np.allclose(N.pchip(x, 3 * x + 1, np.linspace(0, 4, 9)), 3 * np.linspace(0, 4, 9) + 1)
    y = N.pchip(x, np.array([0.0, 0.0, 1.0, 1.0]), np.linspace(-1, 5, 200))
    assert (np.diff(y) >= -1e-12).all() and y[0] == 0 and y[-1] == 1


def patch(mu, phi):
    return np.exp(1.2 * mu) * (1 + 0.3 * np.sqrt(1 - mu**2) * np.cos(phi - 1)) / 3


def test_transforms_invert():
    g = N.Grid(8, 14)
    rng = np.random.default_rng(0)
    a = rng.normal(size=(9, 17)) + 1j * rng.normal(size=(9, 17))
    for l in range(9):  # noqa: E741
        a[l, : 8 - l] = 0
        a[l, 9 + l :] = 0
    for s in (0, 2, -2):
        b = a.copy()
        b[: abs(s)] = 0
        assert np.abs(g.analysis(g.synthesis(b, s), s) - b).max() < 1e-12


def spectra_of(f, lw):
    g = N.Grid(lw, 2 * lw)
    phi = 2 * np.pi * np.arange(g.n_phi) / g.n_phi
    return [(np.abs(g.analysis(x)) ** 2).sum(axis=1) / (2 * np.arange(lw + 1) + 1) for w in [f(g.mu[:, None], phi[None, :])] for x in (w, w**2)]


def test_kernel_sum_rules(spark):
    lmax, ell, f = 16, 4, lambda mu, phi: 0.5 + 0.3 * mu + 0.2 * np.sqrt(1 - mu**2) * np.cos(phi)
    square = spectra_of(f, 4)[1]
    pairs = [("TT", "TT"), ("TT", "DD"), ("TT", "LL"), ("DD", "DD"), ("DD", "LL"), ("LL", "LL"), ("TT", "LD"), ("TT", "DL"), ("DL", "DL"), ("DL", "LD"), ("LD", "LD")]
    rows = sky.coupling_kernels(spark, f, lmax, 4, ell, 2, pairs).groupBy("ch1", "ch2", "d").sum("v").collect()
    s = {(r.ch1, r.ch2, r.d): r["sum(v)"] for r in rows}
    xi = N.xi_kernels(square, lmax)
    for d in (0, 1):
        n = (2 * ell + 1) * (2 * (ell + d) + 1)
        plus, minus = (xi["EEpBB"][ell, ell + d] + xi["EEmBB"][ell, ell + d]) / 2, (xi["EEpBB"][ell, ell + d] - xi["EEmBB"][ell, ell + d]) / 2
        assert s["TT", "TT", d] == pytest.approx(n * xi["TT"][ell, ell + d], rel=1e-9)
        assert s["TT", "DD", d] + s["TT", "LL", d] == pytest.approx(n * xi["TE"][ell, ell + d], rel=1e-9)
        assert s["DD", "DD", d] + 2 * s["DD", "LL", d] + s["LL", "LL", d] == pytest.approx(n * plus, rel=1e-9)
        assert s["DL", "DL", d] - 2 * s["DL", "LD", d] + s["LD", "LD", d] == pytest.approx(n * minus, rel=1e-7, abs=1e-10)
        assert s["TT", "LD", d] - s["TT", "DL", d] == pytest.approx(0, abs=1e-9)


def test_exact_rows(spark):
    cl = spark.createDataFrame([(k, 1 / (1.0 + k) ** 2) for k in range(9)], "ell int, v double")
    rows = dense.exact_rows(cl, patch, 8, [2, 5, 7], lw=12).collect()
    m = {(r.l1, r.l2): r.v for r in rows}
    assert m[2, 5] == pytest.approx(m[5, 2], rel=1e-6) and m[5, 7] == pytest.approx(m[7, 5], rel=1e-6) and m[5, 5] > 0
    flat = dense.exact_rows(cl, lambda mu, phi: mu * 0 + phi * 0 + 1, 8, [5]).collect()
    assert {r.l1: r.v for r in flat}[5] == pytest.approx(2 * (1 / 36) ** 2 / 11, rel=1e-10)


def test_exact_polarised_rows(spark):
    n = 7
    cl = {"TT": 1 / (1.0 + np.arange(n)) ** 2, "EE": 0.4 / (1.0 + np.arange(n)), "BB": 0.1 / (1.0 + np.arange(n)), "TE": 0.2 / (1.0 + np.arange(n)) ** 2}
    df = spark.createDataFrame([(s, k, float(v)) for s, c in cl.items() for k, v in enumerate(c)], "stokes string, ell int, v double")
    blocks = [("TT", "EE"), ("EE", "EE"), ("TT", "TT"), ("TE", "TE"), ("EE", "TT")]
    flat = dense.exact_rows_polarised(df, lambda mu, phi: mu * 0 + phi * 0 + 1, n - 1, [4], blocks).collect()
    m = {(r.left, r.right, r.l1): r.v for r in flat}
    assert m["TT", "EE", 4] == pytest.approx(2 * cl["TE"][4] ** 2 / 9) and m["EE", "EE", 4] == pytest.approx(2 * cl["EE"][4] ** 2 / 9)
    assert m["TE", "TE", 4] == pytest.approx((cl["TE"][4] ** 2 + cl["TT"][4] * cl["EE"][4]) / 9) and abs(m["EE", "EE", 3]) < 1e-12
    cut = dense.exact_rows_polarised(df, patch, n - 1, [3, 5], blocks, lw=12).collect()
    m = {(r.left, r.right, r.l1, r.l2): r.v for r in cut}
    assert m["TT", "EE", 3, 5] == pytest.approx(m["EE", "TT", 5, 3], rel=1e-6) and m["TE", "TE", 3, 5] == pytest.approx(m["TE", "TE", 5, 3], rel=1e-6)
    one = dense.exact_rows(df.where("stokes = 'TT'").select("ell", "v"), patch, n - 1, [5], lw=12).collect()
    assert all(m["TT", "TT", r.l1, 5] == pytest.approx(r.v, rel=1e-9, abs=1e-14) for r in one)


def test_map_spectra_of_a_band_limited_map():
    nside = 8
    z, _, n = sky.ring_layout(nside)
    assert n.sum() == 12 * nside**2 and abs((z * n).sum()) < 1e-9
    a = sky.map_alm(np.repeat(1 + 0.5 * z, n), 10, 6)
    wl = sky.power(a)
    assert wl[0] == pytest.approx(4 * math.pi, rel=1e-6) and wl[1] == pytest.approx(0.25 * 4 * math.pi / 3 / 3, rel=1e-6) and wl[2:].max() < 1e-8


def test_no_filter_gives_ratio_one_and_a_high_pass_less(spark):
    one = sky.filtered_sums(spark, patch, lambda m, s: m * 0 + s * 0 + 1.0, 10, 8, [4, 6], 32)
    assert all(r.f == pytest.approx(r.u, rel=1e-9) for r in one.collect())
    cut = sky.filtered_sums(spark, patch, lambda m, s: (m > 2 * s) * 1.0, 10, 8, [6], 32)
    for c in ("00", "20", "EE"):
        g = R.ratio_by_distance(cut.where(f"channel = '{c}'").select("node", "ell", "f", "u"), 3).orderBy("d").collect()
        assert len(g) == 4 and 0 < g[0].g < 1


def test_probes():
    basis = list(sky.probes(3, 5, 8, 0))
    flat = np.array([a.ravel() for a in basis])
    assert np.allclose(flat @ flat.conj().T, np.eye(7))
    again = [list(sky.probes(6, 8, 4, 2)) for _ in range(2)]
    assert len(again[0]) == 4 and all((x == y).all() for x, y in zip(*again, strict=True))
    m = np.arange(9)
    for a in [*basis, *again[0]]:
        top = len(a) - 1
        assert np.allclose(a[:, top::-1], a[:, top:].conj() * (-1.0) ** m[: top + 1])
    rng = np.random.default_rng([2, 6])  # draws in the documented order
    re, im = rng.normal(size=7), rng.normal(size=7)
    first = (re + 1j * im) / np.sqrt(2)
    assert np.allclose(sky.probe_coefficients(6, 4, 2)[0], np.where(np.arange(7) == 0, re, first))


def test_running_integrals_are_exact_for_polynomials():
    s = N.integrals_upto(9, -0.3)
    x, _ = N.gauss_legendre(9, -0.3, 1.0)
    for k in range(9):
        assert np.allclose(s @ x**k, (x ** (k + 1) - (-0.3) ** (k + 1)) / (k + 1))


def test_eigenvalues(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(6, 6))
    m = m @ m.T
    df = spark.createDataFrame([("a", i, j, float(m[i, j])) for i in range(6) for j in range(6)], "g string, l1 int, l2 int, v double")
    got = [r.value for r in dense.eigenvalues(df).orderBy("k").collect()]
    assert np.allclose(got, np.linalg.eigvalsh(m))
    two = dense.sandwich(df, m[:3], m[:2], ["g"]).collect()
    want = m[:3] @ m @ m[:2].T
    assert len(two) == 6 and all(r.v == pytest.approx(want[r.l1, r.l2]) for r in two)
