import math
import os

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from harmonia import cli
from harmonia.config import Config, Report, bin_edges, may_rebin, observables_of
from harmonia.operators import sky
from harmonia.run import covariance, read_mask, run
from harmonia.sources import spectra as S, store

LMAX = 24


def params(tmp_path, **more):
    path = tmp_path / "cls.dat"
    if not path.exists():
        rows = "\n".join(f"{l} {1 / l:.8f} {0.3 / l:.8f} {0.01 / l:.8f} {0.1 / l:.8f}" for l in range(2, 40))  # noqa: E741
        path.write_text(f"# ell TT EE BB TE\n{rows}\n")
    base = {
        "cov_path": str(tmp_path / "out"), "cov_name": "cov.dat", "frequencies": ["090GHz", "150GHz"], "stokes": ["T", "E"], "lmax": LMAX, "lmin": 2, "bins": [[2, 10, 4], [10, 24, 7]],
        "mask_name": "mask.parquet", "mask_path": str(tmp_path), "covariance_approximation": "nka", "beams": {"090GHz": 60.0, "150GHz": 30.0}, "cmb_spectrum": str(path), "nl": {"090GHz": 20.0, "150GHz": [9.0, 12.0]},
        "thetamax": 60.0, "apodizesigma": 60.0, "Dl": True,
    }
    return base | more


FULL = np.r_[4 * math.pi, np.zeros(5)]


def test_full_sky_covariance_is_cosmic_variance(spark, tmp_path):
    p = params(tmp_path, stokes=["T"], frequencies=["090GHz"], beams=None, nl=None, polspice_postprocess=False, Dl=False)
    got = covariance(spark, p, FULL, FULL)
    m, w = got.dense(), got.weights.collect()
    bins = sorted({r.bin for r in w})
    assert m.shape == (len(bins), len(bins)) and np.abs(m - np.diag(np.diag(m))).max() < 1e-12
    for k, b in enumerate(bins):
        want = sum(r.w**2 * 2 * (1 / r.ell) ** 2 / (2 * r.ell + 1) for r in w if r.bin == b)
        assert m[k, k] == pytest.approx(want, rel=1e-7)


def test_methods_agree_on_the_full_sky_and_matrix_is_sound(spark, tmp_path):
    one = covariance(spark, params(tmp_path), FULL, FULL).dense()
    two = covariance(spark, params(tmp_path, covariance_approximation="inka"), FULL, FULL).dense()
    assert np.allclose(one, two, rtol=1e-6)
    assert np.abs(one - one.T).max() < 1e-9 * np.abs(one).max() and (np.diag(one) > 0).all()
    c = one / np.sqrt(np.outer(np.diag(one), np.diag(one)))
    assert np.abs(c).max() < 1 + 1e-6
    folded = covariance(spark, params(tmp_path, sum_assymetric_stokes=True), FULL, FULL).dense()
    assert folded.shape[0] < one.shape[0] and (np.diag(folded) > 0).all()


def test_precomputed_kernels_on_the_full_sky_give_the_narrow_kernel(spark, tmp_path):
    pairs = [(a, b) for a in ("TT", "DD", "TD", "DT") for b in ("TT", "DD", "TD", "DT")]
    made = sky.coupling_kernels(spark, lambda mu, phi: mu * 0 + phi * 0 + 1.0, 6, 2, 4, 2, pairs)
    made = made.withColumn("v", F.when(F.abs("v") < 1e-9, 0.0).otherwise(F.col("v"))).cache()
    more = {"covariance_approximation": "acc", "dmax": 2, "centralell": 4, "bins": [[4, 10, 3], [10, 24, 7]]}
    acc = covariance(spark, params(tmp_path, **more), FULL, FULL, made).dense()
    nka = covariance(spark, params(tmp_path, bins=more["bins"]), FULL, FULL).dense()
    assert np.allclose(acc, nka, rtol=1e-6, atol=1e-9 * np.abs(nka).max())
    with pytest.raises(ValueError, match="missing"):
        covariance(spark, params(tmp_path, **more), FULL, FULL, made.where("ch1 = 'TT'"))


def test_map_filter_lowers_the_covariance(spark, tmp_path):
    z, _, n = sky.ring_layout(8)
    alm = sky.map_alm(np.repeat(np.exp(z) / 3, n), 8)
    wl, square = sky.power(alm), sky.power(sky.map_alm(np.repeat(np.exp(2 * z) / 9, n), 8))
    field = sky.field_of(alm)(np.array([[0.3]]), np.array([[0.1, 2.0]]))
    assert np.allclose(field, math.exp(0.3) / 3, rtol=1e-3)
    p = params(tmp_path, stokes=["T"], frequencies=["090GHz"], nl={"090GHz": 20.0}, beams={"090GHz": 60.0}, lmax=12, bins=[[4, 12, 4]], polspice_postprocess=False)
    plain = covariance(spark, p, wl, square).dense()
    f = {"type": "fourier_highpass", "lx": 1.5, "nprobe": 8, "node_min": 4, "node_ratio": 1.6}
    cut = covariance(spark, p | {"map_filter": f}, wl, square, mask_alm=alm).dense()
    assert (np.diag(cut) > 0).all() and (np.diag(cut) < np.diag(plain)).all()
    with pytest.raises(ValueError, match="coefficients"):
        covariance(spark, p | {"map_filter": f}, wl, square)


def test_sum_rule_report(spark):
    from harmonia.operators import relational as R

    xi = spark.createDataFrame([(4, 4 + d, 0.1 / (d + 1), 0.05) for d in range(3)], "l1 int, l2 int, x00 double, x20 double")
    n = [9 * (2 * (4 + d) + 1) for d in range(3)]
    rows = [("TT", "TT", d, n[d] * 0.1 / (d + 1) * (1.02 if d == 1 else 1)) for d in range(3)] + [("TT", "DD", d, n[d] * 0.04) for d in range(3)] + [("TT", "LL", d, n[d] * 0.01) for d in range(3)]
    got = {r.rule: r.worst for r in R.normalisation_consistency(spark.createDataFrame(rows, "ch1 string, ch2 string, d int, s double"), xi, 4).collect()}
    assert got["00"] == pytest.approx(0.02) and got["20"] == pytest.approx(0, abs=1e-12)


def test_leakage_runs(spark, tmp_path):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    channels = [a + b for a in "TDL" for b in "TDL"]
    f = lambda mu, phi: 0.5 + 0.3 * mu + 0.2 * np.sqrt(1 - mu**2) * np.cos(phi)
    made = sky.coupling_kernels(spark, f, 8, 4, 4, 2, [(a, b) for k, a in enumerate(channels) for b in channels[k:]]).cache()
    wl = np.array([4 * math.pi * 0.25, 0.15, 0.0]), np.array([4 * math.pi * 0.3, 0.4, 0.05, 0.0, 0.0])
    p = params(tmp_path, stokes=None, observables=["TT", "EE", "TE", "BB"], frequencies=["090GHz"], covariance_approximation="acc", dmax=2, centralell=4, bins=[[4, 8, 2]], lmax=8, polspice_postprocess=False, nl={"090GHz": 20.0}, beams={"090GHz": 60.0})
    p.pop("stokes")
    m = covariance(spark, p, *wl, made).dense()
    assert np.allclose(m, m.T, rtol=1e-8) and (np.diag(m) > 0).all()
    c = m / np.sqrt(np.outer(np.diag(m), np.diag(m)))
    assert np.abs(c).max() < 1 + 1e-6


def test_term_scale_is_exact_at_the_central_multipole(spark):
    from harmonia.functions import numerics as N
    from harmonia.operators import relational as R

    x = N.xi_kernels(np.array([3.0, 0.8, 0.1, 0.02]), 12)
    rows = [(i, j, *[float(v) for v in (x["TT"][i, j], x["TE"][i, j], (x["EEpBB"] + x["EEmBB"])[i, j] / 2, (x["EEpBB"] - x["EEmBB"])[i, j] / 2)]) for i in range(13) for j in range(13)]
    xi = spark.createDataFrame(rows, "l1 int, l2 int, x00 double, x20 double, xee double, xeb double")
    sums = spark.createDataFrame([("TT", "DD", 1, 2.0), ("DL", "LD", 1, 0.05), ("DD", "DD", 1, 1.5)], "ch1 string, ch2 string, d int, s double")
    got = {(r.ch1, r.ch2, r.m): r.x for r in R.term_scale(xi, sums, 5).collect()}
    for a, b in (("TT", "DD"), ("DD", "DD")):
        assert got[a, b, 5] == pytest.approx(1 / (11 * 13), rel=1e-9)
    ratio = R.leakage_ratio(sums.unionByName(spark.createDataFrame([("TT", "LL", 1, 0.5)], sums.schema))).first()
    assert ratio.ratio == pytest.approx(0.25)


def test_orientation_and_mixing(spark):
    from harmonia.operators import relational as R

    rng = np.random.default_rng(0)
    sym = rng.normal(size=(4, 4))
    sym = sym + sym.T
    k = sym * (2 * np.arange(4) + 1)[None, :]
    frame = lambda a: spark.createDataFrame([(i, j, float(a[i, j])) for i in range(len(a)) for j in range(len(a))], "l1 int, l2 int, v double")
    for given in (k, k.T):
        assert {(r.l1, r.l2): r.v for r in R.orient(frame(given)).collect()} == {(i, j): k[i, j] for i in range(4) for j in range(4)}
    plus, minus, s = (rng.normal(size=(4, 4)) for _ in range(3))
    blocks = [(a, b, i, j, float(s[i, j] + a + 2 * b)) for a in (0, 1) for b in (0, 1) for i in range(4) for j in range(4)]
    legs = frame(plus).withColumn("kernel", F.lit("p")).unionByName(frame(minus).withColumn("kernel", F.lit("m")))
    bridge = spark.createDataFrame([(0, 0, "p"), (0, 1, "m"), (1, 1, "p"), (1, 0, "m")], "out int, src int, kernel string")
    got = {(r.idx1, r.idx2, r.l1, r.l2): r.v for r in R.mix_sources(spark.createDataFrame(blocks, "idx1 int, idx2 int, l1 int, l2 int, v double"), bridge, legs).collect()}
    want = sum(g @ (s + a + 2 * b) @ h.T for a, g in ((0, plus), (1, minus)) for b, h in ((0, minus), (1, plus)))
    assert all(got[0, 1, i, j] == pytest.approx(want[i, j]) for i in range(4) for j in range(4))


def test_whole_run(spark, tmp_path):
    z, _, n = sky.ring_layout(8)
    mask = np.repeat(np.clip(0.5 * (1 + np.cos(np.pi * np.arccos(z) / 2.2)), 0, 1) * (np.arccos(z) < 2.2), n)
    spark.createDataFrame([(k, float(v)) for k, v in enumerate(mask)], "pix long, w double").write.parquet(str(tmp_path / "mask.parquet"))
    p = params(tmp_path)
    folder = run(spark, p)
    m = np.loadtxt(f"{folder}/cov.dat")
    bins = np.loadtxt(f"{folder}/lbins.dat")
    assert m.shape[0] % len(bins) == 0 and np.allclose(m, m.T, rtol=1e-6, atol=1e-12 * np.abs(m).max())
    record = yaml.safe_load(open(f"{folder}/params_resolved.yml"))
    assert record["provenance"]["status"] == "done" and record["derived"]["nside"] == 8
    assert "condition number" in open(f"{folder}/conditioning.txt").read()
    with pytest.raises(ValueError):
        run(spark, p | {"beams": {"090GHz": 1.0}})
    failed = yaml.safe_load(open(f"{os.path.dirname(folder)}/v1/params_resolved.yml"))
    assert failed["provenance"]["status"].startswith("failed")
    path = tmp_path / "p.yml"
    path.write_text(yaml.safe_dump(p))
    assert cli.validate([str(path)]) == 0


def test_validation(tmp_path):
    ok = params(tmp_path)
    assert Report(ok).ok and Config.of(ok).observables == ("TT", "EE", "TE")
    bad = {
        "lmax": -1, "lmin": 99, "bins": [[0, 99, 5]], "covariance_approximation": "x", "observables": ["TT"], "nl_is_biased": True, "map_filter": {"type": "x"}, "Dl": "yes", "noise": {"090GHz": 1.0},
        "spectrum_units": "q", "compute_noise_only": True, "frequencies": ["1", "22"],
    }
    for k, v in bad.items():
        assert not Report(ok | {k: v}).ok, k
    assert not Report({k: v for k, v in ok.items() if k != "lmax"}).ok
    acc = ok | {"covariance_approximation": "acc", "dmax": 5, "centralell": 20}
    assert Report(acc).ok and any("dmax" in w for w in Report(acc).warnings)
    assert not Report(ok | {"map_filter": {"type": "fourier_highpass", "lx": 30, "lowpass": {"lx": 10}}}).ok
    with pytest.raises(ValueError):
        observables_of({"stokes": ["B"]})
    assert observables_of({"observables": ["ET", "TE", "BB"]}) == ["TE", "BB"]
    assert bin_edges([[2, 10, 4], [10, 24, 7]]) == [2, 6, 10, 17, 24]
    assert may_rebin(ok, ok | {"lmin": 5}) == [] and may_rebin(ok, ok | {"Dl": False}) == ["Dl"]


def test_spectrum_files(spark, tmp_path):
    nine = tmp_path / "nine.txt"
    nine.write_text("\n".join(f"{k} " + " ".join(str(c * 10 + k) for c in range(9)) for k in range(5)))
    t = S.by_stokes(S.checked(S.read_spectrum(spark, str(nine)), 5, "x"), ["TT", "ET", "BE"], "x")
    got = {(r.stokes, r.ell): r.v for r in t.collect()}
    assert got["ET", 3] == 63 and got["BE", 0] == 80 and S.has_parity_odd(spark, str(nine))
    gap = tmp_path / "gap.dat"
    gap.write_text("2 1\n4 1\n")
    with pytest.raises(ValueError, match="consecutive"):
        S.checked(S.read_spectrum(spark, str(gap)), 3, "gap")
    short = tmp_path / "short.dat"
    short.write_text("2 1\n3 1\n")
    with pytest.raises(ValueError, match="ends at"):
        S.checked(S.read_spectrum(spark, str(short)), 9, "short")
    assert [r.v for r in S.checked(S.read_spectrum(spark, str(short)), 4, "s").orderBy("ell").collect()] == [0, 0, 1, 1]
    with pytest.raises(NotImplementedError):
        S.read_spectrum(spark, "x.npy")
    with pytest.raises(ValueError):
        S.by_stokes(S.checked(S.read_spectrum(spark, str(short)), 4, "s"), ["EE"], "s")
    with pytest.raises(ValueError, match=r"\[0, 1\]"):
        S.transfer(spark, str(tmp_path / "nine.txt"), ["aa"], ["TT"], 5)
    with pytest.raises(ValueError, match="unknown"):
        S.noise(spark, {"090150": 1.0}, ["090", "150"], 5)
    n = {(r.f, r.stokes): r.v for r in S.noise(spark, {"090": 3.0, "150": [2.0, 5.0]}, ["090", "150"], 1).collect()}
    assert n["090", "EE"] == pytest.approx(2 * n["090", "TT"]) and n["150", "EE"] == pytest.approx(n["150", "TT"] * 6.25)


def fits_table(columns, *more):
    def block(cards):
        text = "".join(f"{c:<80}" for c in cards)
        return text.ljust(-(-len(text) // 2880) * 2880).encode()

    n = len(next(iter(columns.values())))
    body = np.stack(list(columns.values()), axis=1).astype(">f8").tobytes()
    cards = ["XTENSION= 'BINTABLE'", "BITPIX  = 8", "NAXIS   = 2", f"NAXIS1  = {8 * len(columns)}", f"NAXIS2  = {n}", f"TFIELDS = {len(columns)}"]
    cards += [c for i, k in enumerate(columns) for c in (f"TTYPE{i + 1}  = '{k}'", f"TFORM{i + 1}  = '1D'")] + [*more, "END"]
    return block(["SIMPLE  = T", "BITPIX  = 8", "NAXIS   = 0", "END"]) + block(cards) + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def test_fits_and_cache(spark, tmp_path):
    path = tmp_path / "cl.fits"
    path.write_bytes(fits_table({"TT": np.arange(6.0), "EE": np.ones(6), "BB": np.zeros(6), "TE": np.arange(6.0) * 2}))
    got = {(r.stokes, r.ell): r.v for r in S.by_stokes(S.checked(S.read_spectrum(spark, str(path)), 6, "f"), ["TT", "ET", "TB"], "f").collect()}
    assert got["TT", 4] == 4 and got["ET", 5] == 10 and got["TB", 5] == 0
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for of in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert store.cached(spark, str(tmp_path / "cache"), "k", of, make).count() == 3
    assert len(calls) == 2
    assert store.versioned(spark, str(tmp_path / "v"), "x").endswith("v0")
    for k in (0, 2):
        (tmp_path / "v" / f"v{k}").mkdir(exist_ok=True)
    assert store.versioned(spark, str(tmp_path / "v"), "x").endswith("v2")
    (tmp_path / "v" / "v2" / "x").touch()
    assert store.versioned(spark, str(tmp_path / "v"), "x").endswith("v3") and store.versioned(spark, str(tmp_path / "v"), "x", 1).endswith("v1")


def write_mask(spark, path, nside=8, bad=0):
    z, _, n = sky.ring_layout(nside)
    mask = np.repeat(np.clip(0.5 * (1 + np.cos(np.pi * np.arccos(z) / 2.2)), 0, 1) * (np.arccos(z) < 2.2), n)
    mask[-bad:] = [math.nan, sky.UNSEEN][:bad] if bad else mask[-bad:]
    spark.createDataFrame([(k, float(v)) for k, v in enumerate(mask)], "pix long, w double").write.mode("overwrite").parquet(path)
    return mask


def test_precomputed_run_from_a_parameter_file(spark, tmp_path):
    from harmonia.sources import kernels

    write_mask(spark, str(tmp_path / "mask.parquet"), 4, 2)
    p = params(tmp_path, covariance_approximation="acc", dmax=2, centralell=6, frequencies=["090GHz"], bins=[[4, 8, 2]], lmax=8, nl={"090GHz": 20.0}, beams={"090GHz": 60.0})
    p |= {"acc_precompute": {"lmax": 10}, "save_raw_blocks": True, "save_windows": True}
    path = tmp_path / "p.yml"
    path.write_text(yaml.safe_dump(p))
    with pytest.warns(UserWarning, match="2 bad pixels"):
        assert cli.precompute([str(path)]) == 0
    held = kernels.manifest(spark, f"{p['cov_path']}/kernels")
    with pytest.warns(UserWarning):
        folder = run(spark, p)
        again = run(spark, p)
    assert held == kernels.manifest(spark, f"{p['cov_path']}/kernels") and folder != again
    assert (np.loadtxt(f"{folder}/cov.dat") == np.loadtxt(f"{again}/cov.dat")).all()
    budget = open(f"{folder}/error_budget.txt").read()
    assert "relative bias" in budget and "sum rule 00" in budget
    assert any(x.startswith("blocks.k") for x in os.listdir(f"{p['cov_path']}/cache"))
    assert len([x for x in os.listdir(f"{folder}/window_functions") if x.startswith("spectrum=")]) == 3
    with pytest.raises(kernels.IdentityError, match="centralell"):
        kernels.read_kernels(spark, f"{p['cov_path']}/kernels", held["identity"] | {"centralell": 7})
    with pytest.raises(ValueError, match="missing"):
        kernels.read_kernels(spark, f"{p['cov_path']}/kernels", held["identity"], [("LL", "LD")], 1)
    with pytest.warns(UserWarning, match="trust"):
        kernels.read_kernels(spark, f"{p['cov_path']}/kernels", held["identity"] | {"more": 1})
    with pytest.raises(kernels.IdentityError), pytest.warns(UserWarning):
        run(spark, p | {"centralell": 7})


def test_older_kernel_files(spark, tmp_path):
    from harmonia.sources import kernels

    rng = np.random.default_rng(3)
    old = tmp_path / "covariance_coupling"
    old.mkdir()
    a, b = rng.normal(size=(3, 3)), rng.normal(size=(3, 3))
    np.savetxt(old / "TTxTT_5x6.txt", a)
    np.save(old / "TTxTT_5x6.npy", a)
    np.save(old / "TTxEE_5x5.npy", b)
    folder = str(tmp_path / "kernels")
    assert cli.convert([str(old), folder, "--identity", '{"centralell": 5}']) == 0
    got = kernels.read_kernels(spark, folder, {"centralell": 5}, [("DD", "TT")], 1).collect()
    assert {(r.ch1, r.ch2, r.d, r.i, r.j): r.v for r in got} == {("TT", "DD", 0, i, j): b[i, j] for i in range(3) for j in range(3)}
    np.savetxt(old / "TTxEE_5x5.txt", b + 1)
    with pytest.raises(ValueError, match="differ"):
        kernels.convert(spark, str(old), str(tmp_path / "more"), {})


def test_masks_are_cleaned_and_brought_to_ring_order(spark, tmp_path):
    values = np.arange(48.0)
    assert sky.ring_order((np.arange(48) == 0) * 1.0).argmax() == 13 and sorted(sky.ring_order(values)) == sorted(values)
    path = tmp_path / "m.fits"
    for order, want in (("NESTED", sky.ring_order(values)), ("RING", values)):
        path.write_bytes(fits_table({"W": values}, f"ORDERING= '{order}'"))
        assert (read_mask(spark, {"mask_name": str(path), "mask_path": ""}) == want).all()
    path.write_bytes(fits_table({"W": values}, "ORDERING= 'SPIRAL'"))
    with pytest.raises(ValueError, match="SPIRAL"):
        read_mask(spark, {"mask_name": str(path), "mask_path": ""})
    clean, bad = sky.clean(np.array([1.0, math.nan, sky.UNSEEN, -1e30]))
    assert bad == 2 and (clean == [1, 0, 0, -1e30]).all()
    assert sky.nside_for(10) == 128 and sky.nside_for(500) == 512


def test_selected_terms_carry_the_kernel(spark):
    from harmonia.functions import numerics as N

    z, _, n = sky.ring_layout(16)
    values = np.repeat(np.exp(-((np.arccos(z) / 0.35) ** 2)), n)
    alm = sky.map_alm(values, 24)
    away = N.to_pole(alm, 1.0, 0.4)
    back = N.to_pole(alm, *sky.pole_direction(values))
    grid = N.Grid(26, N.minimal_band(26, 48))
    phi = 2 * np.pi * np.arange(grid.n_phi) / grid.n_phi
    w = sky.field_of(alm)(grid.mu[:, None], phi[None, :])
    assert np.allclose(sky.power(away), sky.power(alm)) and np.allclose(back, alm, atol=1e-6)
    full = sky.coupling_block(w, grid, 20, 21, [("TT", "TT"), ("DD", "DD")])
    terms = sky.select_terms(w, grid, alm, 20, 21, 1e-3)
    assert len(terms.orders) < 41 and terms.pairs.mean() < 0.9 and len(terms.union(terms).orders) == len(terms.orders)
    some = sky.coupling_block(w, grid, 20, 21, [("TT", "TT")], terms)["TT", "TT"]
    assert np.linalg.norm(some - full["TT", "TT"]) < 5e-3 * np.linalg.norm(full["TT", "TT"])
    turned = sky.field_of(N.to_pole(alm, 0.9, 0.2))(grid.mu[:, None], phi[None, :])
    there = sky.coupling_block(turned, grid, 20, 21, [("DD", "DD")])["DD", "DD"]
    assert np.allclose(there, full["DD", "DD"], atol=1e-6 * np.abs(there).max())
