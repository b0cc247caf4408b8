"""A whole run: inputs, data model, kernels, blocks, post-processing, matrix and reports."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import Config
from .functions import columns as C, numerics as N
from .operators import dense, relational as R, sky
from .plans import keys as K
from .sources import kernels as store, spectra as S
from .sources.store import RunRecord, cached, digest, put_text, table_text, versioned


@dataclass
class Result:
    """Keys, bins and the binned matrix (spec1, bin1, spec2, bin2, v)."""

    config: Config
    keys: DataFrame
    weights: DataFrame
    matrix: DataFrame
    legs: dict[int, np.ndarray]
    smooth: DataFrame
    model: DataFrame
    spectra: DataFrame

    def centres(self) -> np.ndarray:
        rows = self.weights.groupBy("bin").agg(F.sum(F.col("w") * F.col("ell")).alias("c")).orderBy("bin").collect()
        return np.array([r.c for r in rows])

    def dense(self) -> np.ndarray:
        """The matrix as an array: (spectra x bins) squared, which a run keeps small."""
        bins = {r.bin: k for k, r in enumerate(self.weights.select("bin").distinct().orderBy("bin").collect())}
        specs = {r.spec1: k for k, r in enumerate(self.matrix.select("spec1").distinct().orderBy("spec1").collect())}
        out = np.zeros((len(specs) * len(bins),) * 2)
        t = self.matrix.toArrow()
        one, two = ([specs[s] * len(bins) + bins[b] for s, b in zip(t.column(x).to_pylist(), t.column(y).to_pylist(), strict=True)] for x, y in (("spec1", "bin1"), ("spec2", "bin2")))
        out[one, two] = t.column("v").to_numpy()
        return out


def model(spark: SparkSession, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys, spectra(canon, stokes, ell, v), debias(canon, ell, v)).

    Every spectrum is signal times beams, pixel window and transfer function, plus its noise."""
    p, lmax = cfg.raw, cfg.lmax
    pairs = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(cfg.stokes_pairs)], "p_idx int, s1 string, s2 string")
    letters = sorted({s for pair in cfg.stokes_pairs for s in pair}, reverse=True)
    keys = K.spectrum_keys(*K.field_dims(spark, letters, cfg.frequencies), pairs=pairs)
    fields = [(a, b) for a in letters for b in letters]
    every = K.spectrum_keys(*K.field_dims(spark, letters, cfg.frequencies), pairs=spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(fields)], "p_idx int, s1 string, s2 string"))
    stokes = [a + b for a, b in fields]
    freq_pairs = [a + b for a in cfg.frequencies for b in cfg.frequencies]
    cmb = S.signal(spark, p.get("cmb_spectrum"), stokes, lmax, cfg.units("cmb_spectrum") if isinstance(p.get("cmb_spectrum"), str) else "Cl")
    rows = every.select("canon", "s1", "s2", "f1", "f2", F.concat("s1", "s2").alias("stokes"), F.concat("f1", "f2").alias("pair"))
    out = rows.join(cmb, "stokes")
    if p.get("foregrounds"):
        fg = S.per_pair(spark, p["foregrounds"], freq_pairs, stokes, lmax, cfg.units("foregrounds")).withColumnRenamed("v", "g")
        out = out.join(fg, ["pair", "stokes", "ell"], "left").withColumn("v", C.finite_or(F.col("v") + F.coalesce("g", F.lit(0.0)), 0.0)).drop("g")
    b = S.beams(spark, p.get("beams"), cfg.frequencies, lmax)
    out = out.join(b.toDF("f1", "ell", "b1"), ["f1", "ell"]).join(b.toDF("f2", "ell", "b2"), ["f2", "ell"])
    out = out.join(S.pixel_window(spark, p.get("pixwin"), lmax), "ell")
    leg = lambda s: F.when(F.col(s) == "T", F.col("pt")).otherwise(F.col("pp"))
    if p.get("fl"):
        out = out.join(S.transfer(spark, p["fl"], freq_pairs, stokes, lmax).withColumnRenamed("v", "fl"), ["pair", "stokes", "ell"])
    else:
        out = out.withColumn("fl", F.lit(1.0))
    out = out.withColumn("d", F.col("b1") * F.col("b2") * leg("s1") * leg("s2") * F.col("fl"))
    n = S.noise(spark, p.get("nl"), cfg.frequencies, lmax, cfg.units("nl")).select(F.col("f").alias("f1"), "stokes", "ell", F.col("v").alias("n"))
    out = out.join(n, ["f1", "stokes", "ell"], "left").withColumn("n", F.when(F.col("f1") == F.col("f2"), F.coalesce("n", F.lit(0.0))).otherwise(0.0))
    fix = S.corrections(spark, p.get("post_process_correction"), stokes, lmax).withColumnRenamed("v", "ppc")
    out = out.join(fix, ["stokes", "ell"])
    inflate = C.transfer_inflation("fl") if cfg.tf_uncertainty else F.lit(1.0)
    debias = C.finite_or(C.safe_divide(F.lit(1.0), "d", 1.0) * inflate * F.col("ppc"), 1.0)
    full = out.select("canon", "stokes", "ell", (F.col("v") * F.col("d") + F.col("n")).alias("v"), debias.alias("debias"), "d", "fl")
    return keys, full.select("canon", "stokes", "ell", "v"), full.select("canon", "stokes", "ell", F.col("debias").alias("v"), "d", "fl")


def kernels(spark: SparkSession, cfg: Config, mask_wl: np.ndarray, square_wl: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(Xi by norm from the squared mask, smoothing kernels by Stokes pair from the mask)."""
    top = cfg.lmax - 1
    wl = lambda w: spark.createDataFrame([(k, float(v)) for k, v in enumerate(w)], "l int, wl double")
    x = dense.coupling_kernels(wl(square_wl), top, symmetric=True)
    ee = x.where("channel in ('EEpBB', 'EEmBB')").groupBy("l1", "l2").agg((F.sum("v") / 2).alias("v"))
    named = x.where("channel in ('TT', 'TE')").select(F.when(F.col("channel") == "TT", "00").otherwise("20").alias("norm"), "l1", "l2", "v")
    xi = named.unionByName(ee.select(F.lit("EE").alias("norm"), "l1", "l2", "v"))
    m = dense.coupling_kernels(wl(mask_wl), top)
    half = m.where("channel in ('EEpBB', 'EEmBB')").groupBy("l1", "l2").agg((F.sum("v") / 2).alias("v"))
    parts = [m.where("channel = 'TT'").select(F.lit("TT").alias("stokes"), "l1", "l2", "v")]
    parts += [m.where("channel = 'TE'").select(F.lit(s).alias("stokes"), "l1", "l2", "v") for s in ("TE", "ET")]
    parts += [half.select(F.lit(s).alias("stokes"), "l1", "l2", "v") for s in ("EE", "BB")]
    smooth = parts[0]
    for x2 in parts[1:]:
        smooth = smooth.unionByName(x2)
    return xi, smooth


def leg_matrices(cfg: Config, keys: list, debias: dict[str, np.ndarray], weights: np.ndarray, wl: np.ndarray | None) -> dict[int, np.ndarray]:
    """P = B diag(D d) G for each spectrum: what turns a pseudo-spectrum leg into bandpowers."""
    top = cfg.lmax - 1
    ell = np.arange(cfg.lmax)
    scale = ell * (ell + 1) / (2 * math.pi) if cfg.use_dl else np.ones(cfg.lmax)
    if cfg.polspice and wl is not None:
        g = N.polspice_kernels(wl, top, math.radians(cfg.theta_max), cfg.apodize_type, math.radians(cfg.apodize_sigma))
        of = {"TT": g["G0"], "EE": g["Gplus"], "BB": g["Gplus"], "EB": g["Gplus"] - g["Gminus"], "BE": g["Gplus"] - g["Gminus"]}
    else:
        of, g = {}, None
    out = {}
    for k in keys:
        mixed = of.get(k.s1 + k.s2, g["Gx"] if g else None)
        p = weights * (scale * debias[k.canon])[None, :]
        out[k.idx] = p if mixed is None else p @ mixed
    return out


def fold_legs(blocks: DataFrame, legs: dict[int, np.ndarray]) -> DataFrame:
    """P_i S P_j^T of each raw block: the legs (bins x multipoles) go to every task, a block per task."""
    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("idx1")[0].as_py(), table.column("idx2")[0].as_py()
        m = np.zeros((legs[i].shape[1], legs[j].shape[1]))
        m[table.column("l1").to_numpy(), table.column("l2").to_numpy()] = table.column("v").to_numpy()
        out = legs[i] @ m @ legs[j].T
        b1, b2 = (x.ravel().astype(np.int32) for x in np.indices(out.shape))
        return pa.table({"idx1": np.full(out.size, i, np.int32), "idx2": np.full(out.size, j, np.int32), "bin1": b1, "bin2": b2, "v": out.ravel()})

    return blocks.groupBy("idx1", "idx2").applyInArrow(run, "idx1 int, idx2 int, bin1 int, bin2 int, v double")


def filter_profile(f: dict[str, Any]):
    """The ring filter of a map_filter block as a function of M and sin(theta)."""
    low = f.get("lowpass")

    def profile(m: np.ndarray, s: np.ndarray) -> np.ndarray:
        cut = f["lx"] * s
        with np.errstate(divide="ignore"):
            on = (m > cut) * 1.0 if f.get("shape", "sharp") == "sharp" else np.exp(-((cut / m) ** f.get("power", 6)))
        on = np.where(m == 0, 0.0, on)
        if low:
            top = low["lx"] * s
            on = on * ((m <= top) if low.get("shape", "exp") == "sharp" else np.exp(-((m / np.maximum(top, 1e-300)) ** low.get("power", 6))))
        return on

    return profile


def channels_of(spark: SparkSession, cfg: Config) -> list[str]:
    """Norm channels that the run's T and E blocks need; blocks with a B leg need none of their own."""
    letters = {a + b for a, b in cfg.stokes_pairs if "B" not in a + b}
    found = {r.norm for r in K.norm_table(spark).collect() if r.left_stokes in letters and r.right_stokes in letters}
    return [c for c in ("00", "20", "EE") if c in found]


def filter_ratio(spark: SparkSession, cfg: Config, mask_alm: np.ndarray) -> DataFrame:
    """(norm, node, d, g): filtered over unfiltered response by channel, node and distance, from probes at a list
    of nodes, a task for each node."""
    f, top, lw = cfg.raw["map_filter"], cfg.lmax - 1, len(mask_alm) - 1
    dmax = min(f.get("dmax") or top, top)
    low = f.get("lowpass") or {}
    at = sky.nodes(
        cfg.lmax, min(f.get("node_min", 32), max(2, top // 2)), f.get("node_ratio", 1.25), f["lx"], f.get("near_cut_step"),
        low.get("lx") if low.get("shape", "exp") == "sharp" else None,
    )
    sums = sky.filtered_sums(spark, sky.field_of(mask_alm), filter_profile(f), min(top + dmax, 2 * top), lw, at, f.get("nprobe", 32), f.get("seed", 0), channels_of(spark, cfg))
    return R.ratio_by_distance(sums.select(F.struct("channel", "node").alias("node"), "ell", "f", "u"), dmax, degree="node.node").select(F.col("node.channel").alias("norm"), "node.node", "d", "g")


def filtered_blocks(spark: SparkSession, cfg: Config, keys: DataFrame, blocks: DataFrame, model_of: DataFrame, ratio: DataFrame) -> DataFrame:
    """Blocks of filtered maps: times rho of the block's norm channel over the transfer functions of both legs;
    rho is ``ratio`` interpolated between nodes."""
    top = cfg.lmax - 1
    dmax = min(cfg.raw["map_filter"].get("dmax") or top, top)
    rho = None
    for ch in channels_of(spark, cfg):
        one = dense.interpolate_nodes(ratio.where(F.col("norm") == ch).drop("norm"), top, dmax).withColumn("norm", F.lit(ch))
        rho = one if rho is None else rho.unionByName(one)
    if rho is None:
        return blocks
    side = lambda i: keys.select(F.col("idx").alias(f"idx{i}"), F.concat("s1", "s2").alias(("left_stokes", "right_stokes")[i - 1]), F.col("canon").alias(f"c{i}"))
    norms = K.norm_table(spark)
    named = blocks.join(F.broadcast(side(1)), "idx1").join(F.broadcast(side(2)), "idx2").join(F.broadcast(norms), ["left_stokes", "right_stokes"], "left")
    named = named.withColumn("norm", F.coalesce("norm", F.lit("EE")))
    fl = lambda i: model_of.select(F.col("canon").alias(f"c{i}"), F.col("ell").alias(f"l{i}"), F.col("fl").alias(f"f{i}"))
    out = named.join(rho.withColumnRenamed("v", "rho"), ["norm", "l1", "l2"], "left").join(fl(1), ["c1", "l1"]).join(fl(2), ["c2", "l2"])
    factor = F.when(F.col("rho").isNull(), 1.0).otherwise(C.transfer_correction("rho", "f1", "f2"))
    return out.select("idx1", "idx2", "l1", "l2", (F.col("v") * factor).alias("v"))


#: Strategies: (products, spectra, smoothing kernels) -> spectra that enter the blocks.
STRATEGIES = {
    "nka": lambda spectra, smooth: spectra,
    "inka": lambda spectra, smooth: R.inka_spectra(spectra, smooth),
}


def acc_products(keys: DataFrame, norms: DataFrame, swapped: bool) -> DataFrame:
    """Wick products of every block with kernel channels in the letters' own order."""
    b = K.block_positions(keys)
    if swapped:
        turn = {x: x.replace("a_", "_").replace("b_", "a_").replace("_", "b_", 1) if x.startswith("a_") else x.replace("b_", "a_") for x in b.columns if x[:2] in ("a_", "b_")}
        b = b.select("idx1", "idx2", *[F.col(x).alias(y) for x, y in turn.items()])
    p = K.contractions(b).join(F.broadcast(norms), ["left_stokes", "right_stokes"])
    channel = lambda x: F.translate(x, "TEB", "TDL")
    return p.select(F.struct("idx1", "idx2").alias("id"), F.lit(1).alias("coef"), "left", channel("left_stokes").alias("ch1"), "right", channel("right_stokes").alias("ch2"), "norm")


def acc_blocks(spark: SparkSession, cfg: Config, keys: DataFrame, spectra: DataFrame, couplings: DataFrame, xi: DataFrame) -> DataFrame:
    """Banded blocks of T and E spectra from kernels (ch1, ch2, d, i, j, v) precomputed at the central multipole.

    Both orders of a channel pair are served, the second as the transpose; kernels are scaled to unit sum."""
    both = couplings.unionByName(couplings.where("ch1 <> ch2").select(F.col("ch2").alias("ch1"), F.col("ch1").alias("ch2"), "d", F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    both = R.unit_sum(both, ["ch1", "ch2", "d"])
    plans = [acc_products(keys, K.norm_table(spark), swapped) for swapped in (False, True)]
    lost = K.missing(K.required_pairs(plans[0].unionByName(plans[1])), both.select("ch1", "ch2").distinct()).collect()
    if lost:
        raise ValueError(f"kernels are missing for {sorted((r.ch1, r.ch2) for r in lost)}")
    out = R.acc_bands(plans[0], spectra, both, xi, l_star=cfg.central_ell, dmax=cfg.dmax, mirrored=plans[1])
    return out.select("id.idx1", "id.idx2", "l1", "l2", "v")


def leakage_products(spark: SparkSession, keys: DataFrame, parity_mixed: bool, swapped: bool) -> DataFrame:
    """Wick products of every block with E-B leakage: (id, coef, left, ch1, right, ch2)."""
    b = K.block_positions(keys, parity_mixed)
    one, two = ("b", "a") if swapped else ("a", "b")
    leg = lambda k, n: [F.col(f"{k}_s{n}"), F.col(f"{k}_f{n}")]
    legs = {"p": leg(one, 1), "q": leg(one, 2), "r": leg(two, 1), "s": leg(two, 2)}
    parts = []
    for term, order in enumerate(("prqs", "psqr")):
        named = [x.alias(n) for k, letter in zip(order, "wxyz", strict=True) for x, n in zip(legs[k], (letter, f"f{letter}"), strict=True)]
        parts.append(b.select("idx1", "idx2", F.lit(term).alias("term"), *named))
    every = parts[0].unionByName(parts[1]).withColumn("id", F.struct("idx1", "idx2", "term"))
    columns = spark.createDataFrame(K.COLUMNS, "letter string, true string, kernel string, sign int")
    terms = K.wick_with_b(every.select("id", *"wxyz"), columns).join(every.select("id", "fw", "fx", "fy", "fz"), "id")
    at = lambda c, k: F.substring(c, k, 1)
    return terms.select(
        F.struct("id.idx1", "id.idx2").alias("id"), "coef", C.canonical_key(at("left", 1), at("left", 2), "fw", "fx").alias("left"), "ch1",
        C.canonical_key(at("right", 1), at("right", 2), "fy", "fz").alias("right"), "ch2",
    )


def leakage_blocks(spark: SparkSession, cfg: Config, keys: DataFrame, spectra: DataFrame, couplings: DataFrame, square_wl: np.ndarray) -> DataFrame:
    """Banded blocks of a run with B observables: every block, T and E ones too, term by term."""
    both = couplings.unionByName(couplings.where("ch1 <> ch2").select(F.col("ch2").alias("ch1"), F.col("ch1").alias("ch2"), "d", F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    wl = spark.createDataFrame([(k, float(v)) for k, v in enumerate(square_wl)], "l int, wl double")
    x = dense.coupling_kernels(wl, max(cfg.lmax - 1, cfg.central_ell + cfg.dmax), symmetric=True)
    pick = lambda c: F.max(F.when(F.col("channel") == c, F.col("v")))
    wide = x.groupBy("l1", "l2").agg(pick("TT").alias("x00"), pick("TE").alias("x20"), pick("EEpBB").alias("p"), pick("EEmBB").alias("m"))
    wide = wide.select("l1", "l2", "x00", "x20", ((F.col("p") + F.col("m")) / 2).alias("xee"), ((F.col("p") - F.col("m")) / 2).alias("xeb"))
    scale = R.term_scale(wide, both.groupBy("ch1", "ch2", "d").agg(F.sum("v").alias("s")), cfg.central_ell).where(f"m + d < {cfg.lmax}")
    plans = [leakage_products(spark, keys, cfg.parity_mixed, swapped) for swapped in (False, True)]
    lost = K.missing(K.required_pairs(plans[0].unionByName(plans[1])), both.select("ch1", "ch2").distinct()).collect()
    if lost:
        raise ValueError(f"kernels are missing for {sorted((r.ch1, r.ch2) for r in lost)}")
    out = R.acc_bands(plans[0], spectra, both, scale, l_star=cfg.central_ell, dmax=cfg.dmax, mirrored=plans[1], by=("ch1", "ch2"))
    return out.select("id.idx1", "id.idx2", "l1", "l2", "v")


def kernel_pairs(spark: SparkSession, cfg: Config) -> list[tuple[str, str]]:
    """Channel pairs whose kernels a run by precomputed kernels needs, each in one order."""
    with_b = any("B" in o for o in cfg.observables)
    pairs = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(cfg.stokes_pairs)], "p_idx int, s1 string, s2 string")
    keys = K.spectrum_keys(*K.field_dims(spark, sorted({s for p in cfg.stokes_pairs for s in p}, reverse=True), cfg.frequencies), pairs=pairs)
    plans = [leakage_products(spark, keys, cfg.parity_mixed, x) if with_b else acc_products(keys, K.norm_table(spark), x) for x in (False, True)]
    found = {tuple(sorted((r.ch1, r.ch2))) for r in K.required_pairs(plans[0].unionByName(plans[1])).collect()}
    if not with_b and ("TT", "DD") in {p[::-1] for p in found} | found:
        found.add(("LL", "TT"))  # for the error budget
    return sorted(found)


def covariance(
    spark: SparkSession, params: dict[str, Any], mask_wl: np.ndarray, square_wl: np.ndarray, couplings: DataFrame | None = None, mask_alm: np.ndarray | None = None,
    *, keep: Callable[[str, dict, Callable[[], DataFrame]], DataFrame] | None = None, ratio: DataFrame | None = None,
) -> Result:
    """The covariance of a run from the spectra of its mask and of the mask's square.

    The method acc takes kernels from ``operators.sky.coupling_kernels`` as well; spectra are then read
    as far beyond lmax as the kernels reach.  A map filter needs the mask's coefficients too, or its ``ratio``.
    ``keep(name, identity, compute)`` may store tables that depend on the identity alone."""
    cfg = Config.of(params)
    if cfg.raw.get("map_filter") and mask_alm is None and ratio is None:
        raise ValueError("map_filter needs the mask's coefficients")
    keep = keep or (lambda name, of, compute: compute())
    of_mask = {"wl": digest(mask_wl), "square": digest(square_wl), "lmax": cfg.lmax}
    xi, smooth = (keep(name, of_mask | {"kernel": name}, lambda k=k: kernels(spark, cfg, mask_wl, square_wl)[k]) for k, name in enumerate(("xi", "smooth")))
    if cfg.method == "acc":
        if couplings is None:
            raise ValueError("acc needs precomputed kernels")
        with_b = any("B" in o for o in cfg.observables)
        if with_b and cfg.central_ell < 2:
            raise ValueError("leakage needs centralell of 2 or more")
        reach = couplings.agg(F.max("j")).first()[0]
        padded = replace(cfg, lmax=cfg.lmax + max(0, reach - cfg.central_ell))
        keys, spectra, debias = model(spark, padded)
        debias = debias.where(F.col("ell") < cfg.lmax)
        raw = lambda: leakage_blocks(spark, cfg, keys, spectra, couplings, square_wl) if with_b else acc_blocks(spark, cfg, keys, spectra, couplings, xi)
    else:
        keys, spectra, debias = model(spark, cfg)
        smoothed = STRATEGIES[cfg.method](spectra, smooth)
        products = K.contractions(K.block_positions(keys, cfg.parity_mixed))
        raw = lambda: R.nka_blocks(products, R.spectra_arrays(smoothed, cfg.lmax - 1), xi, K.norm_table(spark))
    if cfg.raw.get("save_raw_blocks"):
        inputs = spectra.select(F.sum(F.xxhash64("canon", "ell", "v").cast("decimal(38,0)")).cast("string").alias("d"), F.count("*").alias("n")).first()
        of = of_mask | {"method": cfg.method, "spectra": inputs.d, "rows": inputs.n, "observables": cfg.observables, "parity_mixed": cfg.parity_mixed, "centre": cfg.central_ell, "dmax": cfg.dmax}
        blocks = keep("blocks", of, raw)
    else:
        blocks = raw()
    if cfg.raw.get("map_filter"):
        blocks = filtered_blocks(spark, cfg, keys, blocks, debias, filter_ratio(spark, cfg, mask_alm) if ratio is None else ratio)
    table = [(k, lo, hi) for k, (lo, hi) in enumerate(zip(cfg.edges[:-1], cfg.edges[1:], strict=True))]
    bins = spark.createDataFrame(table, "bin int, lo int, hi int")
    weights = R.bin_weights(S.grid(spark, cfg.lmax), bins, lmin=cfg.lmin, flatten=not cfg.use_dl)
    rows = weights.collect()
    order = {b: i for i, b in enumerate(sorted({r.bin for r in rows}))}
    w = np.zeros((len(order), cfg.lmax))
    for r in rows:
        w[order[r.bin], r.ell] = r.w
    listed = keys.orderBy("idx").collect()
    factors = {k.canon: np.ones(cfg.lmax) for k in listed}
    for r in debias.join(F.broadcast(keys.select("canon")), "canon").select("canon", "ell", "v").toArrow().to_pylist():
        factors[r["canon"]][r["ell"]] = r["v"]
    legs = leg_matrices(cfg, listed, factors, w, mask_wl if cfg.polspice else None)
    matrix = R.full_matrix(fold_legs(blocks, legs))
    if cfg.fold:
        from pyspark.sql import Window

        letters = F.least(F.concat("s1", "s2"), F.concat("s2", "s1"))
        fold = keys.select("idx", F.min("idx").over(Window.partitionBy("f1", "f2", letters)).alias("new_idx"))
        matrix = R.fold_mirrored(matrix, fold)
    return Result(cfg, keys, weights, matrix, legs, smooth, debias, spectra)


def window_table(result: Result) -> DataFrame:
    """(spectrum, bin, ell, v): window functions of every spectrum, from lmin on.

    The leg of a spectrum (binning, scaling, debiasing, regularisation) times the coupling kernel of its letters
    times its data model: what a bandpower takes from each multipole of the true spectrum."""
    spark, cfg = result.keys.sparkSession, result.config
    rows = [(idx, b, k, float(x)) for idx, leg in result.legs.items() for b in range(len(leg)) for k, x in enumerate(leg[b]) if x]
    legs = spark.createDataFrame(rows, "idx int, bin int, l1 int, w double")
    spectrum = F.concat("s1", "s2", F.lit("_"), "f1", F.lit("x"), "f2").alias("spectrum")
    named = result.keys.select("idx", "canon", spectrum, F.concat("s1", "s2").alias("stokes"))
    summed = legs.join(named, "idx").join(result.smooth, ["stokes", "l1"]).groupBy("idx", "canon", "spectrum", "bin", "l2").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    out = summed.join(result.model.select("canon", F.col("ell").alias("l2"), "d"), ["canon", "l2"]).where(F.col("l2") >= cfg.lmin)
    return out.select("spectrum", "bin", F.col("l2").alias("ell"), (F.col("v") * F.col("d")).alias("v"))


def write_windows(result: Result, folder: str) -> None:
    """``window_table`` as text, a folder for each spectrum, rows ell, bin and value."""
    line = F.concat_ws(" ", "ell", "bin", F.format_string("%.18e", "v"))
    out = window_table(result).select("spectrum", "ell", "bin", line.alias("value"))
    out.repartition("spectrum").sortWithinPartitions("spectrum", "ell", "bin").select("spectrum", "value").write.partitionBy("spectrum").mode("overwrite").text(folder)


def conditioning_text(matrix: np.ndarray) -> str:
    d = np.diag(matrix)
    ok = d > 0
    scale = np.where(ok, 1 / np.sqrt(np.where(ok, d, 1.0)), 0.0)
    value = np.linalg.eigvalsh((matrix + matrix.T) / 2 * np.outer(scale, scale))
    top = np.abs(matrix).max() or 1.0
    lines = [f"asymmetry {np.abs(matrix - matrix.T).max() / top:.6e}", f"diagonal entries not positive {int((~ok).sum())}", f"smallest eigenvalue {value[0]:.6e}", f"largest eigenvalue {value[-1]:.6e}"]
    return "\n".join([*lines, f"condition number {value[-1] / value[0] if value[0] else math.inf:.6e}"]) + "\n"


def error_budget_table(result: Result, couplings: DataFrame) -> DataFrame:
    """(idx1, idx2, n_e, bias, ratio): each block's known bias from E to B leakage in kernels that leave it out."""
    ratio = R.leakage_ratio(couplings.groupBy("ch1", "ch2", "d").agg(F.sum("v").alias("s"))).where("d = 0").select("ratio")
    b = K.block_positions(result.keys, result.config.parity_mixed).select("idx1", "idx2", F.concat("a_s1", "a_s2").alias("stokes1"), F.concat("b_s1", "b_s2").alias("stokes2"))
    return R.error_budget(b.crossJoin(F.broadcast(ratio)), "ratio")


def error_budget_text(result: Result, couplings: DataFrame, square_wl: np.ndarray) -> str:
    """What is known of the errors of a run by precomputed kernels: leakage by block, distance from the centre, sum rules."""
    cfg, spark = result.config, result.keys.sparkSession
    lines = ["Error budget (reported; nothing is corrected)", f"centralell {cfg.central_ell}, dmax {cfg.dmax}, lmin {cfg.lmin}, lmax {cfg.lmax}", ""]
    if any("B" in o for o in cfg.observables):
        lines += ["leakage from E to B is part of this run's kernels"]
    elif all(o == "TT" for o in cfg.observables):
        lines += ["no polarised block"]
    else:
        for r in error_budget_table(result, couplings).orderBy("idx1", "idx2").collect():
            lines.append(f"block {r.idx1} x {r.idx2} ({r.stokes1} x {r.stokes2}): {r.n_e} polarised legs, relative bias {r.bias if r.bias is not None else math.nan:+.3e}")
    far = max(abs(e - cfg.central_ell) for e in (cfg.edges[0], cfg.edges[-1]))
    lines += ["", f"translation of kernels from the central multipole: not bounded, farthest bin edge {far} away"]
    top = cfg.central_ell + cfg.dmax
    x = N.xi_kernels(square_wl, top, np.array([cfg.central_ell]))
    xi = spark.createDataFrame([(cfg.central_ell, k, float(x["TT"][0, k]), float(x["TE"][0, k])) for k in range(cfg.central_ell, top + 1)], "l1 int, l2 int, x00 double, x20 double")
    both = couplings.unionByName(couplings.where("ch1 <> ch2").select(F.col("ch2").alias("ch1"), F.col("ch1").alias("ch2"), "d", "i", "j", "v"))
    for r in R.normalisation_consistency(both.groupBy("ch1", "ch2", "d").agg(F.sum("v").alias("s")), xi, cfg.central_ell).orderBy("rule").collect():
        lines.append(f"sum rule {r.rule}: off by at most {r.worst:.3e}, at distance {r.at}")
    return "\n".join(lines) + "\n"


def leakage_text(result: Result, mask_wl: np.ndarray) -> str | None:
    """For a run of BB alone without leakage kernels: up to where the leakage of EE into BB matters."""
    cfg, spark = result.config, result.keys.sparkSession
    if cfg.method == "acc" or cfg.observables != ("BB",):
        return None
    m = N.master_kernels(mask_wl, cfg.lmax - 1)
    frame = lambda a: spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in np.ndindex(*a.shape)], "l1 int, l2 int, v double")
    one = result.keys.orderBy("idx").first()
    spectrum = lambda s: result.spectra.where((F.col("canon") == one.canon.replace("BB", s))).select("ell", "v")
    infl, safe = R.leakage_limit(frame((m["EEpBB"] + m["EEmBB"]) / 2), frame((m["EEpBB"] - m["EEmBB"]) / 2), spectrum("EE"), spectrum("BB"), lmin=cfg.lmin)
    ell_safe = safe.first()[0]
    lowest = infl.where(F.col("ell").between(cfg.edges[0], cfg.edges[1] - 1)).agg(F.max("inflation")).first()[0]
    return f"leakage of EE into BB is neglected\nell_safe {ell_safe}\nlmax {cfg.lmax}\nreliable {ell_safe < cfg.lmax}\nlowest bin's factor {lowest if lowest is not None else math.nan:.6g}\n"


@dataclass
class Mask:
    """A whole-sky map, cleaned and in ring order, with its coefficients and those of its square."""

    values: np.ndarray
    nside: int
    band: int
    alm: np.ndarray
    square: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, band: int | None = None) -> Mask:
        values, bad = sky.clean(values)
        if bad:
            warnings.warn(f"{bad} bad pixels of the mask count as 0", stacklevel=2)
        if not values.any():
            raise ValueError("the mask is empty")
        if (values < 0).any() or (values > 1 + 1e-6).any():
            warnings.warn(f"mask values from {values.min():.3g} to {values.max():.3g}: not within 0 and 1", stacklevel=2)
        nside = math.isqrt(len(values) // 12)
        band = band or 2 * nside
        return cls(values, nside, band, sky.map_alm(values, band), sky.map_alm(values**2, band))

    def identity(self) -> dict[str, Any]:
        return {"mask": digest(self.values), "nside": self.nside, "lw": self.band}


def read_mask(spark: SparkSession, params: dict[str, Any]) -> np.ndarray:
    """A whole-sky map in ring order from a FITS file or a Parquet table (pix, w); bounded by one map's size."""
    path = params["mask_name"] if params["mask_name"].startswith("/") else f"{params['mask_path'].rstrip('/')}/{params['mask_name']}"
    if path.endswith(".parquet"):
        rows = spark.read.parquet(path).orderBy("pix").select("w").toArrow()
        return rows.column("w").to_numpy()
    body = spark.read.format("binaryFile").load(path).select("content").first()[0]
    header, columns = S.parse_fits(bytes(body))
    values = next(iter(columns.values()))
    order = header.get("ORDERING", "RING").upper()
    if order not in ("RING", "NESTED"):
        raise ValueError(f"unknown pixel order {order!r}")
    return sky.ring_order(values) if order == "NESTED" else values


def kernel_folder(params: dict[str, Any]) -> str:
    """Where a run's precomputed kernels lie: acc_precompute.save_dir, or beside the results."""
    return ((params.get("acc_precompute") or {}).get("save_dir") or f"{params['cov_path']}/kernels").rstrip("/")


def kernel_identity(params: dict[str, Any], mask: Mask) -> dict[str, Any]:
    """What the kernels depend on beside the channel pair and the distance."""
    return mask.identity() | {"centralell": params["centralell"], "tolerance": (params.get("acc_precompute") or {}).get("tolerance"), "band": kernel_band(params, mask)}


def kernel_band(params: dict[str, Any], mask: Mask) -> int:
    """Multipoles that kernels reach: the mask's coupling around the centre in full, or acc_precompute.lmax."""
    return (params.get("acc_precompute") or {}).get("lmax") or params["centralell"] + params["dmax"] - 1 + mask.band


def precompute(spark: SparkSession, params: dict[str, Any], mask: Mask | None = None) -> str:
    """All kernels that a run by precomputed kernels needs, into its folder; those that lie there already stay.  Returns the folder.

    With acc_precompute.tolerance only the terms that carry the kernels are computed, on the mask turned to the pole."""
    cfg = Config.of(params)
    if cfg.method != "acc":
        raise ValueError("only the method acc uses precomputed kernels")
    mask = mask or Mask.of(read_mask(spark, params))
    folder, identity = kernel_folder(params), kernel_identity(params, mask)
    tolerance = identity["tolerance"]
    alm = mask.alm if tolerance is None else N.to_pole(mask.alm, *sky.pole_direction(mask.values))
    wanted = {(*p, d) for p in kernel_pairs(spark, cfg) for d in range(cfg.dmax)}
    said = store.manifest(spark, folder)
    if said is not None:
        if wrong := store.differences(said["identity"], identity):
            raise store.IdentityError("; ".join(wrong))
        wanted -= {tuple(x) for x in said["kernels"]}
    if wanted:
        pairs, first = sorted({x[:2] for x in wanted}), min(x[2] for x in wanted)
        made = sky.coupling_kernels(spark, sky.field_of(alm), identity["band"], mask.band, cfg.central_ell, cfg.dmax, pairs, alm=alm, tolerance=tolerance, first=first)
        store.write_kernels(spark, folder, made, identity)
    return folder


def run(spark: SparkSession, params: dict[str, Any], *, overwrite: int | None = None, windows: bool = False, dry: bool = False) -> str:
    """Everything into a versioned folder; returns it.  The record is written even on failure.

    Kernels, the filter's ratio and, with save_raw_blocks, raw blocks are kept in a cache beside the versions and
    found again by what they depend on.  Precomputed kernels are computed where they are missing."""
    record = RunRecord(params)
    folder = versioned(spark, params["cov_path"], params["cov_name"], overwrite)
    try:
        mask = Mask.of(read_mask(spark, params))
        record.add("derived", nside=mask.nside, mask_band_limit=mask.band, mask_digest=digest(mask.values))
        wl, square = sky.power(mask.alm), sky.power(mask.square)
        keep = lambda name, of, compute: cached(spark, f"{params['cov_path']}/cache", name, of, compute)
        cfg = Config.of(params)
        if dry:
            record.add("provenance", status="dry run")
            return folder
        couplings = ratio = None
        if cfg.method == "acc":
            precompute(spark, params, mask)
            couplings = store.read_kernels(spark, kernel_folder(params), kernel_identity(params, mask), kernel_pairs(spark, cfg), cfg.dmax)
        if cfg.raw.get("map_filter"):
            ratio = keep("ratio", mask.identity() | {"filter": cfg.raw["map_filter"], "lmax": cfg.lmax, "channels": channels_of(spark, cfg)}, lambda: filter_ratio(spark, cfg, mask.alm))
        result = covariance(spark, params, wl, square, couplings, mask.alm, keep=keep, ratio=ratio)
        matrix = result.dense()
        record.add("derived", observables=list(cfg.observables), bins=len(result.centres()), spectra=[r.canon for r in result.keys.orderBy("idx").collect()])
        put_text(spark, f"{folder}/{params['cov_name']}", table_text(matrix))
        put_text(spark, f"{folder}/lbins.dat", table_text(result.centres()))
        put_text(spark, f"{folder}/conditioning.txt", conditioning_text(matrix))
        if couplings is not None:
            put_text(spark, f"{folder}/error_budget.txt", error_budget_text(result, couplings, square))
        if (told := leakage_text(result, wl)) is not None:
            put_text(spark, f"{folder}/bb_leakage_warning.txt", told)
        if ratio is not None:
            ratio.write.mode("overwrite").parquet(f"{folder}/map_filter_ratio.parquet")
        if windows or params.get("save_windows"):
            write_windows(result, f"{folder}/window_functions")
        record.add("provenance", status="done")
    except BaseException as e:
        record.add("provenance", status=f"failed: {e}")
        raise
    finally:
        record.write(spark, f"{folder}/params_resolved.yml")
    return folder
