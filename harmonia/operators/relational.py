"""Joins and aggregations over long tables: spectra(key, ell, v), kernel(channel, l1, l2, v), blocks.

Spectra, bins and kernels of one run are small beside the blocks and are broadcast only while their
row count is under ``SMALL``; beyond it Spark joins by shuffling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import bin_weight, c, ell_factor, finite_or, nka_average, safe_divide

SMALL = 500_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast hint for a side whose size is known to be at most SMALL rows."""
    return F.broadcast(df) if rows is not None and rows <= SMALL else df


def alm_to_cl(a: DataFrame, b: DataFrame, by_a: Sequence[str], by_b: Sequence[str]) -> DataFrame:
    """Cross power (l): (a_l0 b_l0 + 2 sum_m>0 Re a b*) / (2l + 1); tables (by..., l, m, re, im)."""
    x = a.select(*[F.col(k) for k in by_a], "l", "m", F.col("re").alias("ar"), F.col("im").alias("ai"))
    y = b.select(*[F.col(k) for k in by_b], "l", "m", F.col("re").alias("br"), F.col("im").alias("bi"))
    own = F.when(F.col("m") == 0, 1.0).otherwise(2.0) * (F.col("ar") * F.col("br") + F.col("ai") * F.col("bi"))
    joined = x.join(y, ["l", "m"])
    return joined.groupBy(*by_a, *by_b, "l").agg((F.sum(own) / (2 * F.col("l") + 1)).alias("v")).withColumnRenamed("l", "ell")


def nested_combine(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str, missing: str = "identity") -> DataFrame:
    """Add or multiply two (keys..., v) tables; a key on one side only is an error or keeps its value."""
    x, y = a.select(*keys, F.col("v").alias("va")), b.select(*keys, F.col("v").alias("vb"))
    joined = x.join(y, list(keys), "full")
    unit = 0.0 if how == "add" else 1.0
    if missing == "error":
        lone = F.col("va").isNull() | F.col("vb").isNull()
        va, vb = (F.when(lone, F.raise_error(F.lit("a key is missing on one side"))).otherwise(F.col(n)) for n in ("va", "vb"))
    else:
        va, vb = F.coalesce("va", F.lit(unit)), F.coalesce("vb", F.lit(unit))
    return joined.select(*keys, (va + vb if how == "add" else va * vb).alias("v"))


def bin_weights(ells: DataFrame, bins: DataFrame, *, lmin: int = 0, flatten: bool = True) -> DataFrame:
    """(bin, ell, w): half-open bins, weight 0 below lmin, rows summing to one, empty bins dropped."""
    own = ells.join(F.broadcast(bins), (F.col("ell") >= F.col("lo")) & (F.col("ell") < F.col("hi")))
    own = own.withColumn("w0", F.when(F.col("ell") < lmin, 0.0).otherwise(bin_weight("ell", flatten)))
    total = F.sum("w0").over(Window.partitionBy("bin"))
    return own.withColumn("s", total).where("s > 0 and w0 > 0").select("bin", "ell", (F.col("w0") / F.col("s")).alias("w"))


def bin_spectrum(spectra: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    return spectra.join(F.broadcast(weights), "ell").groupBy(*keys, "bin").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def bin_blocks(cov: DataFrame, weights: DataFrame, keys: Sequence[str] = ("idx1", "idx2")) -> DataFrame:
    """B C B^T of long blocks (keys, l1, l2, v): both weight joins are broadcast, one aggregation."""
    left = F.broadcast(weights.select(F.col("bin").alias("bin1"), F.col("ell").alias("l1"), F.col("w").alias("w1")))
    right = F.broadcast(weights.select(F.col("bin").alias("bin2"), F.col("ell").alias("l2"), F.col("w").alias("w2")))
    return cov.join(left, "l1").join(right, "l2").groupBy(*keys, "bin1", "bin2").agg(F.sum(F.col("w1") * F.col("w2") * F.col("v")).alias("v"))


def matvec(matrix: DataFrame, vector: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """sum_l2 M[l1, l2] x[l2]; a broadcast-sized vector keeps the matrix where it is."""
    x = vector.select(*keys, F.col("ell").alias("l2"), F.col("v").alias("x"))
    out = matrix.join(x, [*keys, "l2"]) if keys and keys[0] in matrix.columns else matrix.join(x, "l2")
    return out.groupBy(*keys, F.col("l1").alias("ell")).agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def matmul(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long matrix product over the shared index; for dense blocks beyond a few hundred use the Arrow path."""
    x = a.select(*keys, "l1", F.col("l2").alias("k"), F.col("v").alias("va"))
    y = b.select(*[k for k in keys if k in b.columns], F.col("l1").alias("k"), "l2", F.col("v").alias("vb"))
    on = [k for k in keys if k in b.columns] + ["k"]
    return x.join(y, on).groupBy(*keys, "l1", "l2").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(*[F.col("l2").alias("l1") if k == "l1" else F.col("l1").alias("l2") if k == "l2" else F.col(k) for k in a.columns])


def row_normalise(kernel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    total = F.sum("v").over(Window.partitionBy(*keys, "l1"))
    return kernel.withColumn("s", total).withColumn("v", F.col("v") / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).drop("s")


def unit_sum(kernel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Divide each kernel by its sum unless that is 1 within 1e-8 + 1e-5."""
    sums = kernel.groupBy(*keys).agg(F.sum("v").alias("s"))
    near = F.abs(F.col("s") - 1) <= 1e-8 + 1e-5
    return kernel.join(sums, list(keys)).withColumn("v", F.when(near, F.col("v")).otherwise(safe_divide("v", "s"))).drop("s")


def spectra_arrays(spectra: DataFrame, lmax: int) -> DataFrame:
    """(canon, c): one array per spectrum, index l, 0 where there is no row."""
    grouped = spectra.where(F.col("ell").between(0, lmax)).groupBy("canon").agg(F.map_from_entries(F.collect_list(F.struct("ell", "v"))).alias("m"))
    return grouped.select("canon", F.transform(F.sequence(F.lit(0), F.lit(lmax)), lambda l: F.coalesce(F.try_element_at("m", l), F.lit(0.0))).alias("c"))


def nka_blocks(products: DataFrame, arrays: DataFrame, xi: DataFrame, norms: DataFrame) -> DataFrame:
    """Narrow-kernel blocks (idx1, idx2, l1, l2, v).

    A block's two contractions, with their spectra, are one row of a broadcast plan (as many rows as blocks),
    and ``xi(norm, l1, l2, v)`` has its norms side by side: every element of a block is one projection of one
    joined row, so nothing as large as the blocks is shuffled or aggregated."""
    left = arrays.select(F.col("canon").alias("left"), F.col("c").alias("cl"))
    right = arrays.select(F.col("canon").alias("right"), F.col("c").alias("cr"))
    plan = products.withColumn("ls", F.translate("left_stokes", "B", "E")).withColumn("rs", F.translate("right_stokes", "B", "E"))
    plan = plan.join(F.broadcast(norms.toDF("ls", "rs", "norm")), ["ls", "rs"]).join(left, "left").join(right, "right")
    plan = plan.groupBy("idx1", "idx2").agg(F.collect_list(F.struct("norm", "left_stokes", "right_stokes", "cl", "cr")).alias("t"))
    plan = plan.select("idx1", "idx2", F.get("t", F.lit(0)).alias("one"), F.get("t", F.lit(1)).alias("two"))
    wide = xi.groupBy("l1", "l2").agg(F.map_from_entries(F.collect_list(F.struct("norm", "v"))).alias("x"))

    def value(t: str) -> Column:
        at = lambda a, l: F.get(F.col(f"{t}.{a}"), F.col(l))
        pair = nka_average(at("cl", "l1"), at("cl", "l2"), f"{t}.left_stokes") * nka_average(at("cr", "l1"), at("cr", "l2"), f"{t}.right_stokes")
        return pair * F.try_element_at("x", F.col(f"{t}.norm"))

    none = F.lit(0.0)
    return wide.crossJoin(F.broadcast(plan)).select("idx1", "idx2", "l1", "l2", (F.coalesce(value("one"), none) + F.coalesce(value("two"), none)).alias("v"))


def inka_spectra(spectra: DataFrame, master: DataFrame) -> DataFrame:
    """Spectra smoothed by the row-normalised coupling kernel of their letters.

    ``spectra(canon, stokes, ell, v)``, ``master(stokes, l1, l2, v)``."""
    kernel = row_normalise(master, ["stokes"])
    joined = kernel.join(spectra.select("canon", "stokes", F.col("ell").alias("l2"), F.col("v").alias("x")), ["stokes", "l2"])
    return joined.groupBy("canon", "stokes", F.col("l1").alias("ell")).agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def acc_bands(
    products: DataFrame, spectra: DataFrame, kernels: DataFrame, xi: DataFrame, *, l_star: int, dmax: int, mirrored: DataFrame | None = None, by: Sequence[str] = ("norm",)
) -> DataFrame:
    """Blocks of the precomputed-kernel approximation, |l1 - l2| < dmax.

    ``products(id, coef, left, ch1, right, ch2, norm)``; ``kernels(ch1, ch2, d, i, j, v)`` with unit sum at the central
    multipole; element (m, m + d) = sum coef C_left[m - l* + i] K_ij C_right[m - l* + j] Xi[m, m + d].  The shift by
    m turns the sliding window into two equi-joins; indices below 0 contribute nothing.  The lower
    triangle comes from ``mirrored`` products (both keys swapped); without them blocks are symmetric.
    ``xi`` may instead hold ``term_scale`` rows, joined ``by`` the channel pair, with raw kernels."""
    left = spectra.select(F.col("canon").alias("left"), F.col("ell").alias("p"), F.col("v").alias("cl"))
    right = spectra.select(F.col("canon").alias("right"), F.col("ell").alias("q"), F.col("v").alias("cr"))
    scale = xi if "x" in xi.columns else xi.select("norm", F.col("l1").alias("m"), (F.col("l2") - F.col("l1")).alias("d"), F.col("v").alias("x"))
    key = list(by)

    def upper(which: DataFrame) -> DataFrame:
        k = kernels.where(F.col("d") < dmax).join(F.broadcast(which), ["ch1", "ch2"])
        shifted = k.join(left, "left").withColumn("m", F.col("p") + l_star - F.col("i")).where("m >= 0").withColumn("q", F.col("m") - l_star + F.col("j"))
        sums = shifted.join(right, ["right", "q"]).groupBy("id", *key, "d", "m").agg(F.sum(F.col("coef") * F.col("cl") * F.col("v") * F.col("cr")).alias("s"))
        return sums.join(scale, [*key, "m", "d"]).groupBy("id", F.col("m").alias("l1"), (F.col("m") + F.col("d")).alias("l2")).agg(F.sum(F.col("s") * F.col("x")).alias("v"))

    up = upper(products)
    below = up if mirrored is None else upper(mirrored)
    return up.unionByName(transpose(below.where("l1 <> l2")))


def term_scale(xi: DataFrame, sums: DataFrame, l_star: int) -> DataFrame:
    """(ch1, ch2, d, m, x): what each Wick term of a run with leakage is multiplied by, raw kernels given.

    ``xi(l1, l2, x00, x20, xee, xeb)``, ``sums(ch1, ch2, d, s)`` with s the raw kernel's sum.  Letters predict a sum
    P = Xi^(spin) (xeb / xee)^(turned / 2) per mode pair: spin is half the letters other than T, turned counts the
    leaked ones.  The kernel's efficiency e is its sum over the prediction at the centre, and x = P e(m) / s, where
    e(m) follows from e by the kernel's class: ``RULES`` below."""
    count = lambda of, letters: F.length(F.regexp_replace(F.concat(*of), f"[^{letters}]", ""))
    one_each = (count(["ch1"], "L") == 1) & (count(["ch2"], "L") == 1)
    kinds = sums.select("*", (count(["ch1", "ch2"], "DL") / 2).alias("spin"), count(["ch1", "ch2"], "L").alias("turned"))
    kinds = kinds.withColumn("rule", F.when(F.col("spin") == 0, "scalar").when(F.col("turned") == 0, "direct").when(one_each, "crossed").otherwise("held"))

    pairs = xi.where("l2 >= l1").select("l1", (F.col("l2") - F.col("l1")).alias("d"), "x00", "x20", "xee", F.greatest(safe_divide("xeb", "xee"), F.lit(0.0)).alias("mixing"))
    centre = pairs.where(F.col("l1") == l_star).drop("l1").select("d", F.struct("x00", "x20", "xee", "mixing").alias("centre"))
    rows = pairs.select("l1", "d", F.struct("x00", "x20", "xee", "mixing").alias("here")).join(F.broadcast(kinds.join(centre, "d")), "d")

    def predicted(at: str) -> Column:
        power = F.pow(F.greatest(safe_divide(f"{at}.x20", f"{at}.x00"), F.lit(0.0)), F.col("spin"))
        tabulated = F.element_at(F.create_map(F.lit(0.0), F.col(f"{at}.x00"), F.lit(1.0), F.col(f"{at}.x20"), F.lit(2.0), F.col(f"{at}.xee")), F.col("spin").cast("double"))
        return F.coalesce(tabulated, F.col(f"{at}.x00") * power) * F.when(F.col("turned") > 0, F.pow(f"{at}.mixing", F.col("turned") / 2)).otherwise(1.0)

    modes = (2 * l_star + 1) * (2 * (l_star + F.col("d")) + 1)
    rows = rows.withColumn("p", predicted("here")).withColumn("p_centre", predicted("centre"))
    checked = F.when(F.col("p_centre") > 0, F.col("p_centre")).otherwise(F.raise_error(F.concat(F.lit("prediction not positive at the central multipole: "), "ch1", "ch2")))
    rows = rows.withColumn("e", F.try_divide("s", modes * checked))
    up = F.when(F.col("e") >= 0, 1.0).otherwise(-1.0)
    nearness = (2 * l_star + F.col("d") + 1) / (2 * F.col("l1") + F.col("d") + 1)
    RULES = {
        "scalar": F.try_divide("here.x00", "s"),
        # What a direct kernel lacks falls with the mixing.
        "direct": F.try_divide(F.col("p") * (1 - (1 - F.col("e")) * F.try_divide("here.mixing", "centre.mixing")), "s"),
        # Crossed ones go to a quarter of their sign far from the centre, and stay between 0 and a half of it.
        "crossed": F.try_divide(F.col("p") * up * F.greatest(F.lit(0.0), F.least(F.lit(0.5), 0.25 + (F.abs("e") - 0.25) * nearness)), "s"),
        "held": F.try_divide("p", modes * checked),
    }
    x = F.coalesce(*[F.when(F.col("rule") == rule, value) for rule, value in RULES.items()])
    return rows.select("ch1", "ch2", "d", F.col("l1").alias("m"), x.alias("x"))


def normalisation_consistency(sums: DataFrame, xi: DataFrame, l_star: int) -> DataFrame:
    """(rule, worst, at): largest relative deviation over d of the kernels' sum rules at the central multipole, and where,
    sum TT x TT = n Xi^00 and sum TT x DD + sum TT x LL = n Xi^20; ``xi(l1, l2, x00, x20)``."""
    n = (2 * l_star + 1) * (2 * (l_star + F.col("d")) + 1)
    star = xi.where(F.col("l1") == l_star).select((F.col("l2") - l_star).alias("d"), "x00", "x20").where("d >= 0")
    rule = F.when(F.col("ch2") == "TT", "00").otherwise("20")
    own = sums.where("ch1 = 'TT' and ch2 in ('TT', 'DD', 'LL')").groupBy("d", rule.alias("rule")).agg(F.sum("s").alias("s"))
    off = F.abs(safe_divide("s", n * F.when(F.col("rule") == "00", F.col("x00")).otherwise(F.col("x20"))) - 1)
    return own.join(F.broadcast(star), "d").groupBy("rule").agg(F.max(off).alias("worst"), F.max_by("d", off).alias("at"))


def leakage_ratio(sums: DataFrame) -> DataFrame:
    """lambda = sum TT x LL / sum TT x DD, for each distance d."""
    pick = lambda b: F.sum(F.when((F.col("ch1") == "TT") & (F.col("ch2") == b), F.col("s")))
    return sums.groupBy("d").agg(safe_divide(pick("LL"), pick("DD")).alias("ratio"))


def orient(kernel: DataFrame) -> DataFrame:
    """(l1, l2, v) with the (2 l2 + 1) factor on the second index, transposing a table that has it on the first."""
    sides = kernel.join(transpose(kernel).withColumnRenamed("v", "t"), ["l1", "l2"])
    gap = lambda a, b: F.max(F.abs(F.col("v") / F.lit(1.0) * (2 * F.col(a) + 1) - F.col("t") * (2 * F.col(b) + 1)))
    kept = sides.agg(gap("l1", "l2").alias("second"), gap("l2", "l1").alias("first"))
    right = kernel.crossJoin(F.broadcast(kept.where("second <= first"))).select("l1", "l2", "v")
    return right.unionByName(transpose(kernel).crossJoin(F.broadcast(kept.where("second > first"))).select("l1", "l2", "v"))


def mix_sources(blocks: DataFrame, bridge: DataFrame, legs: DataFrame) -> DataFrame:
    """Post-processed blocks of spectra that mix several pseudo-spectra.

    ``bridge(out, src, kernel)`` lists the sources of a spectrum, ``legs(kernel, l1, l2, v)`` the kernels; every output
    block is the sum over the sources of both legs.  ``blocks(idx1, idx2, l1, l2, v)`` must hold both orders."""
    left = F.broadcast(bridge.toDF("out1", "idx1", "kernel"))
    one = blocks.join(left, "idx1").join(legs.select("kernel", F.col("l1").alias("p"), F.col("l2").alias("l1"), F.col("v").alias("g")), ["kernel", "l1"])
    half = one.groupBy("out1", "idx2", F.col("p").alias("l1"), "l2").agg(F.sum(F.col("v") * F.col("g")).alias("v"))
    right = F.broadcast(bridge.toDF("out2", "idx2", "kernel"))
    two = half.join(right, "idx2").join(legs.select("kernel", F.col("l1").alias("q"), F.col("l2"), F.col("v").alias("g")), ["kernel", "l2"])
    out = two.groupBy("out1", "out2", "l1", F.col("q")).agg(F.sum(F.col("v") * F.col("g")).alias("v"))
    return out.select(F.col("out1").alias("idx1"), F.col("out2").alias("idx2"), "l1", F.col("q").alias("l2"), "v")


def full_matrix(blocks: DataFrame) -> DataFrame:
    """Both triangles of binned blocks (idx1, idx2, bin1, bin2, v) as (spec1, bin1, spec2, bin2, v)."""
    up = blocks.select(F.col("idx1").alias("spec1"), "bin1", F.col("idx2").alias("spec2"), "bin2", "v")
    down = blocks.where("idx1 <> idx2").select(F.col("idx2").alias("spec1"), F.col("bin2").alias("bin1"), F.col("idx1").alias("spec2"), F.col("bin1").alias("bin2"), "v")
    return up.unionByName(down)


def scale_blocks(cov: DataFrame, *, dl: bool, debias: DataFrame | None = None, legs: DataFrame | None = None) -> DataFrame:
    """D_l scaling and debiasing of long blocks; ``debias(key, ell, v)``, ``legs(idx, key)``."""
    v = F.col("v") * (ell_factor("l1") * ell_factor("l2") if dl else F.lit(1.0))
    if debias is None:
        return cov.withColumn("v", v)
    own = F.broadcast(legs.join(debias, "key").select("idx", "ell", F.col("v").alias("d")))
    out = cov.join(own.toDF("idx1", "l1", "d1"), ["idx1", "l1"], "left").join(own.toDF("idx2", "l2", "d2"), ["idx2", "l2"], "left")
    return out.withColumn("v", v * F.coalesce("d1", F.lit(1.0)) * F.coalesce("d2", F.lit(1.0))).drop("d1", "d2")


def fold_mirrored(cov: DataFrame, fold: DataFrame) -> DataFrame:
    """Average TE with ET legs: ``fold(idx, new_idx)`` maps each leg; a block is the mean over its shifts."""
    a, b = fold.toDF("spec1", "new1"), fold.toDF("spec2", "new2")
    folded = cov.join(F.broadcast(a), "spec1").join(F.broadcast(b), "spec2")
    n = fold.groupBy("new_idx").agg(F.count("*").cast("double").alias("n"))
    out = folded.groupBy("new1", "new2", "bin1", "bin2").agg(F.sum("v").alias("v"))
    out = out.join(F.broadcast(n.toDF("new1", "n1")), "new1").join(F.broadcast(n.toDF("new2", "n2")), "new2")
    return out.select(F.col("new1").alias("spec1"), "bin1", F.col("new2").alias("spec2"), "bin2", (F.col("v") / (F.col("n1") * F.col("n2"))).alias("v"))


def window_functions(weights: DataFrame, scale: DataFrame, kernel: DataFrame, model: DataFrame) -> DataFrame:
    """W[bin, l'] = sum_l w[bin, l] s[l] K[l, l'] D[l'] (scale and model are (ell, v))."""
    left = weights.join(F.broadcast(scale.select("ell", F.col("v").alias("s"))), "ell").select("bin", F.col("ell").alias("l1"), (F.col("w") * F.col("s")).alias("ws"))
    out = kernel.join(F.broadcast(left), "l1").groupBy("bin", "l2").agg(F.sum(F.col("ws") * F.col("v")).alias("v"))
    return out.join(F.broadcast(model.select(F.col("ell").alias("l2"), F.col("v").alias("d"))), "l2").select("bin", F.col("l2").alias("ell"), (F.col("v") * F.col("d")).alias("v"))


def bands_to_pairs(bands: DataFrame, dmax: int) -> DataFrame:
    """Row dmax - 1 +- d of a flattened band matrix -> (l1, l2): below the middle l2 = l1 + d, above l1 = l2 + d."""
    d = F.col("row") - (dmax - 1)
    l1 = F.when(d >= 0, F.col("ell")).otherwise(F.col("ell") - d)
    return bands.select(l1.alias("l1"), (F.when(d >= 0, F.col("ell") + d).otherwise(F.col("ell"))).alias("l2"), "v")


def running_sum(df: DataFrame, by: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(w))


def coupling_width(wl: DataFrame, share: float = 0.99) -> DataFrame:
    """Smallest L up to which (2L + 1) max(W, 0) holds ``share`` of its total; per group ``g``."""
    own = wl.withColumn("x", (2 * F.col("l") + 1) * F.greatest("wl", F.lit(0.0)))
    run = running_sum(own, ["g"], "l", "x", "upto").withColumn("total", F.sum("x").over(Window.partitionBy("g")))
    return run.where(F.col("upto") >= share * F.col("total")).groupBy("g").agg(F.min("l").alias("width"))


def mask_moment(wl: DataFrame) -> DataFrame:
    weight = (2 * F.col("l") + 1) * F.col("wl")
    return wl.groupBy("g").agg(safe_divide(F.sum(weight * F.col("l") * (F.col("l") + 1)), F.sum(weight)).alias("moment"))


def mask_statistics(mask: DataFrame) -> DataFrame:
    w = F.col("w")
    return mask.groupBy("g").agg(
        F.count("*").alias("n"), F.min(w).alias("lo"), F.max(w).alias("hi"), F.avg(w).alias("mean"), F.stddev_pop(w).alias("std"),
        F.count_if(w == 0).alias("zero"), F.count_if(w < 0).alias("negative"), F.avg(w * w).alias("mean_square"),
    )


def direction_moments(mask: DataFrame, value: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """First moments sum W n / sum W and second ones sum W n n^T / sum W."""
    total = F.sum("w")
    first = [safe_divide(F.sum(F.col("w") * F.col(a)), total).alias(f"c_{a}") for a in value]
    second = [safe_divide(F.sum(F.col("w") * F.col(a) * F.col(b)), total).alias(f"t_{a}{b}") for i, a in enumerate(value) for b in value[i:]]
    return mask.groupBy("g").agg(*first, *second)


def ratio_by_distance(sums: DataFrame, dmax: int, reliable: float = 1e-9, degree: str = "node") -> DataFrame:
    """g[node, d]: mean of the ratios at l' +- d where both are reliable, else the one that is, else the last d's.

    ``sums(node, ell, f, u)``; ``degree`` is the node's multipole, where ``node`` says more.  A degree is reliable if its unfiltered sum exceeds ``reliable`` of the node's largest."""
    top = F.max("u").over(Window.partitionBy("node"))
    ok = sums.withColumn("top", top).where(F.col("u") > reliable * F.col("top")).select("node", "ell", safe_divide("f", "u").alias("r"))
    sides = ok.select("node", F.abs(F.col("ell") - F.col(degree)).cast("int").alias("d"), "r").where(F.col("d") <= dmax)
    found = sides.groupBy("node", "d").agg(F.avg("r").alias("g"))
    grid = sums.select("node").distinct().withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(dmax))))
    held = F.last("g", ignorenulls=True).over(Window.partitionBy("node").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return grid.join(found, ["node", "d"], "left").withColumn("g", F.coalesce(held, F.lit(1.0)))


def asymmetry(matrix: DataFrame) -> DataFrame:
    """Largest |C - C^T|, its size against the largest |C|, and bad diagonal entries, per ``g``."""
    t = transpose(matrix).select("g", "l1", "l2", F.col("v").alias("vt"))
    both = matrix.join(t, ["g", "l1", "l2"], "left")
    diff = F.abs(F.col("v") - F.coalesce("vt", F.lit(0.0)))
    bad = F.count_if((F.col("l1") == F.col("l2")) & (F.col("v") <= 0))
    return both.groupBy("g").agg(F.max(diff).alias("worst"), safe_divide(F.max(diff), F.max(F.abs("v"))).alias("relative"), bad.alias("bad_diagonal"))


def correlation(matrix: DataFrame) -> DataFrame:
    """C_ij / sqrt(C_ii C_jj); rows with a diagonal that isn't positive become 0."""
    diag = matrix.where("l1 = l2").select("g", F.col("l1").alias("k"), F.col("v").alias("dv"))
    out = matrix.join(diag.toDF("g", "l1", "d1"), ["g", "l1"], "left").join(diag.toDF("g", "l2", "d2"), ["g", "l2"], "left")
    ok = (F.col("d1") > 0) & (F.col("d2") > 0)
    return out.select("g", "l1", "l2", F.when(ok, F.try_divide("v", F.sqrt(F.col("d1") * F.col("d2")))).otherwise(0.0).alias("v"))


def leakage_limit(matrix_plus: DataFrame, matrix_minus: DataFrame, ee: DataFrame, bb: DataFrame, *, lmin: int, threshold: float = 1.05) -> tuple[DataFrame, DataFrame]:
    """Inflation (1 + leak / signal)^2 by ell, and the first safe ell after the last unsafe one."""
    leak, signal = matvec(matrix_minus, ee).withColumnRenamed("v", "leak"), matvec(matrix_plus, bb).withColumnRenamed("v", "signal")
    infl = leak.join(signal, "ell").select("ell", F.pow(1 + safe_divide("leak", "signal"), F.lit(2.0)).alias("inflation"))
    safe = infl.where((F.col("ell") >= lmin) & (F.col("inflation") > threshold)).agg(F.coalesce(F.max("ell") + 1, F.lit(lmin)).cast("int").alias("ell_safe"))
    return infl, safe


def error_budget(blocks: DataFrame, lam: Column | str) -> DataFrame:
    """bias = n_E lambda / 2 with n_E the block's E and B letters."""
    letters = F.length(F.regexp_replace(F.concat("stokes1", "stokes2"), "[^EB]", ""))
    return blocks.select("*", letters.alias("n_e"), (F.lit(0.5) * letters * c(lam)).alias("bias"))


def azimuthal_spectrum(alm: DataFrame) -> DataFrame:
    """P(m) = sum_l |a_lm|^2 for both signs of m."""
    p = alm.groupBy("m").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))
    return p.unionByName(p.where("m > 0").select((-F.col("m")).alias("m"), "p"))


def autocorrelation(p: DataFrame) -> DataFrame:
    """A(d) = sum_m P(m) P(m + d)."""
    q = p.select((F.col("m")).alias("m2"), F.col("p").alias("q"))
    return p.crossJoin(F.broadcast(q)).groupBy((F.col("m2") - F.col("m")).alias("d")).agg(F.sum(F.col("p") * F.col("q")).alias("a"))


def band_choice(a: DataFrame, delta: float) -> DataFrame:
    """Smallest k whose band |d| <= k holds a share of at least 1 - delta."""
    by = a.groupBy(F.abs("d").alias("k")).agg(F.sum("a").alias("a"))
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = by.select("k", F.sum("a").over(w).alias("upto"), F.sum("a").over(Window.partitionBy()).alias("total"))
    return run.where(F.col("upto") >= (1 - delta) * F.col("total")).agg(F.min("k").cast("int").alias("band"))


def keep_modes(p: DataFrame, eps: float) -> DataFrame:
    """Modes whose power reaches ``eps`` of the largest."""
    return p.withColumn("top", F.max("p").over(Window.partitionBy())).where(F.col("p") >= eps * F.col("top")).drop("top")


def truncated(alm: DataFrame, lmax: int) -> DataFrame:
    """Coefficients up to a smaller band limit."""
    return alm.where(F.col("l") <= lmax)


def full_orders(alm: DataFrame) -> DataFrame:
    """Coefficients of a real field for both signs of m: a_l-m = (-1)^m conj a_lm."""
    sign = F.when(F.col("m") % 2 == 0, 1.0).otherwise(-1.0)
    below = alm.where("m > 0").withColumn("re", sign * F.col("re")).withColumn("im", -sign * F.col("im")).withColumn("m", -F.col("m"))
    return alm.unionByName(below)


def half_orders(alm: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, l, m >= 0, re, im, re2, im2): a complex field's coefficients as those of its real and imaginary parts."""
    sign = F.when(F.col("m") % 2 == 0, 1.0).otherwise(-1.0)
    mirror = alm.select(*by, "l", (-F.col("m")).alias("m"), (sign * F.col("re")).alias("xr"), (-sign * F.col("im")).alias("xi"))
    both = alm.where("m >= 0").join(mirror, [*by, "l", "m"])
    half = lambda e: (e / 2)
    return both.select(
        *by, "l", "m", half(F.col("re") + F.col("xr")).alias("re"), half(F.col("im") + F.col("xi")).alias("im"),
        half(F.col("im") - F.col("xi")).alias("re2"), half(F.col("xr") - F.col("re")).alias("im2"),
    )


def union_of_selections(selections: DataFrame, by: Sequence[str]) -> DataFrame:
    """Terms that any of several selections (by, keep) keeps."""
    return selections.groupBy(*by).agg(F.bool_or("keep").alias("keep"))


def kept_pairs(power: DataFrame, power_prime: DataFrame, likeness: DataFrame, eps: float, eps_pair: float) -> DataFrame:
    """(m, mp): pairs of orders whose powers (m, p) and whose likeness (d, a) at their distance reach ``eps_pair`` of the largest."""
    one, two = power.toDF("m", "p"), power_prime.toDF("mp", "q")
    kept = lambda df, c: df.withColumn("ok", F.col(c) >= eps * F.max(c).over(Window.partitionBy()))
    both = kept(one, "p").crossJoin(F.broadcast(kept(two, "q").withColumnRenamed("ok", "ok2"))).withColumn("d", F.col("m") - F.col("mp"))
    rated = both.join(F.broadcast(likeness.select("d", "a")), "d").withColumn("e", F.col("p") * F.col("q") * F.col("a"))
    return rated.withColumn("top", F.max("e").over(Window.partitionBy())).where((F.col("e") >= eps_pair * F.col("top")) & F.col("ok") & F.col("ok2")).select("m", "mp")


def apply_transfer(alm: DataFrame, fl: DataFrame) -> DataFrame:
    """a_lm f_l; 0 beyond the transfer's range."""
    f = F.broadcast(fl.select(F.col("ell").alias("l"), F.col("v").alias("_fl")))
    out = alm.join(f, "l", "left").withColumn("_fl", F.coalesce("_fl", F.lit(0.0)))
    return out.withColumn("re", F.col("re") * F.col("_fl")).withColumn("im", F.col("im") * F.col("_fl")).drop("_fl")


def filled(spectra: DataFrame, ells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows for every ell, 0 where the input has none or isn't finite."""
    grid = spectra.select(*keys).distinct().crossJoin(F.broadcast(ells))
    return grid.join(spectra, [*keys, "ell"], "left").withColumn("v", finite_or(F.col("v"), 0.0))


def ring_transform(samples: DataFrame, by: Sequence[str], modes: int) -> DataFrame:
    """Discrete Fourier sums of evenly spaced samples (by, k, n, v): (by, mode, re, im)."""
    m = F.explode(F.sequence(F.lit(0), F.lit(modes - 1)))
    angle = F.lit(-2 * 3.141592653589793) * F.col("mode") * F.col("k") / F.col("n")
    return samples.withColumn("mode", m).groupBy(*by, "mode").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))
