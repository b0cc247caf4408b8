"""Scalar expressions of the data model, all inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

ARCMIN = math.pi / 10800.0


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite_or(value: Column, default: float) -> Column:
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(float(default))).otherwise(value)


def safe_divide(a, b, default: float = 0.0) -> Column:
    """a / b; where that isn't finite, ``default``."""
    return finite_or(F.try_divide(c(a).cast("double"), c(b).cast("double")), default)


def ell_factor(ell) -> Column:
    """l (l + 1) / 2 pi."""
    return c(ell) * (c(ell) + 1) / F.lit(2 * math.pi)


def dl_to_cl(ell, v) -> Column:
    """C from D = l (l + 1) C / 2 pi; 0 for l < 2."""
    return F.when(c(ell) < 2, F.lit(0.0)).otherwise(F.try_divide(F.lit(2 * math.pi) * c(v), c(ell) * (c(ell) + 1)))


def cl_to_dl(ell, v) -> Column:
    return ell_factor(ell) * c(v)


def to_cl(ell, v, units: str) -> Column:
    """Spectrum in C units from 'Cl' or 'Dl'."""
    if units not in ("Cl", "Dl"):
        raise ValueError(f"spectrum units must be Cl or Dl, not {units!r}")
    return dl_to_cl(ell, v) if units == "Dl" else c(v)


def gaussian_beam(ell, fwhm_arcmin) -> Column:
    sigma = c(fwhm_arcmin) * F.lit(ARCMIN / math.sqrt(8 * math.log(2)))
    return F.exp(F.lit(-0.5) * c(ell) * (c(ell) + 1) * sigma * sigma)


def white_noise(sigma_arcmin) -> Column:
    return F.pow(c(sigma_arcmin) * F.lit(ARCMIN), F.lit(2.0))


def transfer_inflation(fl) -> Column:
    """Debiasing inflation for the uncertainty of a transfer function."""
    return F.lit(1.0) + F.sqrt((F.lit(1.0) - c(fl)) / F.lit(3999.0))


def bin_weight(ell, flatten: bool) -> Column:
    return ell_factor(ell) if flatten else F.lit(1.0)


def nka_average(a, b, stokes) -> Column:
    """sqrt|C_l C_l'| for auto spectra, the mean for TE and ET."""
    return F.when(c(stokes).isin("TT", "EE", "BB"), F.sqrt(F.abs(c(a) * c(b)))).otherwise((c(a) + c(b)) / 2)


def apodization(theta, theta_max: float, kind: int, sigma: float | None = None) -> Column:
    """0: Gaussian of FWHM ``sigma``; 1: cosine; None-like 2: none.  Zero from ``theta_max``."""
    t = c(theta)
    if kind == 1:
        x = F.greatest(t / theta_max, t / (sigma or theta_max))
        inside = F.when(x < 1, F.lit(0.5) * (1 + F.cos(F.lit(math.pi) * x))).otherwise(0.0)
    elif kind == 0:
        width = (sigma or theta_max) / math.sqrt(8 * math.log(2))
        inside = F.exp(F.lit(-0.5) * F.pow(t / width, F.lit(2.0)))
    else:
        inside = F.lit(1.0)
    return F.when(t < theta_max, inside).otherwise(0.0)


def highpass(m, sin_theta, lx: float, shape: str = "sharp", power: float = 6.0) -> Column:
    """Ring filter: M > lx sin(theta), or exp(-(mc / M)^p); 0 at M = 0; no filter for lx = 0."""
    if lx == 0:
        return F.lit(1.0)
    cut = F.lit(float(lx)) * c(sin_theta)
    if shape == "sharp":
        on = F.when(c(m) > cut, 1.0).otherwise(0.0)
    else:
        on = F.exp(-F.pow(F.try_divide(cut, c(m).cast("double")), F.lit(float(power))))
    return F.when(c(m) == 0, 0.0).otherwise(on)


def lowpass(m, sin_theta, lx: float, shape: str = "exp", power: float = 6.0) -> Column:
    cut = F.lit(float(lx)) * c(sin_theta)
    if shape == "sharp":
        return F.when(c(m) <= cut, 1.0).otherwise(0.0)
    return F.when(c(m) == 0, 1.0).when(cut <= 0, 0.0).otherwise(F.exp(-F.pow(F.try_divide(c(m).cast("double"), cut), F.lit(float(power)))))


def transfer_correction(rho, f1, f2) -> Column:
    """rho / (F_l1 F_l2); 1 where a transfer isn't positive or finite."""
    ok = (c(f1) > 0) & (c(f2) > 0) & ~F.isnan(c(f1)) & ~F.isnan(c(f2))
    return F.when(ok, finite_or(F.try_divide(c(rho), c(f1) * c(f2)), 1.0)).otherwise(1.0)


def pre_filter_noise(nl, fl, floor: float = 1e-2) -> Column:
    return F.when(c(fl) > floor, F.try_divide(c(nl), c(fl))).otherwise(c(nl))


def polarised_legs(stokes) -> Column:
    """How many of the letters are E or B."""
    return F.length(F.regexp_replace(c(stokes), "[^EB]", ""))


def canonical_key(s1, s2, f1, f2) -> Column:
    """One string for a spectrum whichever way it is written: frequencies ascending, and for equal
    ones the Stokes letters descending."""
    keep = (c(f1) < c(f2)) | ((c(f1) == c(f2)) & (c(s1) >= c(s2)))
    forth = F.concat(c(s1), c(s2), F.lit(","), c(f1), F.lit("x"), c(f2))
    back = F.concat(c(s2), c(s1), F.lit(","), c(f2), F.lit("x"), c(f1))
    return F.when(keep, forth).otherwise(back)


def nside_for(ell, spare: int = 100) -> Column:
    """A resolution that carries multipoles up to ``ell`` and ``spare`` more: a power of two, 128 at least."""
    return F.greatest(F.lit(128), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(c(ell) + spare, F.lit(2))))).cast("int"))
