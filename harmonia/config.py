"""Run parameters: validation with readable reports, and a frozen configuration."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

#: Names and types a parameter file must have, spellings accepted for others.
REQUIRED = {"cov_path": str, "cov_name": str, "frequencies": list, "lmax": int, "lmin": int, "bins": list, "mask_name": str, "mask_path": str, "covariance_approximation": str}
OBSERVABLES = ("TT", "EE", "BB", "TE", "TB", "EB")
ALIASES = {"ET": "TE", "BT": "TB", "BE": "EB"}
SPELLINGS = {"noise": "nl"}
UNITS = ("Cl", "Dl")
METHODS = ("acc", "nka", "inka")
REMOVED = {"nl_is_biased": "Noise is never multiplied by the data model; give it as it enters the map."}
UNSUPPORTED = ("compute_noise_only", "compute_signal_only")


def observables_of(params: dict[str, Any]) -> list[str]:
    """The spectra asked for; exactly one of 'stokes' and 'observables' must be set."""
    stokes, obs = params.get("stokes"), params.get("observables")
    if (stokes is None) == (obs is None):
        raise ValueError("set exactly one of 'stokes' and 'observables'")
    if obs is not None:
        if not isinstance(obs, list) or not obs:
            raise ValueError(f"'observables' must be a non-empty list, not {obs!r}")
        found = [ALIASES.get(o, o) for o in obs]
        if bad := sorted({str(o) for o in found} - set(OBSERVABLES)):
            raise ValueError(f"'observables' has unknown spectra {bad}")
        return list(dict.fromkeys(found))
    if not isinstance(stokes, list) or not all(s in ("T", "E", "B") for s in stokes):
        raise ValueError(f"'stokes' must list the letters T and E, not {stokes!r}")
    if "B" in stokes:
        raise ValueError("'stokes' stands for T and E only; ask for B by 'observables'")
    return [o for o in ("TT", "EE", "TE") if set(o) <= set(stokes)]


def bin_edges(bins: list[list[int]]) -> list[int]:
    """Half-open edges of [start, stop, step] pieces: every piece's range, then the last stop."""
    edges = [e for start, stop, step in bins for e in range(start, stop, step)]
    return [*dict.fromkeys(edges), bins[-1][1]]


class Report:
    """What is wrong with a parameter set."""

    def __init__(self, params: dict[str, Any]):
        self.errors: list[str] = []
        self.warnings: list[str] = []
        self._basics(params)
        self._physics(params)
        self._blocks(params)

    @property
    def ok(self) -> bool:
        return not self.errors

    def text(self) -> str:
        lines = [f"error: {e}" for e in self.errors] + [f"warning: {w}" for w in self.warnings]
        return "\n".join(lines) or "the parameters are valid"

    def _basics(self, p):
        for name, why in REMOVED.items():
            if name in p:
                self.errors.append(f"'{name}' has been removed. {why}")
        for name, kind in REQUIRED.items():
            if name not in p:
                self.errors.append(f"required parameter '{name}' is missing")
            elif not isinstance(p[name], kind) or isinstance(p[name], bool):
                self.errors.append(f"'{name}' should be {kind.__name__}, not {type(p[name]).__name__}")
        for alias, name in SPELLINGS.items():
            if alias in p and name in p and p[alias] != p[name]:
                self.errors.append(f"'{alias}' and '{name}' are the same parameter and differ")
        for name in UNSUPPORTED:
            if p.get(name):
                self.errors.append(f"'{name}' is not supported")
        for name in ("save_raw_blocks", "polspice_postprocess", "parity_mixed_blocks", "Dl", "sum_assymetric_stokes", "add_tf_uncertainty"):
            if name in p and not isinstance(p[name], bool):
                self.errors.append(f"'{name}' must be true or false, not {p[name]!r}")
        lmax, lmin, bins = p.get("lmax"), p.get("lmin"), p.get("bins")
        if isinstance(lmax, int) and lmax <= 0:
            self.errors.append("lmax must be positive")
        if isinstance(lmin, int) and (lmin < 0 or isinstance(lmax, int) and lmin >= lmax):
            self.errors.append("lmin must be non-negative and below lmax")
        if isinstance(bins, list):
            if not bins or not all(isinstance(b, list) and len(b) == 3 and all(isinstance(x, int) for x in b) and b[2] > 0 for b in bins):
                self.errors.append("each bin piece should be [start, stop, step]")
            elif isinstance(lmax, int) and max(b[1] for b in bins) > lmax:
                self.errors.append("bins reach beyond lmax")
        freqs = p.get("frequencies")
        if isinstance(freqs, list):
            if not all(isinstance(f, str) for f in freqs):
                self.errors.append("frequencies must be strings")
            elif len({len(f) for f in freqs}) > 1:
                self.errors.append("frequency labels must have equal length")
            else:
                self.warnings += [f"frequency '{f}' doesn't end with GHz" for f in freqs if not f.endswith("GHz")]

    def _physics(self, p):
        method = str(p.get("covariance_approximation", "")).lower()
        if "covariance_approximation" in p and method not in METHODS:
            self.errors.append(f"unknown covariance_approximation {p['covariance_approximation']!r}; one of {list(METHODS)}")
        try:
            obs = observables_of(p)
        except ValueError as e:
            self.errors.append(str(e))
            return
        with_b = [o for o in obs if "B" in o]
        if with_b and method in ("nka", "inka") and obs != ["BB"]:
            self.errors.append(f"{method} takes a B spectrum only as observables: [BB]; use acc for {with_b}")
        if p.get("parity_mixed_blocks") and not ({"TB", "EB"} & set(obs) and set(obs) - {"TB", "EB"}):
            self.errors.append("parity_mixed_blocks needs both parity-even and parity-odd observables")
        for name in ("spectrum_units", "cmb_spectrum_units", "foregrounds_units", "nl_units"):
            if name in p and str(p[name]).capitalize() not in UNITS:
                self.errors.append(f"'{name}' must be one of {list(UNITS)}")
        if str(p.get("cmb_spectrum_units", p.get("spectrum_units", "Cl"))).capitalize() == "Dl" and isinstance(p.get("cmb_spectrum"), (int, float)):
            self.errors.append("a constant spectrum can't be in Dl units")

    def _blocks(self, p):
        method, dmax, bins = str(p.get("covariance_approximation", "")).lower(), p.get("dmax"), p.get("bins")
        if method == "acc":
            if not isinstance(dmax, int) or dmax < 1:
                self.errors.append("acc needs an integer dmax of 1 or more")
            if not isinstance(p.get("centralell"), int) or p["centralell"] < 0:
                self.errors.append("acc needs an integer centralell of 0 or more")
            elif p["centralell"] <= 150:
                self.warnings.append("centralell is low; kernels there differ from those at high multipoles")
            if isinstance(dmax, int) and isinstance(bins, list) and bins and all(isinstance(b, list) and len(b) == 3 for b in bins):
                width = max(b[2] for b in bins)
                if dmax < width:
                    self.warnings.append(f"dmax {dmax} is below the widest bin {width}: variances are underestimated")
                elif dmax < 2 * width:
                    self.warnings.append(f"dmax {dmax} is below twice the widest bin {width}: neighbouring correlations are underestimated")
        f = p.get("map_filter")
        if f is not None:
            if not isinstance(f, dict) or f.get("type") != "fourier_highpass":
                self.errors.append("map_filter needs type fourier_highpass")
                return
            if not isinstance(f.get("lx"), (int, float)) or f["lx"] <= 0:
                self.errors.append("map_filter.lx must be positive")
            if f.get("shape", "sharp") not in ("sharp", "exp"):
                self.errors.append("map_filter.shape is sharp or exp")
            if f.get("node_ratio", 1.25) <= 1:
                self.errors.append("map_filter.node_ratio must exceed 1")
            low = f.get("lowpass")
            if low is not None and (not isinstance(low, dict) or not isinstance(low.get("lx"), (int, float)) or low["lx"] <= f.get("lx", 0)):
                self.errors.append("map_filter.lowpass.lx must exceed map_filter.lx")


@dataclass(frozen=True)
class Config:
    """A validated run."""

    frequencies: tuple[str, ...]
    observables: tuple[str, ...]
    lmax: int
    lmin: int
    edges: tuple[int, ...]
    method: str
    parity_mixed: bool = False
    use_dl: bool = False
    fold: bool = False
    polspice: bool = True
    theta_max: float = 30.0
    apodize_sigma: float = 30.0
    apodize_type: int = 1
    dmax: int | None = None
    central_ell: int | None = None
    tf_uncertainty: bool = False
    raw: dict = field(default_factory=dict, compare=False, hash=False)

    @classmethod
    def of(cls, params: dict[str, Any]) -> Config:
        p = {SPELLINGS.get(k, k): v for k, v in params.items()}
        report = Report(params)
        if not report.ok:
            raise ValueError(report.text())
        return cls(
            frequencies=tuple(p["frequencies"]), observables=tuple(observables_of(p)), lmax=p["lmax"], lmin=p["lmin"], edges=tuple(bin_edges(p["bins"])),
            method=p["covariance_approximation"].lower(), parity_mixed=p.get("parity_mixed_blocks", False), use_dl=p.get("Dl", False), fold=p.get("sum_assymetric_stokes", False),
            polspice=p.get("polspice_postprocess", True), theta_max=float(p.get("thetamax", 30.0)), apodize_sigma=float(p.get("apodizesigma", 30.0)), apodize_type=int(p.get("apodizetype", 1)),
            dmax=p.get("dmax"), central_ell=p.get("centralell"), tf_uncertainty=p.get("add_tf_uncertainty", False), raw=p,
        )

    def units(self, what: str) -> str:
        return str(self.raw.get(f"{what}_units", self.raw.get("spectrum_units", "Cl"))).capitalize()

    @property
    def stokes_pairs(self) -> list[tuple[str, str]]:
        return list(dict.fromkeys(p for o in self.observables for p in ((o[0], o[1]), (o[1], o[0]))))


def may_rebin(old: dict[str, Any], new: dict[str, Any]) -> list[str]:
    """Parameters that differ and forbid reusing results for another binning."""
    return sorted(k for k in {*old, *new} - {"lmin", "lmax", "bins"} if old.get(k) != new.get(k))
