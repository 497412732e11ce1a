"""Column expressions of scores: ramps, normalisation, two reward compositions and the built-in scorers' formulas.

Null inputs are guarded first, since greatest and least skip nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sequence as S

EPS = 1e-6
#: Default ramps and weights.
CALIBRATION = {"lm": (-5.0, -0.5), "plddt": (50.0, 90.0), "ptm": (0.2, 0.8), "pae": (5.0, 25.0)}
GEOMETRIC_WEIGHTS = {"lm": 1.0, "plddt": 1.0, "ptm": 1.0, "pae": 0.0, "hepn": 0.5, "length": 0.5, "diversity": 0.0}
SUM_WEIGHTS = {"naturalness": 0.20, "cas13_identity": 0.25, "structure": 0.25, "hepn_position": 0.15, "diversity": 0.15}
E_SHORT = 2.718281828  # fixed value: some formulas use this instead of e


def num(x: float) -> Column:
    return F.lit(float(x))


def clamp(x: Column, eps: float = EPS) -> Column:
    return F.when(x.isNotNull(), F.greatest(num(eps), F.least(num(1), x)))


def ramp_up(x: Column, lo: float, hi: float, eps: float = EPS) -> Column:
    if hi <= lo:
        return num(eps)
    return F.coalesce(clamp((x - lo) / num(hi - lo), eps), num(eps))


def ramp_down(x: Column, lo: float, hi: float, eps: float = EPS) -> Column:
    if hi <= lo:
        return num(eps)
    return F.coalesce(clamp((num(hi) - x) / num(hi - lo), eps), num(eps))


def centered_length(n: Column, center: int, tolerance: int, eps: float = EPS) -> Column:
    if tolerance <= 0:
        return F.when(n == center, 1.0).otherwise(eps)
    return clamp(1 - F.abs(n - center) / num(tolerance), eps)


def length_score(n: Column, target: int = 900, tolerance: int = 700) -> Column:
    """Like centered_length, with 0 as the least."""
    if tolerance <= 0:
        return F.when(n == target, 1.0).otherwise(0.0)
    return F.greatest(num(0), 1 - F.abs(n - target) / num(tolerance))


def z_value(x: Column, mean: float | None, std: float | None, clip: tuple[float, float] | None = (-3.0, 3.0), eps: float = 1e-8) -> Column:
    """0 where the value is null or the deviation vanishes."""
    z = num(0) if mean is None or std is None or abs(std) < eps else F.coalesce((x - mean) / num(max(abs(std), eps)), num(0))
    return z if clip is None else F.greatest(num(clip[0]), F.least(num(clip[1]), z))


def mean_of_present(pairs: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """(mean of the terms whose raw value isn't null, 0 if none; whether all are missing). pairs: raw value, term."""
    n = reduce(Column.__add__, [F.when(raw.isNotNull(), 1).otherwise(0) for raw, _ in pairs])
    total = reduce(Column.__add__, [F.when(raw.isNotNull(), t).otherwise(0.0) for raw, t in pairs])
    return F.when(n > 0, total / F.greatest(n, F.lit(1))).otherwise(0.0), n == 0


def structure_z(plddt: Column, ptm: Column, tm: Column, clip=(-3.0, 3.0)) -> tuple[Column, Column]:
    return mean_of_present([(plddt, z_value(plddt, 70.0, 10.0, clip)), (ptm, z_value(ptm, 0.5, 0.15, clip)), (tm, z_value(tm, 0.5, 0.15, clip))])


def weighted_sum(passed: Column, terms: dict[str, Column], penalty: Column, weights: dict[str, float] | None = None, clip: tuple[float, float] | None = (-5.0, 5.0), fail: float = -10.0) -> Column:
    """Weighted sum less penalty, clipped; a fixed value where the filters failed."""
    w = SUM_WEIGHTS | (weights or {})
    total = reduce(Column.__add__, [num(w.get(k, 0.0)) * v for k, v in terms.items()]) - penalty
    if clip is not None:
        total = F.greatest(num(clip[0]), F.least(num(clip[1]), total))
    return F.when(passed, total).otherwise(fail)


def geometric_mean(scores: dict[str, Column], weights: dict[str, float], eps: float = EPS) -> Column:
    """Weighted geometric mean over positive weights; unknown names are ignored, without any the result is 1."""
    active = {k: float(w) for k, w in weights.items() if w > 0 and k in scores}
    if not active:
        return num(1)
    total = sum(active.values())
    return clamp(F.exp(reduce(Column.__add__, [num(w / total) * F.log(clamp(scores[k], eps)) for k, w in active.items()])), eps)


def reward_scores(seq: Column, lm: Column, plddt: Column, ptm: Column, pae: Column, diversity: Column, calibration: dict | None = None, center: int = 900, tolerance: int = 700, eps: float = EPS) -> dict[str, Column]:
    c = CALIBRATION | (calibration or {})
    return {
        "lm": ramp_up(lm, *c["lm"], eps),
        "plddt": ramp_up(plddt, *c["plddt"], eps),
        "ptm": ramp_up(ptm, *c["ptm"], eps),
        "pae": ramp_down(pae, *c["pae"], eps),
        "hepn": clamp(S.motif_score(S.motif_count(seq)), eps),
        "length": centered_length(F.length(seq), center, tolerance, eps),
        "diversity": diversity,
    }


def checked_weights(weights: dict[str, float]) -> dict[str, float]:
    unknown = set(weights) - set(GEOMETRIC_WEIGHTS)
    if unknown:
        raise ValueError(f"unknown weights: {sorted(unknown)}")
    return GEOMETRIC_WEIGHTS | weights


#: The older names of the weights, by the name used now; the first one given counts, else the default.
OLD_WEIGHTS = {"lm": (("w_lm", "w_pg3"), 1.0), "plddt": (("w_plddt", "w_struct"), 1.0), "ptm": (("w_ptm",), 0.0), "hepn": (("w_motif",), 1.0), "length": (("w_len", "w_valid"), 1.0), "diversity": (("w_div",), 0.0), "pae": (("w_pae",), 0.0)}


def from_old_weights(weights: dict[str, float]) -> dict[str, float]:
    return {k: next((weights[n] for n in names if n in weights), d) for k, (names, d) in OLD_WEIGHTS.items()}


def perplexity(nll: Column) -> Column:
    """exp, infinite from 20 on."""
    return F.when(nll < 20, F.exp(nll)).otherwise(num(float("inf")))


def steps(n: Column, epochs: float, batch: int, accumulate: int, world: int) -> Column:
    return F.ceil(n * num(epochs) / num(batch * accumulate * world))


# Built-in scorers. Each gives a struct of plain formulas over the text, without a model.


def _near(n: Column, target: float, width: float) -> Column:
    return F.greatest(num(0), 1 - F.abs(n - target) / num(width))


def mock_structure_basic(s: Column) -> Column:
    bonus = F.when(s.contains("R") & s.contains("H"), 8.0).otherwise(0.0)
    plddt = F.greatest(num(1), F.least(num(95), 62 + bonus - F.least(num(20), F.abs(F.length(s) - 900) / num(50))))
    return F.struct(plddt.alias("mean_plddt"), F.greatest(num(0.05), F.least(num(0.9), plddt / 100 - 0.08)).alias("ptm"), F.greatest(num(2), 30 - plddt / 4).alias("mean_pae"), (s != "").alias("valid"), F.when(s == "", "empty sequence").alias("error"))


def mock_structure_fold(s: Column) -> Column:
    bonus = F.when((S.letter_count(s, "R") >= 2) & (S.letter_count(s, "H") >= 2), 0.08).otherwise(0.0)
    near = _near(F.length(s), 1000, 1000)
    return F.struct(F.least(num(0.9), 0.35 + 0.45 * near + bonus).alias("ptm"), F.least(num(95), 55 + 30 * near + bonus * 50).alias("plddt_mean"), F.lit(None).cast("double").alias("tm_to_reference"))


def mock_structure_probe(s: Column) -> Column:
    valid = (s != "") & S.is_canonical(s)
    near = _near(F.length(s), 950, 950)
    bonus = F.when(s.contains("RAAAAH") & s.contains("RCCCCH"), 8.0).otherwise(0.0)
    return F.struct(F.when(valid, 55 + 25 * near + bonus).alias("mean_plddt"), F.when(valid, F.least(num(0.9), 0.25 + 0.55 * near)).alias("ptm"), F.when(valid, F.greatest(num(4), 24 - 16 * near)).alias("mean_pae"), valid.alias("valid"), F.when(~valid, "mock invalid sequence").alias("error"))


def _share(s: Column, which: str) -> Column:
    return S.letter_count(s, which) / F.greatest(F.length(s), F.lit(1))


def mock_likelihood_basic(s: Column) -> Column:
    lp = -1.8 - _share(s, "WCM")
    return F.struct(lp.alias("mean_logprob"), F.exp(-lp).alias("perplexity"), (s != "").alias("valid"), F.when(s == "", "empty sequence").alias("error"))


def mock_likelihood_natural(s: Column) -> Column:
    ll = -2.0 - _share(s, "WCM") - F.abs(F.length(s) - 1000) / num(5000)
    return F.struct(ll.alias("mean_log_likelihood"), (-ll).alias("nll"), F.pow(num(E_SHORT), -ll).alias("ppl"), F.length(s).alias("num_tokens"))


def mock_likelihood_probe(s: Column) -> Column:
    valid = (s != "") & S.is_canonical(s)
    lp = -1.4 - _share(s, "WCM")
    return F.struct(F.when(valid, lp).alias("mean_logprob"), F.when(valid, F.pow(num(E_SHORT), -lp)).alias("perplexity"), valid.alias("valid"), F.when(~valid, "mock invalid sequence").alias("error"))


def mock_likelihood_aromatic(s: Column) -> Column:
    return -2.0 + _share(s, "FWY") - F.abs(F.length(s) - 1000) / num(5000)


def mock_combined(s: Column, lo: int = 200, hi: int = 1500) -> Column:
    valid, motif = S.validity_score(s, lo, hi), S.motif_score(S.motif_count(s))
    return F.struct((F.greatest(num(1), F.length(s) / num(100)) - motif).alias("progen3_nll"), (50 + 30 * valid + 10 * motif).alias("mean_plddt"), valid.alias("validity_score"), motif.alias("cas13_motif_score"))


def mock_identity(s: Column, length_range: tuple[int, int] = (800, 1400)) -> Column:
    n = F.when(S.is_canonical(s), S.motif_count(s)).otherwise(0)
    return F.when((n == 2) & F.length(s).between(*length_range), 0.9).when(n == 1, 0.45).when(n == 2, 0.65).otherwise(0.1)
