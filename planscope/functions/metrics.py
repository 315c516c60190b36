"""Error measures as Columns: q-errors, benefits, distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def q_error(true: Column, est: Column, smooth: int = 0) -> Column:
    """max(t/e, e/t); null when a side is 0 without smoothing."""
    t, e = true.cast("double") + smooth, est.cast("double") + smooth
    return F.greatest(F.try_divide(t, e), F.try_divide(e, t))


def over_error(true: Column, est: Column) -> Column:
    return est / (true.cast("double") + 1)


def under_error(true: Column, est: Column) -> Column:
    return true / (est.cast("double") + 1)


def p_error(cost_of_estimated: Column, cost_of_true: Column) -> Column:
    return F.try_divide(cost_of_estimated.cast("double"), cost_of_true.cast("double"))


def objective(ratio: Column, true: Column) -> Column:
    """ln(ratio), damped for small cardinalities."""
    return F.log(ratio) / (1 + F.lit(100.0) / (true.cast("double") + 1))


def clipped_benefit(est: Column, true: Column, clip: float) -> Column:
    """(e - t) / (t * (clip - 1)), 1 beyond the clip."""
    e, t = est.cast("double"), true.cast("double")
    return F.when(e >= t * clip, F.lit(1.0)).otherwise(F.try_divide(e - t, t * (clip - 1)))


def error_to_benefit(error: Column, low: float = 1.0, high: float = 5.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (error.cast("double") - low) / (high - low)))


def mixed_benefit(cost_benefit: Column, card_benefit: Column, alpha: float) -> Column:
    return cost_benefit * alpha + card_benefit * (1 - alpha)


def error_mode(true: Column, est: Column, under: float = 1.25, over: float = 0.8) -> Column:
    r = F.try_divide(true.cast("double"), est.cast("double"))
    return F.when(r >= under, "under").when(r <= over, "over").otherwise("exact")


def case_status(valid: Column, error: Column, tolerance: float = 1e-7) -> Column:
    return F.when(~valid, "invalid_extension").when(error < 1 + tolerance, "valid").otherwise("effective")


def label(true: Column, est: Column) -> Column:
    """ln(true / est); both get 1 more where either is below 1e-5."""
    tiny = (true < 1e-5) | (est < 1e-5)
    plus = F.when(tiny, 1.0).otherwise(0.0)
    return F.log((true + plus) / (est + plus))


def restored(est: Column, lab: Column) -> Column:
    return est * F.exp(lab)


def normalised(value: Column, lo: float, hi: float) -> Column:
    return (value.cast("double") - lo) / (hi - lo)


def meta_distance(pairs: list[tuple[Column, Column]], kind: str = "l1") -> Column:
    parts = [F.abs(a.cast("double") - b.cast("double")) for a, b in pairs]
    if kind == "l1":
        return reduce(lambda x, y: x + y, parts)
    if kind == "l2":
        return F.sqrt(reduce(lambda x, y: x + y, [p * p for p in parts]))
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


# aggregates
def geometric_mean(c: Column) -> Column:
    return F.exp(F.avg(F.log(c)))


def harmonic_mean(c: Column) -> Column:
    return F.count(c) / F.sum(1 / c)


METRICS = {
    "max_p_error": lambda c: F.coalesce(F.max(c), F.lit(0.0)),
    "p90_p_error": lambda c: F.percentile(c, F.lit(0.9)),
    "p75_p_error": lambda c: F.percentile(c, F.lit(0.75)),
    "median_p_error": lambda c: F.percentile(c, F.lit(0.5)),
    "mean_p_error": F.avg,
}
