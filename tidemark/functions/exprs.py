"""Scalar building blocks as column expressions: squash, clamp, ladders, interpolation, weighted means, decay, normal law."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def squash(x, centre: float, slope: float) -> Column:
    """A logistic curve from -3 to 3 around centre."""
    return 6.0 / (1.0 + F.exp(-slope * (col(x) - centre))) - 3.0


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def clamp(x, low: float, high: float) -> Column:
    """Null stays null (least and greatest alone would drop it)."""
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), F.lit(low)), F.lit(high)))


def ladder(x, steps: Sequence[tuple[float, object]], other, above: bool = True) -> Column:
    """The value of the first step that x lies strictly above (or below); other if none."""
    out = None
    for bound, value in steps:
        hit = col(x) > bound if above else col(x) < bound
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(other)) if out is not None else F.lit(other)


def bucket(x, edges: Sequence[tuple[float, float, str]]) -> Column:
    """The label of the half-open interval that holds x; null outside."""
    out = None
    for low, high, label in edges:
        hit = (col(x) >= low) & (col(x) < high)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def z_fixed(x, mean: float, std: float, limit: float = 3.0) -> Column:
    """z against fixed moments, clipped; 0 where x is missing."""
    return F.coalesce(clamp((col(x) - mean) / std, -limit, limit), F.lit(0.0))


def interpolate(x, anchors: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through ascending anchors, flat outside."""
    out = F.when(col(x) <= anchors[0][0], F.lit(anchors[0][1]))
    for (x0, y0), (x1, y1) in zip(anchors, anchors[1:], strict=False):
        out = out.when(col(x) <= x1, F.lit(y0) + (col(x) - x0) * ((y1 - y0) / (x1 - x0)))
    return out.when(col(x) > anchors[-1][0], F.lit(anchors[-1][1]))


def weighted_mean(parts: Sequence[tuple[object, float]], least_cover: float = 0.0) -> Column:
    """Mean of the parts that are there, weights renormalised; null if less than least_cover of the weight is."""
    held = sum((F.when(col(c).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts), F.lit(0.0))
    total = sum((F.coalesce(col(c) * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    whole = sum(w for _, w in parts)
    return F.when(held / whole >= least_cover, F.try_divide(total, held))


def decay(age, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -col(age) / half_life)


def geometric_mean(parts: Sequence[object], floor: float = 1e-9) -> Column:
    logs = [F.ln(F.greatest(col(c), F.lit(floor))) for c in parts]
    return F.exp(sum(logs[1:], logs[0]) / len(logs))


def normal_cdf(x) -> Column:
    """The normal law's distribution function by a rational approximation (absolute error below 1e-7)."""
    # Coefficients of the classical polynomial approximation of the error integral.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1.0 / (1.0 + 0.2316419 * F.abs(col(x)))
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    tail = F.exp(-col(x) * col(x) / 2.0) / math.sqrt(2 * math.pi) * poly
    return F.when(col(x) >= 0, 1.0 - tail).otherwise(tail)


def ratio(a, b) -> Column:
    """a / b, null where b is 0 or missing."""
    return F.try_divide(col(a), col(b))


def corr(x, y, frame=None) -> Column:
    """Pearson's correlation of the pairs that are complete, over rows or a window; null (not an error, not NaN) where either
    side does not vary."""
    a, b = F.when(col(y).isNotNull(), col(x)).cast("double"), F.when(col(x).isNotNull(), col(y)).cast("double")
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    both, sa, sb = (p.over(frame) for p in parts) if frame is not None else parts
    # Of a constant, rounding can leave a deviation of some parts in 10**16 of its size.
    size = lambda v: F.max(F.abs(v)) if frame is None else F.max(F.abs(v)).over(frame)
    varies = (sa > 1e-13 * size(a)) & (sb > 1e-13 * size(b))
    return F.when(varies, F.try_divide(both, sa * sb))


def finite(x) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(col(x)) | (F.abs(col(x)) == float("inf")), F.lit(None)).otherwise(col(x))


def rounded(df, digits: int = 6, **own: int | None):
    """All double columns rounded (None: not), so that summation order does not show."""
    return df.select([F.round(F.col(c), n).alias(c) if t == "double" and (n := own.get(c, digits)) is not None else F.col(c) for c, t in df.dtypes])
