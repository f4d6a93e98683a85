"""Tails of the chi-squared, F and t laws as column expressions: incomplete gamma and beta by continued fractions (modified
Lentz) and series. Each fraction is a fold over a short sequence, so the expressions stay small and run in the JVM.

Null or non-finite arguments, negative statistics where none are possible and degrees of freedom under one give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import col

_TINY = 1e-300


def ln_gamma(x) -> Column:
    """The logarithm of the gamma function for x > 0: Stirling's series after eight steps up."""
    x = col(x).cast("double")
    up = F.ln(x)
    for k in range(1, 8):
        up = up + F.ln(x + k)
    y = x + 8
    # The first terms of Stirling's series.
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - up


def _steps(size: Column, times: int = 1) -> Column:
    """Numbers 1, 2, … as far as a fraction with parameters of this size needs them (times as many)."""
    return F.sequence(F.lit(1), (times * F.ceil(60 + 6 * F.sqrt(size))).cast("int"))


def _safe(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _let(f: Callable[[Column], Column], **values: Column) -> Column:
    """f of a struct of values that are worked out, and written into the expression, once."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f)[0]


def _fraction(steps: Column, c0: Column, first: Column, term: Callable[[Column], tuple[Column, Column]]) -> Column:
    """A continued fraction as its product of ratios, from the first of them; term gives a and b of each step."""
    state = F.struct(c0.alias("c"), first.alias("d"), first.alias("h"))

    def step(s: Column, i: Column) -> Column:
        a, b = term(i)
        return _let(
            lambda t: F.struct(t["c"].alias("c"), t["d"].alias("d"), (s["h"] * t["d"] * t["c"]).alias("h")),
            c=_let(lambda t: _safe(t["b"] + t["a"] / s["c"]), a=a, b=b),
            d=_let(lambda t: 1 / _safe(t["b"] + t["a"] * s["d"]), a=a, b=b),
        )

    return F.aggregate(steps, state, step)["h"]


def gamma_upper(a, x) -> Column:
    """The regularised upper incomplete gamma function Q(a, x)."""

    def value(s: Column) -> Column:
        a, x = s["a"], s["x"]
        scale, steps = F.exp(-x + a * F.ln(x) - ln_gamma(a)), _steps(F.greatest(a, x))
        start = F.struct((1 / a).alias("t"), (1 / a).alias("s"))

        def add(s: Column, m: Column) -> Column:
            t = s["t"] * x / (a + m)
            return F.struct(t.alias("t"), (s["s"] + t).alias("s"))

        low = 1 - scale * F.aggregate(steps, start, add)["s"]
        high = scale * _fraction(steps, F.lit(1 / _TINY), 1 / _safe(x + 1 - a), lambda m: (-m * (m - a), x + 1 - a + 2 * m))
        return F.when(x <= 0, F.when(x == 0, 1.0)).when(x < a + 1, low).otherwise(high)

    return _let(value, a=col(a).cast("double"), x=col(x).cast("double"))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """I_x(a, b) where x is under (a + 1) / (a + b + 2)."""

    def term(i: Column) -> tuple[Column, Column]:
        m = F.floor((i + 1) / 2).cast("double")
        odd, even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(i % 2 == 1, odd).otherwise(even), F.lit(1.0)

    scale = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    return scale * _fraction(_steps(F.greatest(a, b), 2), F.lit(1.0), 1 / _safe(1 - (a + b) * x / (a + 1)), term) / a


def beta_lower(a, b, x) -> Column:
    """The regularised incomplete beta function I_x(a, b)."""

    def value(s: Column) -> Column:
        far = s["y"] >= (s["a"] + 1) / (s["a"] + s["b"] + 2)
        swap = lambda p, q: F.when(far, p).otherwise(q)
        own = _let(lambda t: _beta_fraction(t["a"], t["b"], t["y"]), a=swap(s["b"], s["a"]), b=swap(s["a"], s["b"]), y=swap(1 - s["y"], s["y"]))
        found = _let(lambda t: F.when(t["far"], 1 - t["own"]).otherwise(t["own"]), far=far, own=own)
        return F.when((s["x"] > 0) & (s["x"] < 1), found).when(s["x"] == 0, 0.0).when(s["x"] == 1, 1.0)

    x = col(x).cast("double")
    return _let(value, a=col(a).cast("double"), b=col(b).cast("double"), x=x, y=F.when((x > 0) & (x < 1), x).otherwise(F.lit(0.5)))


def _given(*xs: Column) -> Column:
    ok = F.lit(True)
    for x in xs:
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return ok


def chi2_tail(x, df) -> Column:
    """P(X > x) of the chi-squared law with df degrees of freedom."""
    x, df = col(x).cast("double"), col(df).cast("double")
    return F.when(_given(x, df) & (x >= 0) & (df >= 1), gamma_upper(df / 2, x / 2))


def f_tail(x, df1, df2) -> Column:
    """P(X > x) of the F law with df1 and df2 degrees of freedom."""
    x, df1, df2 = (col(c).cast("double") for c in (x, df1, df2))
    ok = _given(x, df1, df2) & (x >= 0) & (df1 >= 1) & (df2 >= 1)
    return F.when(ok, beta_lower(df2 / 2, df1 / 2, df2 / (df2 + df1 * x)))


def t_two_sided(t, df) -> Column:
    """P(|T| > |t|) of Student's law with df degrees of freedom."""
    t, df = col(t).cast("double"), col(df).cast("double")
    return F.when(_given(t, df) & (df >= 1), beta_lower(df / 2, F.lit(0.5), df / (df + t * t)))
