"""Least squares with any number of regressors from one aggregation: centred moments of all pairs of columns (partial sums on the
map side), then a Cholesky factor of the correlation matrix as column expressions over one row for each key.

A regressor that the others (or a constant) explain up to rounding makes a pivot vanish: all results of that key are then null,
and other keys keep theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..functions.tails import t_two_sided

#: Least share of a regressor's variance that the regressors before it must leave unexplained.
LEAST_PIVOT = 1e-9


def moments(df: DataFrame, keys: Sequence[str], names: Sequence[str], also: Sequence[Column] = ()) -> DataFrame:
    """n, mean_i, sd_i and c_i_j (correlation, 1 on the diagonal) of the columns, over the rows where all of them are there."""
    whole = df.dropna(subset=list(names))
    pairs = [(i, j) for i in range(len(names)) for j in range(i)]
    cov = [F.covar_pop(F.col(names[i]).cast("double"), F.col(names[j]).cast("double")).alias(f"v_{i}_{j}") for i, j in pairs]
    each = [f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(names) for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    m = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *each, *cov, *also)
    scaled = {f"c_{i}_{j}": ratio(f"v_{i}_{j}", F.col(f"sd_{i}") * F.col(f"sd_{j}")) for i, j in pairs}
    return m.withColumns(scaled).drop(*[f"v_{i}_{j}" for i, j in pairs])


def _c(i: int, j: int) -> Column:
    return F.lit(1.0) if i == j else F.col(f"c_{max(i, j)}_{min(i, j)}")


def _sum(parts: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def factor(m: DataFrame, order: Sequence[int], ys: Sequence[int], tag: str = "") -> DataFrame:
    """Cholesky factor of the regressors' correlations, taken in the order given (indices of moments()), and z: what each adds.

    Adds l{tag}_i_j (places in order) and z{tag}_y_i; the share of y's variance explained by the first p regressors is the sum
    of the first p squares of z. Null from the first vanishing pivot on.
    """
    t = tag
    for j in range(len(order)):
        left = _c(order[j], order[j]) - _sum([F.col(f"l{t}_{j}_{q}") ** 2 for q in range(j)])
        varies = F.col(f"sd_{order[j]}") > 1e-13 * F.abs(F.col(f"mean_{order[j]}"))
        m = m.withColumn(f"l{t}_{j}_{j}", F.when((left > LEAST_PIVOT) & varies, F.sqrt(left)))
        under = {
            f"l{t}_{i}_{j}": (_c(order[i], order[j]) - _sum([F.col(f"l{t}_{i}_{q}") * F.col(f"l{t}_{j}_{q}") for q in range(j)])) / F.col(f"l{t}_{j}_{j}")
            for i in range(j + 1, len(order))
        }
        z = {
            f"z{t}_{y}_{j}": (_c(order[j], y) - _sum([F.col(f"l{t}_{j}_{q}") * F.col(f"z{t}_{y}_{q}") for q in range(j)])) / F.col(f"l{t}_{j}_{j}")
            for y in ys
        }
        m = m.withColumns(under | z)
    return m


def explained(y: int, p: int, tag: str = "") -> Column:
    """The share of y's variance that the first p regressors explain."""
    return _sum([F.col(f"z{tag}_{y}_{q}") ** 2 for q in range(p)])


def least_squares(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """y on xs and a constant: one row for each key and term (the constant first) with n, r2, coef, se, t and p (two-sided)."""
    return solve(moments(df, keys, [*xs, y]), keys, xs, len(xs))


def solve(m: DataFrame, keys: Sequence[str], xs: Sequence[str], y: int, tails: bool = True) -> DataFrame:
    """least_squares() of column y of moments() on its first columns, which xs names: models of any size from one aggregation.
    Without tails there is no p, for callers that put models together first."""
    k = len(xs)
    m = factor(m, range(k), [y])
    # The rows of the inverse factor, and the standardised coefficients by substitution from the last.
    for i in range(k):
        w = {f"w_{i}_{i}": 1 / F.col(f"l_{i}_{i}")}
        m = m.withColumns(w)
        m = m.withColumns({f"w_{i}_{j}": -_sum([F.col(f"l_{i}_{q}") * F.col(f"w_{q}_{j}") for q in range(j, i)]) / F.col(f"l_{i}_{i}") for j in range(i)})
    for i in reversed(range(k)):
        m = m.withColumn(f"b_{i}", (F.col(f"z_{y}_{i}") - _sum([F.col(f"l_{q}_{i}") * F.col(f"b_{q}") for q in range(i + 1, k)])) / F.col(f"l_{i}_{i}"))
    n, free, sd = F.col("n").cast("double"), F.col("n") - (k + 1), F.col(f"sd_{y}")
    share = explained(y, k)
    m = m.withColumn("r2", F.when(share < 1, share).when(share >= 1, 1.0)).withColumn("_s2", F.when(free > 0, n * sd * sd * (1 - F.col("r2")) / free))
    slope = [F.col(f"b_{i}") * sd / F.col(f"sd_{i}") for i in range(k)]
    spread = [F.col("_s2") / n * _sum([F.col(f"w_{q}_{i}") ** 2 for q in range(i, k)]) / F.col(f"sd_{i}") ** 2 for i in range(k)]
    m = m.withColumns({f"_b{i}": slope[i] for i in range(k)} | {f"_v{i}": spread[i] for i in range(k)})
    base = F.col(f"mean_{y}") - _sum([F.col(f"_b{i}") * F.col(f"mean_{i}") for i in range(k)])
    # The constant's variance: s2 / n plus the means' quadratic form in the inverse, whose rows are the columns of w.
    lean = _sum([_sum([F.col(f"w_{q}_{i}") * F.col(f"mean_{i}") / F.col(f"sd_{i}") for i in range(q + 1)]) ** 2 for q in range(k)])
    terms = [F.struct(F.lit("const").alias("term"), base.alias("coef"), F.sqrt(F.col("_s2") / n * (1 + lean)).alias("se"))]
    terms += [F.struct(F.lit(x).alias("term"), F.col(f"_b{i}").alias("coef"), F.sqrt(F.col(f"_v{i}")).alias("se")) for i, x in enumerate(xs)]
    out = m.select(*keys, "n", "r2", F.inline(F.array(*terms))).withColumn("t", ratio("coef", "se"))
    return out.withColumn("p", t_two_sided("t", F.col("n") - (k + 1))) if tails else out
