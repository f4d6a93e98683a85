"""Regressions beyond one slope, forecast tests, and risk across assets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import corr, ratio, rounded
from ..operators import folds as O  # noqa: E741, N812
from ..operators import series as S
from ..operators import stats as ST
from ..sources.tables import BARS_SQL, bars
from .registry import query
from .stats import RET_SQL, _returns

D = ("d",)
W = "OVER (PARTITION BY asset ORDER BY d"
LAGS = 5  # of the autocorrelation-robust errors


def two_regressors(df: DataFrame, key: str, order: str, y: str, a: str, b: str, lags: int = LAGS) -> DataFrame:
    """Least squares of y on a and b: coefficients, fit, and the errors of both slopes, robust to unequal variance and to
    autocorrelation (Bartlett weights).

    Regressors are centred, so the slopes' equations are two by two; the second pass sums products of errors and regressors.
    """
    whole = Window.partitionBy(key)
    x = df.dropna(subset=[y, a, b]).withColumns({f"_{c}": F.col(c) - F.avg(c).over(whole) for c in (y, a, b)})
    s = lambda p, q: F.sum(F.col(f"_{p}") * F.col(f"_{q}"))
    m = x.groupBy(key).agg(F.count("*").alias("n"), s(a, a).alias("aa"), s(b, b).alias("bb"), s(a, b).alias("ab"), s(y, a).alias("ya"), s(y, b).alias("yb"), s(y, y).alias("yy"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    m = m.withColumns({"b1": ratio(F.col("ya") * F.col("bb") - F.col("yb") * F.col("ab"), det), "b2": ratio(F.col("yb") * F.col("aa") - F.col("ya") * F.col("ab"), det), "_det": det})
    e = x.join(m.select(key, "b1", "b2"), key).withColumn("_e", F.col(f"_{y}") - F.col("b1") * F.col(f"_{a}") - F.col("b2") * F.col(f"_{b}"))
    e = e.withColumns({"u": F.col("_e") * F.col(f"_{a}"), "v": F.col("_e") * F.col(f"_{b}")})
    w = S.over(key, order)
    lagged = {f"{c}{k}": F.lag(c, k).over(w) for k in range(1, lags + 1) for c in ("u", "v")}
    e = e.withColumns(lagged)
    meat = [F.sum(F.col("_e") ** 2).alias("ee")]
    for name, p, q in (("uu", "u", "u"), ("uv", "u", "v"), ("vv", "v", "v")):
        meat.append(F.sum(F.col(p) * F.col(q)).alias(f"{name}0"))
        far = sum(((1 - k / (lags + 1)) * F.coalesce(F.col(p) * F.col(f"{q}{k}") + F.col(f"{p}{k}") * F.col(q), F.lit(0.0)) for k in range(1, lags + 1)), F.lit(0.0))
        meat.append(F.sum(F.col(p) * F.col(q) + far).alias(f"{name}1"))
    t = m.join(e.groupBy(key).agg(*meat), key)

    def error(first: str, second: str, uu: str, uv: str, vv: str, scale) -> F.Column:
        # The diagonal of inverse(X'X) * meat * inverse(X'X) for the slope of the first regressor.
        p, q = ratio(first, "_det"), ratio(-F.col("ab"), "_det")
        v = (p * p * F.col(uu) + 2 * p * q * F.col(uv) + q * q * F.col(vv)) * scale
        return F.when(v.isNotNull(), F.sqrt(F.greatest(v, F.lit(0.0))))

    hc = ratio("n", F.col("n") - 3)
    return t.select(
        key, "n", "b1", "b2", (1 - ratio("ee", "yy")).alias("r2"),
        error("bb", "aa", "uu0", "uv0", "vv0", hc).alias("se1_hc"), error("aa", "bb", "vv0", "uv0", "uu0", hc).alias("se2_hc"),
        error("bb", "aa", "uu1", "uv1", "vv1", F.lit(1.0)).alias("se1_hac"), error("aa", "bb", "vv1", "uv1", "uu1", F.lit(1.0)).alias("se2_hac"),
    )


def _ols_sql(y: str, a: str, b: str, source: str) -> str:
    far = lambda p, q: " + ".join(f"{1 - k / (LAGS + 1)!r} * coalesce({p} * {q}{k} + {p}{k} * {q}, 0)" for k in range(1, LAGS + 1))
    lagged = ", ".join(f"lag({c}, {k}) {W}) AS {c}{k}" for k in range(1, LAGS + 1) for c in "uv")
    se = lambda p, uu, uv, vv, scale: f"sqrt(greatest(({p} / det * {p} / det * {uu} - 2 * {p} / det * ab / det * {uv} + ab / det * ab / det * {vv}) * {scale}, 0))"
    return f"""x0 AS (SELECT asset, d, {y} AS y, {a} AS a, {b} AS b FROM {source} WHERE {y} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL),
x1 AS (SELECT asset, d, y - avg(y) OVER (PARTITION BY asset) AS y, a - avg(a) OVER (PARTITION BY asset) AS a, b - avg(b) OVER (PARTITION BY asset) AS b FROM x0),
m0 AS (SELECT asset, count(*) AS n, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(y * a) AS ya, sum(y * b) AS yb, sum(y * y) AS yy FROM x1 GROUP BY asset),
m1 AS (SELECT *, aa * bb - ab * ab AS det, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS b1, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS b2 FROM m0),
e0 AS (SELECT x1.asset, d, y - b1 * a - b2 * b AS e, a, b FROM x1 JOIN m1 ON x1.asset = m1.asset), e1 AS (SELECT asset, d, e, e * a AS u, e * b AS v FROM e0), e2 AS (SELECT *, {lagged} FROM e1),
t AS (SELECT m1.*, ee, uu0, uv0, vv0, uu1, uv1, vv1 FROM m1 JOIN (SELECT asset, sum(e * e) AS ee, sum(u * u) AS uu0, sum(u * v) AS uv0, sum(v * v) AS vv0, sum(u * u + {far('u', 'u')}) AS uu1, sum(u * v + {far('u', 'v')}) AS uv1, sum(v * v + {far('v', 'v')}) AS vv1 FROM e2 GROUP BY asset) q ON m1.asset = q.asset),
o AS (SELECT asset, n, b1, b2, 1 - ee / yy AS r2, {se('bb', 'uu0', 'uv0', 'vv0', 'n / (n - 3.0)')} AS se1_hc, {se('aa', 'vv0', 'uv0', 'uu0', 'n / (n - 3.0)')} AS se2_hc, {se('bb', 'uu1', 'uv1', 'vv1', '1')} AS se1_hac, {se('aa', 'vv1', 'uv1', 'uu1', '1')} AS se2_hac FROM t)"""


_OUT = "asset, n, round(b1, 8) AS b1, round(b2, 8) AS b2, round(r2, 8) AS r2, round(se1_hc, 8) AS se1_hc, round(se2_hc, 8) AS se2_hc, round(se1_hac, 8) AS se1_hac, round(se2_hac, 8) AS se2_hac"
_LAGGED = f"l AS (SELECT asset, d, r AS y, v AS y2, lag(r) {W}) AS a, lag(v) {W}) AS b FROM r)"


def _lagged(spark, sf_dir) -> DataFrame:
    w = S.over("asset", "d")
    return _returns(spark, sf_dir).select("asset", "d", F.col("r").alias("y"), F.col("v").alias("y2"), F.lag("r").over(w).alias("a"), F.lag("v").over(w).alias("b"))


@query(f"WITH {RET_SQL}, {_LAGGED}, {_ols_sql('y', 'a', 'b', 'l')} SELECT {_OUT} FROM o")
def ols_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two regressors, with errors robust to unequal variance (HC1) and to autocorrelation (HAC, five lags)."""
    return rounded(two_regressors(_lagged(spark, sf_dir), "asset", "d", "y", "a", "b"), 8)


@query(f"""WITH {RET_SQL}, {_LAGGED}, {_ols_sql('y', 'a', 'b', 'l')}, {_ols_sql('y2', 'a', 'b', 'l').replace('x0', 'p0').replace('x1', 'p1').replace('m0', 'q0').replace('m1', 'q1').replace('e0', 'f0').replace('e1', 'f1').replace('e2', 'f2').replace('t AS', 't2 AS').replace('FROM t)', 'FROM t2)').replace('o AS', 'o2 AS')}
SELECT o.asset, o.n, round(o.b1, 8) AS r_on_r, round(o.b2, 8) AS r_on_v, round(o2.b1, 8) AS v_on_r, round(o2.b2, 8) AS v_on_v, round(o.b1 + o2.b2, 8) AS trace FROM o JOIN o2 ON o.asset = o2.asset""")
def vector_autoregression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector autoregression of order one of returns and volume changes: its matrix, and the sum of its eigenvalues."""
    l = _lagged(spark, sf_dir).dropna()  # noqa: E741
    one, two = (two_regressors(l, "asset", "d", y, "a", "b") for y in ("y", "y2"))
    both = one.select("asset", "n", F.col("b1").alias("r_on_r"), F.col("b2").alias("r_on_v")).join(two.select("asset", F.col("b1").alias("v_on_r"), F.col("b2").alias("v_on_v")), "asset")
    return rounded(both.withColumn("trace", F.col("r_on_r") + F.col("v_on_v")), 8)


@query(f"""WITH {RET_SQL}, f AS (SELECT asset, d, v AS x, round(lead(close, 7) {W}) / close - 1, 10) AS y, round(close / lag(close, 7) {W}) - 1, 10) AS z FROM r), g AS (SELECT * FROM f WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
k AS (SELECT asset, {', '.join(f'rank() OVER (PARTITION BY asset ORDER BY {c}) + (count(*) OVER (PARTITION BY asset, {c}) - 1) / 2 AS r{c}' for c in 'xyz')} FROM g),
c AS (SELECT asset, count(*) AS n, corr(rx, ry) AS xy, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM k GROUP BY asset) SELECT asset, n, round(xy, 9) AS ic, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 9) AS partial_ic FROM c""")
def partial_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of a feature with the return that follows, and what is left of it beside a control."""
    w = S.over("asset", "d")
    f = _returns(spark, sf_dir).select("asset", F.col("v").alias("x"), F.round(F.lead("close", 7).over(w) / F.col("close") - 1, 10).alias("y"), F.round(F.col("close") / F.lag("close", 7).over(w) - 1, 10).alias("z")).dropna()
    k = f.select("asset", *[ST.average_rank(c, "asset").alias(f"r{c}") for c in "xyz"])
    c = k.groupBy("asset").agg(F.count("*").alias("n"), corr("rx", "ry").alias("xy"), corr("rx", "rz").alias("xz"), corr("ry", "rz").alias("yz"))
    part = ratio(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2)))
    return rounded(c.select("asset", "n", F.col("xy").alias("ic"), part.alias("partial_ic")), 9)


@query(f"""WITH {RET_SQL}, q AS (SELECT asset, quantile_cont(r, 0.05) AS q FROM r GROUP BY asset), h AS (SELECT r.asset, d, CAST(r <= q AS INTEGER) AS h FROM r JOIN q ON r.asset = q.asset WHERE r IS NOT NULL), l AS (SELECT asset, h, lag(h) {W}) AS p FROM h),
c AS (SELECT asset, count(*) FILTER (p = 0 AND h = 0) AS n00, count(*) FILTER (p = 0 AND h = 1) AS n01, count(*) FILTER (p = 1 AND h = 0) AS n10, count(*) FILTER (p = 1 AND h = 1) AS n11, avg(h) AS pi FROM l GROUP BY asset),
s AS (SELECT *, n01 / (n00 + n01) AS p01, n11 / (n10 + n11) AS p11 FROM c)
SELECT asset, n00, n01, n10, n11, round(-2 * ((n00 + n01) * ln(1 - pi) + (n10 + n11) * ln(pi) - n00 * ln(1 - p01) - n01 * ln(p01) - n10 * ln(1 - p11) - n11 * ln(p11)), 6) AS lr FROM s WHERE pi > 0 AND p01 > 0 AND p11 > 0 AND pi < 1 AND p01 < 1 AND p11 < 1""")
def hit_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether breaches of the value at risk follow each other: transition counts and the likelihood ratio of independence."""
    r = _returns(spark, sf_dir).where("r IS NOT NULL")
    q = r.groupBy("asset").agg(F.percentile("r", F.lit(0.05)).alias("q"))
    h = r.join(q, "asset").select("asset", "d", (F.col("r") <= F.col("q")).cast("int").alias("h")).withColumn("p", F.lag("h").over(S.over("asset", "d")))
    count = lambda p, x: F.count_if((F.col("p") == p) & (F.col("h") == x)).alias(f"n{p}{x}")
    c = h.groupBy("asset").agg(count(0, 0), count(0, 1), count(1, 0), count(1, 1), F.avg("h").alias("pi"))
    n00, n01, n10, n11, pi = (F.col(k) for k in ("n00", "n01", "n10", "n11", "pi"))
    p01, p11 = ratio(n01, n00 + n01), ratio(n11, n10 + n11)
    lr = -2 * ((n00 + n01) * F.ln(1 - pi) + (n10 + n11) * F.ln(pi) - n00 * F.ln(1 - p01) - n01 * F.ln(p01) - n10 * F.ln(1 - p11) - n11 * F.ln(p11))
    inner = lambda x: (x > 0) & (x < 1)
    return c.where(inner(pi) & inner(p01) & inner(p11)).select("asset", "n00", "n01", "n10", "n11", F.round(lr, 6).alias("lr"))


@query(f"""WITH {RET_SQL}, f AS (SELECT asset, d, r, avg(r) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f0, avg(r) {W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS f1, count(r) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM r WHERE r IS NOT NULL),
g AS (SELECT asset, (r - f0) * (r - f0) AS e0, (r - f1) * (r - f1) AS e1, (r - f0) * (r - f0) - (r - f1) * (r - f1) + (f0 - f1) * (f0 - f1) AS c FROM f WHERE k >= 60)
SELECT asset, count(*) AS n, round(1 - sum(e1) / sum(e0), 8) AS r2_os, round(avg(c) / (stddev_samp(c) / sqrt(count(*))), 6) AS stat FROM g GROUP BY asset""")
def clark_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested forecast against the running mean: out-of-sample fit, and the adjusted test of equal errors."""
    w = S.over("asset", "d")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    f = _returns(spark, sf_dir).where("r IS NOT NULL").select("asset", "r", F.avg("r").over(past).alias("f0"), F.avg("r").over(w.rowsBetween(-20, -1)).alias("f1"), F.count("r").over(past).alias("k")).where("k >= 60")
    e0, e1 = (F.col("r") - F.col("f0")) ** 2, (F.col("r") - F.col("f1")) ** 2
    g = f.select("asset", e0.alias("e0"), e1.alias("e1"), (e0 - e1 + (F.col("f0") - F.col("f1")) ** 2).alias("c"))
    return g.groupBy("asset").agg(F.count("*").alias("n"), F.round(1 - ratio(F.sum("e1"), F.sum("e0")), 8).alias("r2_os"), F.round(ratio(F.avg("c"), F.stddev_samp("c") / F.sqrt(F.count("*"))), 6).alias("stat"))


_PAST60 = "(PARTITION BY asset ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
_PAIR60 = "(PARTITION BY one, two ORDER BY d ROWS 59 PRECEDING)"


@query(f"""WITH {RET_SQL}, z AS (SELECT asset, d, r, CASE WHEN count(r) OVER {_PAST60} >= 60
  THEN (r - avg(r) OVER {_PAST60}) / nullif(stddev_pop(r) OVER {_PAST60}, 0) END AS z FROM r WHERE r IS NOT NULL),
t AS (SELECT d, sum(z * z) AS q, count(z) AS n FROM z GROUP BY d HAVING count(z) > 0),
p AS (SELECT a.asset AS one, b.asset AS two, a.d, a.r AS x, b.r AS y FROM z a JOIN z b ON a.d = b.d AND a.asset < b.asset),
c AS (SELECT d, CASE WHEN count(*) OVER {_PAIR60} >= 60 THEN nullif(corr(x, y) OVER {_PAIR60}, 'nan'::DOUBLE) END AS c FROM p),
m AS (SELECT d, avg(c) AS rho FROM c GROUP BY d)
SELECT t.d, n, round(q / n, 6) AS t_eff, CASE WHEN q / n >= 2 THEN 'Hot' WHEN q / n >= 1 THEN 'Warm' ELSE 'Cold' END AS state,
  round(n / nullif(1 + (n - 1) * rho, 0), 6) AS n_eff FROM t LEFT JOIN m ON t.d = m.d""", text=D)
def effective_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far all assets moved on a day against their own past, and how many independent ones there are by the mean correlation of
    their pairs over sixty common days. Any assets: pairs meet by day, and each pair is a series of its own."""
    w = S.over("asset", "d")
    z = _returns(spark, sf_dir).where("r IS NOT NULL").select("asset", "d", "r", S.trailing_z("r", w, 60, 60).alias("z"))
    t = z.groupBy("d").agg(F.sum(F.col("z") * F.col("z")).alias("q"), F.count("z").alias("n")).where("n > 0")
    one, two = z.select("d", F.col("asset").alias("one"), F.col("r").alias("x")), z.select("d", F.col("asset").alias("two"), F.col("r").alias("y"))
    f = Window.partitionBy("one", "two").orderBy("d").rowsBetween(-59, 0)
    c = one.join(two, "d").where("one < two").select("d", F.when(F.count("*").over(f) >= 60, corr("x", "y", f)).alias("c"))
    m = t.join(c.groupBy("d").agg(F.avg("c").alias("rho")), "d", "left").withColumn("t_eff", F.col("q") / F.col("n"))
    state = F.when(F.col("t_eff") >= 2, "Hot").when(F.col("t_eff") >= 1, "Warm").otherwise("Cold")
    return rounded(m.select("d", "n", "t_eff", state.alias("state"), ratio("n", 1 + (F.col("n") - 1) * F.col("rho")).alias("n_eff")))


_COS = "coalesce((a.r * b.r + a.v * b.v + a.m * b.m) / nullif(sqrt(a.r * a.r + a.v * a.v + a.m * a.m) * sqrt(b.r * b.r + b.v * b.v + b.m * b.m), 0), 0)"


@query(f"""WITH {RET_SQL}, x0 AS (SELECT asset, d, r, stddev_samp(r) {W} ROWS 19 PRECEDING) AS v, close / lag(close, 20) {W}) - 1 AS m FROM r),
x AS (SELECT * FROM x0 WHERE r IS NOT NULL AND v IS NOT NULL AND m IS NOT NULL),
c AS (SELECT a.d, a.asset, any_value(a.v) AS v, avg({_COS}) AS near FROM x a JOIN x b ON a.d = b.d AND a.asset <> b.asset GROUP BY 1, 2),
s AS (SELECT d, asset, greatest(0, (near + 1) / 2) * v / (sum(v) OVER (PARTITION BY d) + 1e-12) AS s FROM c),
n AS (SELECT *, max(s) OVER (PARTITION BY d) AS top FROM s), o AS (SELECT d, asset, CASE WHEN top > 0 THEN s / top ELSE s END AS risk FROM n),
q AS (SELECT *, round(avg(risk) OVER (PARTITION BY d), 6) AS overall FROM o)
SELECT d, asset, round(risk, 6) AS risk, overall, CASE WHEN overall > 0.7 THEN 'CRISIS' WHEN overall > 0.4 THEN 'STRESS' ELSE 'NORMAL' END AS regime FROM q""", text=D)
def systemic_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset's mean cosine with the others of the day times its share of volatility, over the largest of the day.

    Any assets: the mean cosine with the others comes from the sum of the day's unit vectors, so no pairs are made.
    """
    w = S.over("asset", "d")
    move = F.col("close") / F.lag("close", 20).over(w) - 1
    x = _returns(spark, sf_dir).select("asset", "d", "r", F.stddev_samp("r").over(w.rowsBetween(-19, 0)).alias("v"), move.alias("m")).dropna()
    size, day = F.sqrt(F.col("r") ** 2 + F.col("v") ** 2 + F.col("m") ** 2), Window.partitionBy("d")
    x = x.withColumns({f"u{c}": F.coalesce(ratio(c, size), F.lit(0.0)) for c in "rvm"}).withColumn("k", F.count("*").over(day)).where("k > 1")
    dot = sum((F.col(f"u{c}") * (F.sum(f"u{c}").over(day) - F.col(f"u{c}")) for c in "rvm"), F.lit(0.0))
    s = x.withColumn("s", F.greatest(F.lit(0.0), (dot / (F.col("k") - 1) + 1) / 2) * F.col("v") / (F.sum("v").over(day) + 1e-12))
    s = s.withColumn("top", F.max("s").over(day)).withColumn("risk", F.when(F.col("top") > 0, F.col("s") / F.col("top")).otherwise(F.col("s")))
    o = s.withColumn("overall", F.round(F.avg("risk").over(day), 6))
    regime = F.when(F.col("overall") > 0.7, "CRISIS").when(F.col("overall") > 0.4, "STRESS").otherwise("NORMAL")
    return rounded(o.select("d", "asset", "risk", "overall", regime.alias("regime")))


METRICS = ("close", "high", "low", "quote", "volume")
_c5 = ", ".join(f"nullif(abs(corr({x}, {y})), 'nan'::DOUBLE) AS {x}_{y}" for i, x in enumerate(METRICS) for y in METRICS[i + 1 :])
_ab = lambda x, y: "_".join(sorted((x, y)))
_mean5 = lambda m: "(" + " + ".join(_ab(m, o) for o in METRICS if o != m) + f") / {len(METRICS) - 1}"


@query(f"""WITH {BARS_SQL}, c AS (SELECT asset, {_c5} FROM bars GROUP BY asset), u AS (SELECT asset, unnest({list(METRICS)!r}) AS metric, unnest([{', '.join(_mean5(m) for m in METRICS)}]) AS rho FROM c), w AS (SELECT *, 0.2 * greatest(0.05, 1 - rho) AS w FROM u)
SELECT asset, metric, round(rho, 6) AS mean_rho, round(w / sum(w) OVER (PARTITION BY asset), 6) AS weight FROM w""")
def correlation_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights cut by each metric's mean correlation with the others, and renormalised; one pass over the bars."""
    pairs = [(x, y) for i, x in enumerate(METRICS) for y in METRICS[i + 1 :]]
    c = bars(spark, sf_dir).groupBy("asset").agg(*[F.abs(corr(x, y)).alias(_ab(x, y)) for x, y in pairs])
    mean = lambda m: sum((F.col(_ab(m, o)) for o in METRICS if o != m), F.lit(0.0)) / (len(METRICS) - 1)
    u = c.select("asset", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), mean(m).alias("mean_rho")) for m in METRICS])))
    u = u.withColumn("w", 0.2 * F.greatest(F.lit(0.05), 1 - F.col("mean_rho")))
    return rounded(u.select("asset", "metric", "mean_rho", (F.col("w") / F.sum("w").over(Window.partitionBy("asset"))).alias("weight")))


_subs = ("rng", "vol", "chg")
_cw = {"rng": 0.4, "vol": 0.35, "chg": 0.25}
_so_far = lambda c: f"len(list_filter(list({c}) {W}), lambda v: v <= {c})) / row_number() {W}) AS {c}"
_full60 = lambda x, y: f"nullif(corr({x}, {y}) {W} ROWS 59 PRECEDING), 'nan'::DOUBLE)"


@query(f"""WITH {BARS_SQL}, b AS (SELECT asset, d, round((high - low) / close, 10) AS rng, volume AS vol, round(abs(close / lag(close) {W}) - 1), 10) AS chg FROM bars),
x AS (SELECT asset, d, row_number() {W}) AS i, {', '.join(_so_far(c) for c in _subs)} FROM b WHERE chg IS NOT NULL),
c AS (SELECT *, {_full60('rng', 'vol')} AS p, {_full60('rng', 'chg')} AS q, {_full60('vol', 'chg')} AS s, count(*) {W} ROWS 59 PRECEDING) AS n FROM x WHERE i >= 60),
t AS (SELECT asset, d, 0.16 * rng * rng + 0.1225 * vol * vol + 0.0625 * chg * chg
  + 2 * (0.14 * rng * vol * coalesce(p, 0) + 0.1 * rng * chg * coalesce(q, 0) + 0.0875 * vol * chg * coalesce(s, 0)) AS t FROM c WHERE n >= 60)
SELECT asset, d, round(sqrt(greatest(t, 0)), 6) AS ciss FROM t""", text=D)
def stress_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-indices put together like a portfolio: ranks among the values so far, weights, and rolling correlations (0 where one
    side does not vary)."""
    w = S.over("asset", "d")
    rng, chg = (F.col("high") - F.col("low")) / F.col("close"), F.abs(F.col("close") / F.lag("close").over(w) - 1)
    b = bars(spark, sf_dir).select("asset", "d", F.round(rng, 10).alias("rng"), F.col("volume").alias("vol"), F.round(chg, 10).alias("chg")).dropna()

    def ranks(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"asset": f["asset"], "d": f["d"], **{c: O.expanding_share(O.column(f, c), 60) for c in _subs}}).iloc[59:]

    x = O.fold(b, "asset", "d", ranks, "asset string, d date, rng double, vol double, chg double")
    f = w.rowsBetween(-59, 0)
    total = sum((F.col(c) * F.col(c) * _cw[c] ** 2 for c in _subs), F.lit(0.0))
    for i, p in enumerate(_subs):
        for q in _subs[i + 1 :]:
            total = total + 2 * _cw[p] * _cw[q] * F.col(p) * F.col(q) * F.coalesce(corr(p, q, f), F.lit(0.0))
    t = x.select("asset", "d", total.alias("t"), F.count("*").over(f).alias("n")).where("n >= 60")
    return t.select("asset", "d", F.round(F.sqrt(F.greatest("t", F.lit(0.0))), 6).alias("ciss"))


def average_linkage(rho: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers by average linkage on 1 - |correlation|: the two nearest clusters join while they are nearer than cut."""
    groups = [[i] for i in range(len(rho))]
    far = 1 - np.abs(rho)
    while len(groups) > 1:
        best = min(((far[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), key=lambda t: t)
        if best[0] >= cut:
            break
        groups[best[1]] += groups.pop(best[2])
    out = np.empty(len(rho), np.int64)
    for k, g in enumerate(sorted(groups, key=min)):
        out[g] = k
    return out


@query()
def metric_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics grouped by average linkage on their correlations, and how many factors have an eigenvalue over one.

    Correlations are one aggregation in Spark; the tree is built on a matrix of five by five for each series.
    """
    pairs = [(x, y) for i, x in enumerate(METRICS) for y in METRICS[i + 1 :]]
    c = bars(spark, sf_dir).groupBy("asset").agg(*[corr(x, y).alias(_ab(x, y)) for x, y in pairs])

    def tree(f: pd.DataFrame) -> pd.DataFrame:
        r = f.iloc[0]
        # What does not vary is near nothing.
        rho = np.nan_to_num(np.array([[1.0 if x == y else r[_ab(x, y)] for y in METRICS] for x in METRICS], dtype=float))
        return pd.DataFrame({"asset": r["asset"], "metric": METRICS, "cluster": average_linkage(rho, 0.5), "factors": int((np.linalg.eigvalsh(rho) > 1).sum())})

    return c.groupBy("asset").applyInPandas(tree, "asset string, metric string, cluster int, factors int")
