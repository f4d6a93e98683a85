"""Regressions with many regressors, autoregressions with their lags chosen, causality with p values, and tails of tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import ratio, rounded
from ..functions.tails import chi2_tail, f_tail, t_two_sided
from ..operators import regression as R
from ..operators import series as S
from .linear import clark_west
from .registry import ORACLES, query
from .stats import RET_SQL, W, _returns, granger_f, kupiec_hits

MAX_LAG = 4
CAUSES = 3  # lags tried for causality
FEATURES = ("r1", "v1", "r2", "v2", "m5", "s10")


def sweep_sql(source: str, name: str, keys: str, columns: list[str], pivots: int) -> str:
    """CTEs that sweep the moment matrix of columns over its first pivots: name then has s_i_j, the swept entries (i <= j), n and
    mean_i. A pivot that is nearly gone makes all entries null."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    there = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    sums = ", ".join(f"covar_pop({columns[i]}, {columns[j]}) AS s_{i}_{j}" for i, j in pairs)
    means = ", ".join(f"avg({c}) AS mean_{i}" for i, c in enumerate(columns))
    out = [f"{name}0 AS (SELECT {keys}, count(*) AS n, {means}, {sums} FROM {source} WHERE {there} GROUP BY {keys})"]
    out.append(f"{name}_0 AS (SELECT *, {', '.join(f's_{i}_{i} AS d_{i}' for i in range(k))} FROM {name}0)")
    s = lambda i, j: f"s_{min(i, j)}_{max(i, j)}"
    for p in range(pivots):
        pivot = f"(CASE WHEN {s(p, p)} > {R.LEAST_PIVOT!r} * d_{p} AND d_{p} > 1e-26 * mean_{p} * mean_{p} THEN {s(p, p)} END)"
        # Swept rows keep the sign so that the matrix stays symmetric: entries of two swept rows are those of minus the inverse.
        new = []
        for i, j in pairs:
            if i == p and j == p:
                new.append(f"-1 / {pivot} AS {s(i, j)}")
            elif p in (i, j):
                new.append(f"{s(i, j)} / {pivot} AS {s(i, j)}")
            else:
                new.append(f"{s(i, j)} - {s(i, p)} * {s(p, j)} / {pivot} AS {s(i, j)}")
        rest = ", ".join([keys, "n", *(f"mean_{i}" for i in range(k)), *(f"d_{i}" for i in range(k))])
        out.append(f"{name}_{p + 1} AS (SELECT {rest}, {', '.join(new)} FROM {name}_{p})")
    out.append(f"{name} AS (SELECT * FROM {name}_{pivots})")
    return ",\n".join(out)


def f_tail_sql(f: str, d1: str, d2: str, points: int = 4000) -> str:
    """P(F > f) by Simpson's rule over the angle, as a scalar subquery. The integrand is smooth; where it is sharp (many degrees
    of freedom) only its last part counts."""
    top = f"asin(sqrt({d2} / ({d2} + {d1} * ({f}))))"
    low = f"greatest(0, {top} - 40 / sqrt({d2} + 1.0))"
    x = f"({low} + ({top} - {low}) * i / {points})"
    height = f"exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0)) * 2 * pow(sin{x}, {d2} - 1) * pow(cos{x}, {d1} - 1)"
    weight = f"CASE WHEN i IN (0, {points}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"list_sum(list_transform(range(0, {points + 1}), lambda i: ({weight}) * {height})) * ({top} - {low}) / {3 * points}"


def _features(spark, sf_dir) -> DataFrame:
    w = S.over("asset", "d")
    past = w.rowsBetween(-9, -1)
    r = _returns(spark, sf_dir).where("r IS NOT NULL")
    lag = lambda c, k: F.lag(c, k).over(w)
    five = F.when(F.count("r").over(w.rowsBetween(-5, -1)) == 5, F.avg("r").over(w.rowsBetween(-5, -1)))
    spread = F.when(F.count("r").over(past) == 9, F.stddev_pop("r").over(past))
    named = {"r1": lag("r", 1), "v1": lag("v", 1), "r2": lag("r", 2), "v2": lag("v", 2), "m5": five, "s10": spread}
    return r.select("asset", "d", F.col("r").alias("y"), *[c.alias(n) for n, c in named.items()])


_FEATURES_SQL = f"""{RET_SQL}, g AS (SELECT * FROM r WHERE r IS NOT NULL),
x AS (SELECT asset, d, r AS y, lag(r, 1) {W} AS r1, lag(v, 1) {W} AS v1, lag(r, 2) {W} AS r2, lag(v, 2) {W} AS v2,
  CASE WHEN count(r) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5
    THEN avg(r) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS m5,
  CASE WHEN count(r) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) = 9
    THEN stddev_pop(r) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) END AS s10 FROM g)"""


def _ols_many_sql(k: int) -> str:
    xs = list(FEATURES[:k])
    v = lambda i, j: f"-s_{min(i, j)}_{max(i, j)}"
    form = " + ".join(f"({v(i, j)}) * mean_{i} * mean_{j}" for i in range(k) for j in range(k))
    s2 = f"CASE WHEN n > {k + 1} THEN n * greatest(s_{k}_{k}, 0) / (n - {k + 1}) END"
    base = f"mean_{k} - ({' + '.join(f's_{i}_{k} * mean_{i}' for i in range(k))})"
    rows = [f"SELECT asset, n, 1 - s_{k}_{k} / nullif(d_{k}, 0) AS r2, 'const' AS term, {base} AS coef, sqrt({s2} / n * (1 + {form})) AS se FROM s{k}"]
    rows += [
        f"SELECT asset, n, 1 - s_{k}_{k} / nullif(d_{k}, 0) AS r2, '{x}' AS term, s_{i}_{k} AS coef, sqrt({s2} / n * ({v(i, i)})) AS se FROM s{k}"
        for i, x in enumerate(xs)
    ]
    return f"{sweep_sql('whole', f's{k}', 'asset', [*xs, 'y'], k)}, o{k} AS ({' UNION ALL '.join(rows)})"


_SIZES = range(1, len(FEATURES) + 1)
_ALL = " UNION ALL ".join(f"SELECT {k} AS k, * FROM o{k}" for k in _SIZES)


_WHOLE = f"whole AS (SELECT * FROM x WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)})"


@query(f"""WITH {_FEATURES_SQL}, {_WHOLE}, {', '.join(_ols_many_sql(k) for k in _SIZES)}, u AS ({_ALL})
SELECT k::INTEGER AS k, asset, n, term, round(r2, 8) AS r2, round(coef, 7) AS coef, round(se, 7) AS se, round(coef / se, 5) AS t,
  round({f_tail_sql('coef / se * coef / se', '1', '(n - k - 1)')}, 6) AS p FROM u""")
def least_squares_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns on one to six features of the past: coefficients, errors, fit and p values of each size of model, all over the same
    rows and from one aggregation (the plan reuses its exchange)."""
    m, out = R.moments(_features(spark, sf_dir), ["asset"], [*FEATURES, "y"]), None
    for k in _SIZES:
        one = R.solve(m, ["asset"], FEATURES[:k], len(FEATURES), tails=False).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("p", t_two_sided("t", F.col("n") - F.col("k") - 1))
    return rounded(out.select("k", "asset", "n", "term", "r2", "coef", "se", "t", "p"), 6, r2=8, coef=7, se=7, t=5)


def _system(spark, sf_dir, lags: int) -> DataFrame:
    """Returns and volume changes with their values of the rows before."""
    w = S.over("asset", "d")
    past = [F.lag(c, k).over(w).alias(f"{c}_{k}") for k in range(1, lags + 1) for c in ("r", "v")]
    return _returns(spark, sf_dir).where("r IS NOT NULL").select("asset", "d", "r", "v", *past)


def _system_sql(lags: int) -> str:
    past = ", ".join(f"lag({c}, {k}) {W} AS {c}_{k}" for k in range(1, lags + 1) for c in ("r", "v"))
    return f"{RET_SQL}, g AS (SELECT * FROM r WHERE r IS NOT NULL), x AS (SELECT asset, d, r, v, {past} FROM g)"


_PAST = [f"{c}_{k}" for k in range(1, MAX_LAG + 1) for c in ("r", "v")]
_A, _B = 2 * MAX_LAG, 2 * MAX_LAG + 1
_LAG_ROWS = " UNION ALL ".join(
    f"SELECT asset, n, {p} AS p, ln(s_{_A}_{_A} * s_{_B}_{_B} - s_{_A}_{_B} * s_{_A}_{_B}) AS log_det FROM s_{2 * p}" for p in range(1, MAX_LAG + 1)
)


@query(f"""WITH {_system_sql(MAX_LAG)}, {sweep_sql('x', 's', 'asset', [*_PAST, 'r', 'v'], 2 * MAX_LAG)},
u AS (SELECT *, log_det + 8.0 * p / n AS aic FROM ({_LAG_ROWS}))
SELECT asset, n, p::INTEGER AS p, round(log_det, 7) AS log_det, round(aic, 7) AS aic,
  round(aic, 9) = min(round(aic, 9)) OVER (PARTITION BY asset) AS chosen FROM u""")
def autoregression_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector autoregression of returns and volume changes with one to four lags, on the same rows: which one Akaike's
    criterion takes. All orders come from one aggregation and one factor, since the lags of order p come first."""
    m = R.factor(R.moments(_system(spark, sf_dir, MAX_LAG), ["asset"], [*_PAST, "r", "v"]), range(2 * MAX_LAG), [_A, _B])
    rows = []
    for p in range(1, MAX_LAG + 1):
        a, b = (1 - R.explained(y, 2 * p) for y in (_A, _B))
        both = F.col(f"c_{_B}_{_A}") - R._sum([F.col(f"z_{_A}_{q}") * F.col(f"z_{_B}_{q}") for q in range(2 * p)])
        log_det = F.ln(a * b - both * both) + 2 * F.ln(F.col(f"sd_{_A}")) + 2 * F.ln(F.col(f"sd_{_B}"))
        rows.append(F.struct(F.lit(p).alias("p"), log_det.alias("log_det"), (log_det + 8.0 * p / F.col("n")).alias("aic")))
    best = F.array_min(F.transform(F.array(*[r["aic"] for r in rows]), lambda x: F.round(x, 9)))
    u = m.select("asset", "n", best.alias("best"), F.inline(F.array(*rows)))
    return rounded(u.withColumn("chosen", F.round("aic", 9) == F.col("best")).drop("best"), 7)


def _var_sql(y: int) -> str:
    k = 4
    name = "rv"[y]
    s2 = f"n * greatest(s_{k}_{k}, 0) / nullif(n - {k + 1}, 0)"
    rows = [f"SELECT asset, n, '{name}' AS equation, '{x}' AS term, s_{i}_{k} AS coef, sqrt({s2} / n * -s_{i}_{i}) AS se FROM e{y}" for i, x in enumerate(_PAST[:k])]
    return f"{sweep_sql('x', f'e{y}', 'asset', [*_PAST[:k], name], k)}, q{y} AS ({' UNION ALL '.join(rows)})"


@query(f"""WITH {_system_sql(2)}, {_var_sql(0)}, {_var_sql(1)}, u AS (SELECT * FROM q0 UNION ALL SELECT * FROM q1)
SELECT asset, n, equation, term, round(coef, 7) AS coef, round(se, 7) AS se, round({f_tail_sql('coef / se * coef / se', '1', '(n - 5)')}, 6) AS p FROM u""")
def autoregression_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both equations of the autoregression of order two: coefficients, errors and p values."""
    x = _system(spark, sf_dir, 2)
    parts = [R.least_squares(x, ["asset"], y, _PAST[:4]).where("term <> 'const'").withColumn("equation", F.lit(y)) for y in ("r", "v")]
    return rounded(parts[0].unionByName(parts[1]).select("asset", "n", "equation", "term", "coef", "se", "p"), 6, coef=7, se=7)


def _cause_sql(p: int) -> str:
    own, other = [f"r_{k}" for k in range(1, p + 1)], [f"v_{k}" for k in range(1, p + 1)]
    y = 2 * p
    f = f"(a.s_{y}_{y} - b.s_{y}_{y}) / {p} / (b.s_{y}_{y} / (b.n - {2 * p + 1}))"
    swept = sweep_sql("x", f"c{p}", "asset", [*own, *other, "r"], 2 * p)
    return f"{swept}, f{p} AS (SELECT b.asset, b.n, {p} AS lag, {f} AS f_stat FROM c{p}_{p} a JOIN c{p} b ON a.asset = b.asset)"


_CAUSE_ROWS = " UNION ALL ".join(f"SELECT asset, n, lag, f_stat, {f_tail_sql('f_stat', str(p), f'(n - {2 * p + 1})')} AS p FROM f{p}" for p in range(1, CAUSES + 1))


@query(f"""WITH {_system_sql(CAUSES)}, {', '.join(_cause_sql(p) for p in range(1, CAUSES + 1))}, u AS ({_CAUSE_ROWS})
SELECT asset, n, lag::INTEGER AS lag, round(f_stat, 6) AS f_stat, round(p, 6) AS p, p < 0.05 AS causes,
  round(p, 9) = min(round(p, 9)) OVER (PARTITION BY asset) AS best FROM u""")
def causality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether past volume changes help past returns to foretell returns, with one to three lags: the F statistic of the nested
    models (from one factor, own lags first), its p value, and the lag with the least."""
    x = _system(spark, sf_dir, CAUSES)
    parts = None
    for p in range(1, CAUSES + 1):
        own, other = [f"r_{k}" for k in range(1, p + 1)], [f"v_{k}" for k in range(1, p + 1)]
        m = R.factor(R.moments(x, ["asset"], [*own, *other, "r"]), range(2 * p), [2 * p])
        free = F.col("n") - (2 * p + 1)
        less, more = 1 - R.explained(2 * p, p), 1 - R.explained(2 * p, 2 * p)
        f = ratio((less - more) / p, ratio(more, free))
        one = m.select("asset", "n", F.lit(p).alias("lag"), f.alias("f_stat")).withColumn("p", f_tail("f_stat", F.lit(p), free))
        parts = one if parts is None else parts.unionByName(one)
    low = parts.groupBy("asset").agg(F.min(F.round("p", 9)).alias("low"))
    out = parts.join(low, "asset").withColumn("best", F.round("p", 9) == F.col("low")).withColumn("causes", F.col("p") < 0.05)
    return rounded(out.drop("low"))


def _chi2_one_sql(x: str) -> str:
    """The chi-squared tail with one degree of freedom by Simpson's rule over the normal density."""
    at = f"(sqrt({x}) * i / 2000.0)"
    weight = "CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"1 - list_sum(list_transform(range(0, 2001), lambda i: ({weight}) * exp(-{at} * {at} / 2))) * sqrt({x}) / 6000 * sqrt(2 / pi())"


@query(f"""WITH u AS (SELECT asset, 'failures' AS test, lr_pof AS stat, {_chi2_one_sql('lr_pof')} AS p FROM ({ORACLES['kupiec_hits']})
UNION ALL SELECT asset, 'causality' AS test, f_stat AS stat, {f_tail_sql('f_stat', '1', '(n - 3)')} AS p FROM ({ORACLES['granger_f']})
UNION ALL SELECT asset, 'nested forecasts' AS test, stat, {f_tail_sql('stat * stat', '1', '(n - 1)')} AS p FROM ({ORACLES['clark_west']}))
SELECT asset, test, round(stat, 6) AS stat, round(p, 7) AS p FROM u""")
def tail_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p values of three statistics by the exact tails: proportion of failures (chi-squared), causality (F), forecasts (t)."""
    a = kupiec_hits(spark, sf_dir).select("asset", F.lit("failures").alias("test"), F.col("lr_pof").alias("stat"), chi2_tail("lr_pof", F.lit(1)).alias("p"))
    b = granger_f(spark, sf_dir).select("asset", F.lit("causality").alias("test"), F.col("f_stat").alias("stat"), f_tail("f_stat", F.lit(1), F.col("n") - 3).alias("p"))
    c = clark_west(spark, sf_dir).select("asset", F.lit("nested forecasts").alias("test"), "stat", t_two_sided("stat", F.col("n") - 1).alias("p"))
    return rounded(a.unionByName(b).unionByName(c), 7, stat=6)
