"""First principal components, weights by co-movement, confidence with spread and correlation, and folds from table functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import clamp, col, rounded
from ..operators import generators as G  # noqa: N812
from ..operators import regression as R  # noqa: N812
from ..operators import series as S
from ..sources.tables import BARS_SQL, bars
from .linear import METRICS
from .registry import ORACLES, query
from .validation import _labelled

ROUNDS = 200
_K = len(METRICS)


def first_component(matrix: Column, k: int, rounds: int = ROUNDS) -> Column:
    """The first eigenvector of a symmetric matrix (an array of arrays) by power iteration from equal loadings, of length one,
    its entries' sum not negative; null where the matrix holds a null."""
    dot = lambda row, v: F.aggregate(F.zip_with(row, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    def step(v: Column, _: Column) -> Column:
        return F.transform(F.array(F.transform(matrix, lambda row: dot(row, v))), lambda w: F.transform(w, lambda x: F.try_divide(x, F.sqrt(dot(w, w)))))[0]

    start = F.array_repeat(F.lit(1 / k**0.5), k)
    whole = ~F.exists(F.flatten(matrix), lambda x: x.isNull())
    v = F.when(whole, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))
    flip = F.when(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) < 0, -1.0).otherwise(1.0)
    return F.transform(v, lambda x: x * flip)


def correlation_matrix(k: int) -> Column:
    """The matrix of correlations of R.moments()."""
    return F.array(*[F.array(*[R._c(i, j) for j in range(k)]) for i in range(k)])


_pair = lambda i, j: "1.0" if i == j else f"c_{max(i, j)}_{min(i, j)}"
_row = lambda i: " + ".join(f"{_pair(i, j)} * v_{j}" for j in range(_K))
_w = ", ".join(f"{_row(i)} AS w_{i}" for i in range(_K))
_len = "sqrt(" + " + ".join(f"w_{i} * w_{i}" for i in range(_K)) + ")"
_start = ", ".join(f"{_K ** -0.5!r}::DOUBLE AS v_{i}" for i in range(_K))
_corrs = ", ".join(f"corr({METRICS[i]}, {METRICS[j]}) AS c_{i}_{j}" for i in range(_K) for j in range(i))
_names = ", ".join(f"c_{i}_{j}" for i in range(_K) for j in range(i))
_pull = lambda i: " + ".join(f"abs({_pair(i, j)})" for j in range(_K) if i != j)
_all = " + ".join(f"({_pull(i)})" for i in range(_K))
_sign = "CASE WHEN " + " + ".join(f"v_{i}" for i in range(_K)) + " < 0 THEN -1 ELSE 1 END"
_share = "(" + " + ".join(f"v_{i} * ({_row(i)})" for i in range(_K)) + f") / {_K}"
_COMPONENT_ROWS = " UNION ALL ".join(
    f"SELECT asset, '{m}' AS metric, round({_sign} * v_{i}, 6) AS loading, round({_share}, 6) AS share, round(({_pull(i)}) / ({_all}), 6) AS weight FROM e"
    for i, m in enumerate(METRICS)
)


@query(f"""WITH RECURSIVE {BARS_SQL}, c AS (SELECT asset, {_corrs} FROM bars GROUP BY asset),
p AS (SELECT asset, {_names}, 0 AS step, {_start} FROM c UNION ALL
  SELECT asset, {_names}, step + 1, {', '.join(f'w_{i} / {_len}' for i in range(_K))} FROM (SELECT asset, {_names}, step, {_w} FROM p WHERE step < {ROUNDS})),
e AS (SELECT * FROM p WHERE step = {ROUNDS}) {_COMPONENT_ROWS}""")
def principal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first principal component of each series' metrics (loadings and share of variance), and weights by how much each metric
    moves with the others. One aggregation; the rest is arithmetic on a row for each series."""
    m = R.moments(bars(spark, sf_dir), ["asset"], list(METRICS)).withColumn("v", first_component(correlation_matrix(_K), _K))
    pull = [R._sum([F.abs(R._c(i, j)) for j in range(_K) if i != j]) for i in range(_K)]
    share = R._sum([F.col("v")[i] * R._sum([R._c(i, j) * F.col("v")[j] for j in range(_K)]) for i in range(_K)]) / _K
    rows = [F.struct(F.lit(n).alias("metric"), F.col("v")[i].alias("loading"), share.alias("share"), F.try_divide(pull[i], R._sum(pull)).alias("weight")) for i, n in enumerate(METRICS)]
    return rounded(m.select("asset", F.inline(F.array(*rows))))


def spread_confidence(confidence, risk, agreement, together) -> Column:
    """Confidence times what is not at risk, less a penalty where little confidence meets much risk (heavier the more the two move
    together), and a little more where methods agree."""
    base = clamp(col(confidence) * (1 - col(risk)), 0.0, 1.0)
    penalty = 0.35 * (0.5 + 0.5 * clamp(together, 0.0, 1.0)) * (1 - col(confidence)) * col(risk)
    return clamp(base - penalty + 0.05 * col(agreement) * base, 0.0, 0.95)


_past = "OVER (PARTITION BY asset ORDER BY d ROWS 59 PRECEDING)"


@query(f"""WITH {BARS_SQL}, x AS (SELECT asset, d, close / max(close) OVER (PARTITION BY asset ORDER BY d) AS confidence, 1 - low / high AS risk,
  least(1, n / 20.0) AS agreement FROM bars),
y AS (SELECT *, count(*) {_past} AS k, covar_pop(confidence, risk) {_past} AS cov, stddev_pop(confidence) {_past} * stddev_pop(risk) {_past} AS size FROM x),
z AS (SELECT *, coalesce(cov / nullif(size, 0), 0) AS together, greatest(0, least(1, confidence * (1 - risk))) AS base FROM y WHERE k >= 60)
SELECT asset, d, round(greatest(0, least(0.95, base - 0.35 * (0.5 + 0.5 * greatest(0, least(1, together))) * (1 - confidence) * risk + 0.05 * agreement * base)), 6)
  AS confidence FROM z""", text=("d",))
def composite_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence from closeness to the high, risk from the day's range, their correlation over sixty rows."""
    w = S.over("asset", "d")
    past = w.rowsBetween(-59, 0)
    x = bars(spark, sf_dir).select(
        "asset", "d", (F.col("close") / F.max("close").over(w)).alias("confidence"), (1 - F.col("low") / F.col("high")).alias("risk"),
        F.least(F.lit(1.0), F.col("n") / 20.0).alias("agreement"),
    )
    size = F.stddev_pop("confidence").over(past) * F.stddev_pop("risk").over(past)
    together = F.coalesce(F.try_divide(F.covar_pop("confidence", "risk").over(past), size), F.lit(0.0))
    y = x.withColumns({"k": F.count(F.lit(1)).over(past), "together": together}).where("k >= 60")
    return rounded(y.select("asset", "d", spread_confidence("confidence", "risk", "agreement", "together").alias("confidence")))


@query(ORACLES["purged_folds"])
def purged_folds_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purged folds by a table function over the partitioned series: no row is joined with another."""
    return G.purged_folds(_labelled(spark, sf_dir), 5, 7).groupBy("asset", "fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query()
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean weekly return by resampled blocks of seven rows, from a table function."""
    rows = _labelled(spark, sf_dir).select("asset", "d", F.col("y").alias("x"))
    point = rows.groupBy("asset").agg(F.avg("x").alias("mean"), F.count("x").alias("n"))
    drawn = G.block_replicates(rows, 200, 7).groupBy("asset")
    ends = drawn.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    return rounded(point.join(ends, "asset"))
