"""What prices do around events against all other dates, and one regime label of several with the behaviour that goes with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as C  # noqa: N812
from ..functions.exprs import bucket, ratio, rounded
from ..functions.tails import t_two_sided
from ..operators import series as S
from .registry import query
from .regressions import f_tail_sql
from .scores import WIDE_SQL, _wide
from .stats import RET_SQL, W, _returns

D = ("d",)
HORIZONS = (-20, -5, 1, 5, 20)
APART, SPIKE = 20, 2.0
_past = "OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
_move = lambda h: f"lead(close, {h}) OVER w / close - 1" if h > 0 else f"close / lag(close, {-h}) OVER w - 1"
_ROWS = " UNION ALL ".join(
    f"""SELECT asset, {h} AS h, count(m{k}) FILTER (event) AS n, avg(m{k}) FILTER (event) AS mean, count(m{k}) FILTER (NOT event) AS others,
  avg(m{k}) FILTER (NOT event) AS placebo, stddev_samp(m{k}) FILTER (NOT event) AS sd FROM x GROUP BY asset"""
    for k, h in enumerate(HORIZONS)
)


@query(f"""WITH {RET_SQL}, z AS (SELECT asset, d, close, row_number() {W} AS i,
  CASE WHEN count(volume) {_past} >= 60 THEN (volume - avg(volume) {_past}) / nullif(stddev_pop(volume) {_past}, 0) END AS z FROM r),
c AS (SELECT asset, i, lag(i) OVER (PARTITION BY asset ORDER BY i) AS was FROM z WHERE z >= {SPIKE}),
e AS (SELECT asset, i FROM c WHERE was IS NULL OR i - was > {APART}),
x AS (SELECT z.asset, e.i IS NOT NULL AS event, {', '.join(f'{_move(h)} AS m{k}' for k, h in enumerate(HORIZONS))} FROM z LEFT JOIN e ON e.asset = z.asset AND e.i = z.i
  WINDOW w AS (PARTITION BY z.asset ORDER BY d)), u AS ({_ROWS}), t AS (SELECT *, (mean - placebo) / nullif(sd / sqrt(n), 0) AS t FROM u)
SELECT asset, h::INTEGER AS h, n, round(mean, 6) AS mean, round(placebo, 6) AS placebo, round(t, 4) AS t, round({f_tail_sql('t * t', '1', '(others - 1)')}, 6) AS p
FROM t""")
def event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns before and after days of unusual volume (over two deviations above the sixty before, twenty rows apart) against those
    of all other dates, which are the placebo: means, the difference in standard errors, and its p value.

    All dates are compared with, so nothing is drawn by chance; one ordering of each series and one aggregation.
    """
    w = S.over("asset", "d")
    move = lambda h: ratio(F.lead("close", h).over(w), "close") - 1 if h > 0 else ratio("close", F.lag("close", -h).over(w)) - 1
    z = _returns(spark, sf_dir).select("asset", "d", "close", F.row_number().over(w).alias("i"), S.trailing_z("volume", w, 60, 60).alias("z"))
    spike = F.coalesce(F.col("z") >= SPIKE, F.lit(False))
    was = F.last(F.when(spike, F.col("i")), ignorenulls=True).over(w.rowsBetween(S.Window.unboundedPreceding, -1))
    x = z.select("asset", (spike & F.coalesce(F.col("i") - was > APART, F.lit(True))).alias("event"), *[move(h).alias(f"m{k}") for k, h in enumerate(HORIZONS)])
    on = lambda f, k, event: f(F.when(F.col("event") == event, F.col(f"m{k}")))
    each = [
        F.struct(
            F.lit(h).alias("h"), on(F.count, k, True).alias("n"), on(F.avg, k, True).alias("mean"), on(F.count, k, False).alias("others"),
            on(F.avg, k, False).alias("placebo"), on(F.stddev_samp, k, False).alias("sd"),
        )
        for k, h in enumerate(HORIZONS)
    ]
    u = x.groupBy("asset").agg(*[s.alias(f"s{k}") for k, s in enumerate(each)])
    u = u.select("asset", F.inline(F.array(*[f"s{k}" for k in range(len(HORIZONS))])))
    t = u.withColumn("t", ratio(F.col("mean") - F.col("placebo"), F.try_divide(F.col("sd"), F.sqrt("n"))))
    return rounded(t.select("asset", "h", "n", "mean", "placebo", "t", t_two_sided("t", F.col("others") - 1).alias("p")), 6, t=4)


# Severities of behaviour.
BEHAVIOUR = {"PANIC": 85, "DISTRIBUTION": 65, "EUPHORIA": 45, "EXPANSION": 20, "ACCUMULATION": 25}


def with_behaviour(structural: Column, behaviour: Column) -> Column:
    """The highest structural severity, edged by a behaviour that agrees: at least 70 where both are high, at most 25 where both are
    low; behaviour alone counts where nothing structural is there, and never turns a calm reading."""
    worst = F.array_max(structural)
    return (
        F.when(worst.isNull(), behaviour)
        .when((behaviour >= 60) & (worst >= 45), F.greatest(worst, F.lit(70)))
        .when((behaviour <= 30) & (worst <= 30), F.least(worst, F.lit(25)))
        .otherwise(worst)
    )


_LABELS = [(0, 35, "BULLISH"), (35, 60, "ELEVATED"), (60, 1000, "STRESSED")]
_of = lambda v: f"CASE WHEN {v} >= 60 THEN 'STRESSED' WHEN {v} >= 35 THEN 'ELEVATED' ELSE 'BULLISH' END"


@query(f"""WITH {WIDE_SQL}, l AS (SELECT asset, d, CASE WHEN dvol > 80 THEN 55 ELSE 20 END AS a, CASE WHEN chg > 0 THEN 20 WHEN chg < -4 THEN 60 ELSE 25 END AS b,
  CASE WHEN fng > 60 THEN 20 WHEN fng > 20 THEN NULL ELSE 85 END AS c,
  CASE WHEN fng < 15 THEN 85 WHEN chg < -8 THEN 65 WHEN fng > 80 THEN 45 WHEN chg > 4 THEN 20 WHEN dvol < 45 THEN 25 END AS e FROM wide),
w AS (SELECT *, greatest(a, b, c) AS worst FROM l),
s AS (SELECT *, CASE WHEN e >= 60 AND worst >= 45 THEN greatest(worst, 70) WHEN e <= 30 AND worst <= 30 THEN least(worst, 25) ELSE worst END AS severity FROM w),
v AS (SELECT asset, d, severity, {_of('severity')} AS label, list_filter([a, b, c, e], lambda x: x IS NOT NULL) AS votes FROM s)
SELECT asset, d, severity, label, len(votes)::INTEGER AS sources, round(len(list_filter(votes, lambda x: {_of('x')} = label)) / len(votes), 3) AS agreement,
  len(list_filter(votes, lambda x: {_of('x')} <> label)) > 0 AS conflict FROM v""", text=D)
def regime_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One regime of three labels and a state of behaviour, any of which may be missing: severity, label, agreement and conflict."""
    fng, chg, dvol = (F.col(c) for c in ("fng", "chg", "dvol"))
    a, b = F.when(dvol > 80, "STRESS").otherwise("NORMAL"), F.when(chg > 0, "BULL").when(chg < -4, "BEAR").otherwise("SIDEWAYS")
    c = F.when(fng > 60, "BULL").when(fng > 20, None).otherwise("CRISIS")
    e = F.when(fng < 15, "PANIC").when(chg < -8, "DISTRIBUTION").when(fng > 80, "EUPHORIA").when(chg > 4, "EXPANSION").when(dvol < 45, "ACCUMULATION")
    told = lambda names: F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    there = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    rows = _wide(spark, sf_dir).select("asset", "d", F.array(a, b, c).alias("labels"), told(BEHAVIOUR)[e].alias("e"))
    rows = rows.withColumn("v", F.transform(there("labels"), lambda x: told(C.CONSENSUS)[x]))
    rows = rows.withColumn("severity", with_behaviour(F.col("v"), F.col("e"))).withColumn("label", bucket("severity", _LABELS))
    votes = there(F.concat("v", F.array("e")))
    rows = rows.withColumn("votes", votes).withColumn("same", F.size(F.filter("votes", lambda x: bucket(x, _LABELS) == F.col("label"))))
    agreement = F.round(F.try_divide(F.col("same"), F.size("votes")), 3)
    return rows.select("asset", "d", "severity", "label", F.size("votes").alias("sources"), agreement.alias("agreement"), (F.col("same") < F.size("votes")).alias("conflict"))
