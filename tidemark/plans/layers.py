"""Layered scores, structure, regime filter, and studies around events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import clamp, corr, decay, ratio, rounded, weighted_mean
from ..operators import folds as O
from ..operators import series as S
from ..operators import stats as ST
from ..sources.tables import BARS_SQL, bars, trades
from .registry import query
from .stats import RET_SQL, _returns

D = ("d",)
W = "OVER (PARTITION BY asset ORDER BY d"
SPAN, LEAST = 120, 60


def _cdf(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    poly = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    tail = f"exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {poly}"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


_X = ("rng", "vol", "mom", "jump", "slow")
_LAYER_SQL = f"""{BARS_SQL}, b0 AS (SELECT *, row_number() {W}) AS i FROM bars),
b1 AS (SELECT asset, d, i, (high - low) / close AS rng, volume AS vol, close / lag(close, 20) {W}) - 1 AS mom, abs(close / lag(close) {W}) - 1) AS jump, last_value(CASE WHEN i % 5 = 1 THEN quote END IGNORE NULLS) {W}) AS slow, (i - 1) % 5 AS age FROM b0),
b2 AS (SELECT *, {', '.join(f'quantile_cont({x}, 0.5) {W} ROWS {SPAN - 1} PRECEDING) AS m_{x}, list({x}) FILTER ({x} IS NOT NULL) {W} ROWS {SPAN - 1} PRECEDING) AS h_{x}' for x in _X)} FROM b1),
b3 AS (SELECT *, {', '.join(f"CASE WHEN len(h_{x}) >= {LEAST} THEN ({x} - m_{x}) / nullif(1.4826 * list_aggregate(list_transform(h_{x}, lambda v: abs(v - m_{x})), 'median'), 0) END AS z_{x}" for x in _X)} FROM b2),
b4 AS (SELECT asset, d, age, {', '.join(f"CASE WHEN z_{x} IS NOT NULL THEN 100 * ({_cdf(f'least(greatest(z_{x}, -3), 3)')}) END AS p_{x}" for x in _X)} FROM b3),
y AS (SELECT asset, d, ((100 - coalesce(p_rng, 50)) * 0.6 + (100 - coalesce(p_slow, 50)) * 0.4 * pow(2, -age / 10)) / (0.6 + 0.4 * pow(2, -age / 10)) AS la, (0.6 + 0.4 * pow(2, -age / 10)) AS cover,
  0.65 * coalesce(p_mom, 50) + 0.35 * coalesce(p_vol, 50) AS lt, coalesce(p_rng, 50) AS cs, coalesce(p_vol, 50) AS fs, coalesce(p_jump, 50) AS pf FROM b4 WHERE p_rng IS NOT NULL AND p_mom IS NOT NULL)"""


def _layers(spark, sf_dir) -> DataFrame:
    """Layer scores of each day: robust percentiles of readings, older readings with less weight, missing ones in the middle."""
    w = S.over("asset", "d")
    i = F.row_number().over(w)
    b = bars(spark, sf_dir).withColumn("i", i)
    x = b.select(
        "asset", "d", ((F.col("high") - F.col("low")) / F.col("close")).alias("rng"), F.col("volume").alias("vol"), (F.col("close") / F.lag("close", 20).over(w) - 1).alias("mom"),
        F.abs(F.col("close") / F.lag("close").over(w) - 1).alias("jump"), S.locf(F.when(F.col("i") % 5 == 1, F.col("quote")), w).alias("slow"), ((F.col("i") - 1) % 5).alias("age"),
    )
    for c in _X:
        x = S.robust_pct(x, c, f"p_{c}", "asset", "d", SPAN, LEAST)
    p = lambda c: F.coalesce(f"p_{c}", F.lit(50.0))
    fresh = 0.4 * decay("age", 10.0)
    la = ((100 - p("rng")) * 0.6 + (100 - p("slow")) * fresh) / (0.6 + fresh)
    x = x.where("p_rng IS NOT NULL AND p_mom IS NOT NULL")
    return x.select("asset", "d", la.alias("la"), (0.6 + fresh).alias("cover"), (0.65 * p("mom") + 0.35 * p("vol")).alias("lt"), p("rng").alias("cs"), p("vol").alias("fs"), p("jump").alias("pf"))


@query(f"""WITH {_LAYER_SQL} SELECT asset, d, round(la, 4) AS la, round(cover, 6) AS cover, round(lt, 4) AS lt, round(la * (100 - lt) / 100, 4) AS flti, round(pf * greatest(cs, fs) / 100, 4) AS sfm,
  round(0.40 * cs + 0.25 * fs + 0.20 * pf + 0.15 * (100 - lt), 4) AS sc, round(0.30 * (100 - cs) + 0.20 * (100 - fs) + 0.20 * lt + 0.30 * pf, 4) AS re FROM y""", text=D)
def layer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers and the composites of pressure, fragility and recovery made of them."""
    y = _layers(spark, sf_dir)
    la, lt, cs, fs, pf = (F.col(c) for c in ("la", "lt", "cs", "fs", "pf"))
    return rounded(y.select(
        "asset", "d", "la", "cover", "lt", (la * (100 - lt) / 100).alias("flti"), (pf * F.greatest(cs, fs) / 100).alias("sfm"), (0.40 * cs + 0.25 * fs + 0.20 * pf + 0.15 * (100 - lt)).alias("sc"),
        (0.30 * (100 - cs) + 0.20 * (100 - fs) + 0.20 * lt + 0.30 * pf).alias("re"),
    ), 4, cover=6)


_PR = {"amihud": (True, 0.30), "steady": (True, 0.25), "strength": (False, 0.25), "busiest": (True, 0.20)}
_part = lambda c: f"CASE WHEN len(h_{c}) >= {LEAST} AND {c} IS NOT NULL THEN {'100 - ' if _PR[c][0] else ''}100 * (len(list_filter(h_{c}, lambda v: v < {c})) + (len(list_filter(h_{c}, lambda v: v = {c})) + 1) / 2) / len(h_{c}) END AS p_{c}"
_min = lambda f, x, n, least: f"CASE WHEN count({x}) {W} ROWS {n - 1} PRECEDING) >= {least} THEN {f} {W} ROWS {n - 1} PRECEDING) END"
_STRUCT_SQL = f"""{BARS_SQL}, fl AS (SELECT asset, d, coalesce(sum(notional) FILTER (buy), 0) AS bq, sum(notional) AS q FROM trades GROUP BY 1, 2), s0 AS (SELECT b.asset, b.d, close, quote, close / lag(close) OVER (PARTITION BY b.asset ORDER BY b.d) - 1 AS r, (2 * bq - q) / q AS imb, (close - low) / nullif(high - low, 0) AS loc FROM bars b JOIN fl ON b.asset = fl.asset AND b.d = fl.d),
s1 AS (SELECT asset, d, close, round({_min('quantile_cont(abs(r) / quote, 0.5)', 'r', 20, 10)}, 14) AS amihud, round({_min('stddev_samp(imb)', 'imb', 20, 20)}, 9) AS steady, round({_min('avg(loc)', 'loc', 20, 15)}, 9) AS strength, quote / ({_min('sum(quote)', 'quote', 20, 20)}) AS share FROM s0),
s2 AS (SELECT *, round({_min('max(share)', 'share', 20, 20)}, 9) AS busiest FROM s1), s3 AS (SELECT *, {', '.join(f'list({c}) FILTER ({c} IS NOT NULL) {W} ROWS {SPAN - 1} PRECEDING) AS h_{c}' for c in _PR)} FROM s2), s4 AS (SELECT asset, d, close, {', '.join(map(_part, _PR))} FROM s3),
s5 AS (SELECT asset, d, close, {' + '.join(f'CASE WHEN p_{c} IS NOT NULL THEN {w} ELSE 0 END' for c, (_, w) in _PR.items())} AS cover, {' + '.join(f'coalesce(p_{c} * {w}, 0)' for c, (_, w) in _PR.items())} AS total FROM s4),
s6 AS (SELECT asset, d, close, cover, CASE WHEN cover >= 0.3 THEN round(total / cover, 6) END AS pfs FROM s5)"""


def _structure(spark, sf_dir) -> DataFrame:
    w = S.over("asset", "d")
    flow = trades(spark, sf_dir).groupBy("asset", "d").agg(F.sum(F.when(F.col("buy"), F.col("notional")).otherwise(0)).alias("bq"), F.sum("notional").alias("q"))
    s = bars(spark, sf_dir).join(flow, ["asset", "d"]).select("asset", "d", "close", "quote", (F.col("close") / F.lag("close").over(w) - 1).alias("r"), ((2 * F.col("bq") - F.col("q")) / F.col("q")).alias("imb"), ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")).alias("loc"))
    held = lambda f, x, least: S.full(f.over(w.rowsBetween(-19, 0)), x, w.rowsBetween(-19, 0), least)
    s = s.select("asset", "d", "close", F.round(held(F.percentile(F.abs("r") / F.col("quote"), F.lit(0.5)), "r", 10), 14).alias("amihud"), F.round(held(F.stddev_samp("imb"), "imb", 20), 9).alias("steady"), F.round(held(F.avg("loc"), "loc", 15), 9).alias("strength"), (F.col("quote") / held(F.sum("quote"), "quote", 20)).alias("share"))
    s = s.withColumn("busiest", F.round(held(F.max("share"), "share", 20), 9))
    part = lambda c, turn: (lambda p: 100 - p if turn else p)(100 * S.rolling_rank(c, w, SPAN, LEAST))
    parts = [(F.when(F.col(c).isNotNull(), part(c, turn)), weight) for c, (turn, weight) in _PR.items()]
    cover = sum((F.when(c.isNotNull(), F.lit(weight)).otherwise(0.0) for c, weight in parts), F.lit(0.0))
    return s.select("asset", "d", "close", cover.alias("cover"), F.round(weighted_mean(parts, 0.3), 6).alias("pfs"))


@query(f"""WITH {_STRUCT_SQL}, s7 AS (SELECT *, round(pfs - lag(pfs, 20) {W}), 6) AS dp FROM s6), s8 AS (SELECT *, list(dp) FILTER (dp IS NOT NULL) {W} ROWS {SPAN - 1} PRECEDING) AS h FROM s7)
SELECT asset, d, round(cover, 6) AS cover, round(pfs, 4) AS pfs, round(CASE WHEN dp IS NOT NULL AND len(h) >= {LEAST} THEN 100 - 100 * (len(list_filter(h, lambda v: v < dp)) + (len(list_filter(h, lambda v: v = dp)) + 1) / 2) / len(h) END, 4) AS sfi FROM s8""", text=D)
def structure_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep, steady, strong and broad trading is (percentile ranks, by what is there), and how that changes."""
    w = S.over("asset", "d")
    s = _structure(spark, sf_dir).withColumn("dp", F.round(F.col("pfs") - F.lag("pfs", 20).over(w), 6))
    sfi = F.when(F.col("dp").isNotNull(), 100 - 100 * S.rolling_rank("dp", w, SPAN, LEAST))
    return s.select("asset", "d", F.round("cover", 6).alias("cover"), F.round("pfs", 4).alias("pfs"), F.round(sfi, 4).alias("sfi"))


_LABEL_SQL = f"""l0 AS (SELECT asset, d, close, r, lead(close, 20) {W}) / close - 1 AS fwd, CASE WHEN count(r) {W} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) = 20 THEN stddev_samp(r) {W} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) END AS fv FROM r),
l1 AS (SELECT *, CASE WHEN count(fv) {W} ROWS {SPAN - 1} PRECEDING) >= {LEAST} THEN quantile_cont(fv, 0.75) {W} ROWS {SPAN - 1} PRECEDING) END AS thr FROM l0), l2 AS (SELECT asset, d, CAST(fwd < -0.10 OR round(fv, 9) > round(thr, 9) AS INTEGER) AS y FROM l1 WHERE fwd IS NOT NULL AND fv IS NOT NULL AND thr IS NOT NULL)"""


def _labels(spark, sf_dir) -> DataFrame:
    w = S.over("asset", "d")
    ahead = w.rowsBetween(1, 20)
    r = _returns(spark, sf_dir).select("asset", "d", S.forward_return("close", w, 20).alias("fwd"), S.full(F.stddev_samp("r").over(ahead), "r", ahead, 20).alias("fv"))
    r = r.withColumn("thr", S.rolling_quantile("fv", w, SPAN, 0.75, LEAST)).dropna()
    return r.select("asset", "d", ((F.col("fwd") < -0.10) | (F.round("fv", 9) > F.round("thr", 9))).cast("int").alias("y"))


@query(f"WITH {RET_SQL}, {_LABEL_SQL} SELECT asset, count(*) AS n, sum(y)::BIGINT AS stressed, round(avg(y), 6) AS base_rate FROM l2 GROUP BY asset")
def stress_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days before a fall of a tenth, or before more volatility than three of four days had."""
    return _labels(spark, sf_dir).groupBy("asset").agg(F.count("*").alias("n"), F.sum("y").alias("stressed"), F.round(F.avg("y"), 6).alias("base_rate"))


@query(f"""WITH {RET_SQL}, p AS (SELECT asset, d, r, close, max(close) {W}) AS top FROM r), g AS (SELECT *, sum(CASE WHEN close = top THEN 1 ELSE 0 END) {W}) AS peak, row_number() {W}) AS i FROM p),
e AS (SELECT asset, peak, min(i) AS i, min(d) AS d, 1 - min(close) / max(top) AS fall FROM g GROUP BY 1, 2 HAVING 1 - min(close) / max(top) >= 0.15),
s AS (SELECT e.asset, e.d, e.fall, avg(g.r) AS before, count(g.r) AS n FROM e JOIN g ON g.asset = e.asset AND g.i BETWEEN e.i - 30 AND e.i - 5 WHERE e.i > 30 GROUP BY 1, 2, 3)
SELECT asset, d, round(fall, 6) AS fall, n, round(before, 8) AS before FROM s""", text=D)
def drawdown_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Falls of 15 % or more from each peak, and the mean return in the window before the peak (30 to 5 rows).

    The window is a frame over rows, so events and signal are not joined by range.
    """
    w = S.over("asset", "d")
    upto, window = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-30, -5)
    g = _returns(spark, sf_dir).select("asset", "d", "close", F.max("close").over(upto).alias("top"), F.row_number().over(w).alias("i"), F.avg("r").over(window).alias("before"), F.count("r").over(window).alias("n"))
    g = g.withColumn("peak", F.sum((F.col("close") == F.col("top")).cast("int")).over(upto))
    at = lambda c: F.min_by(c, "i")
    e = g.groupBy("asset", "peak").agg(F.min("d").alias("d"), F.min("i").alias("i"), (1 - F.min("close") / F.max("top")).alias("fall"), at("n").alias("n"), at("before").alias("before"))
    return e.where((F.col("fall") >= 0.15) & (F.col("i") > 30) & (F.col("n") > 0)).select("asset", "d", F.round("fall", 6).alias("fall"), "n", F.round("before", 8).alias("before"))


@query(f"""WITH {RET_SQL}, k AS (SELECT asset, d, v, unnest(range(-10, 11)) AS h FROM r), o AS (SELECT asset, h, d, row_number() OVER (PARTITION BY asset, h ORDER BY d) AS i, v FROM k),
x AS (SELECT asset, row_number() {W}) AS i, r FROM r) SELECT o.asset, h::INTEGER AS h, count(*) AS n, round(corr(v, r), 8) AS c FROM o JOIN x ON x.asset = o.asset AND x.i = o.i + h WHERE v IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2""")
def lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlation of one series with another at each lead and lag up to ten rows: one pass, no join."""
    w = S.over("asset", "d")
    shift = lambda h: F.lead("r", h).over(w) if h >= 0 else F.lag("r", -h).over(w)
    hs = range(-10, 11)
    r = _returns(spark, sf_dir)
    x = r.select("asset", "v", *[shift(h).alias(f"r{h + 10}") for h in hs])
    both = lambda h: F.col("v").isNotNull() & F.col(f"r{h + 10}").isNotNull()
    g = x.groupBy("asset").agg(*[F.struct(F.lit(h).alias("h"), F.count_if(both(h)).alias("n"), F.round(corr("v", f"r{h + 10}"), 8).alias("c")).alias(f"s{h + 10}") for h in hs])
    return g.select("asset", F.inline(F.array(*[f"s{h + 10}" for h in hs])))


@query(f"""WITH {BARS_SQL}, m AS (SELECT asset, d, close, CASE WHEN count(*) {W} ROWS 199 PRECEDING) = 200 THEN avg(close) {W} ROWS 199 PRECEDING) END AS sma, max(close) {W} ROWS 179 PRECEDING) AS high180, count(*) {W} ROWS 179 PRECEDING) AS n FROM bars)
SELECT asset, d, CASE WHEN close > sma THEN 'BULL' ELSE 'BEAR' END AS trend, CASE WHEN close >= 0.9 * high180 THEN 'HIGH' WHEN close >= 0.7 * high180 THEN 'MIDDLE' ELSE 'LOW' END AS phase FROM m WHERE sma IS NOT NULL AND n = 180""", text=D)
def trend_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Above or under the mean of 200 rows, and how far under the highest of 180."""
    w = S.over("asset", "d")
    m = bars(spark, sf_dir).select("asset", "d", "close", S.rolling(F.avg, "close", w, 200).alias("sma"), F.max("close").over(w.rowsBetween(-179, 0)).alias("high180"))
    phase = F.when(F.col("close") >= 0.9 * F.col("high180"), "HIGH").when(F.col("close") >= 0.7 * F.col("high180"), "MIDDLE").otherwise("LOW")
    return m.where("sma IS NOT NULL").select("asset", "d", F.when(F.col("close") > F.col("sma"), "BULL").otherwise("BEAR").alias("trend"), phase.alias("phase"))


@query(f"""WITH {BARS_SQL}, y AS (SELECT b.asset, b.d, b.close, p.close AS past, p.d AS seen FROM bars b ASOF JOIN bars p ON b.asset = p.asset AND b.d - INTERVAL 365 DAY >= p.d)
SELECT asset, d, round(close / past - 1, 9) AS yoy FROM y WHERE date_diff('day', seen, CAST(d - INTERVAL 365 DAY AS DATE)) < 10""", text=D)
def yoy_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change over the last value known 365 days ago, not older than ten days then."""
    b = bars(spark, sf_dir).select("asset", "d", "close")
    left = b.select("asset", F.date_sub("d", 365).alias("at"), "d", "close")
    y = S.asof(left, b.select("asset", F.col("d").alias("at"), F.col("close").alias("past")), "asset", "at", "past", "past", 10)
    return y.where("past IS NOT NULL").select("asset", "d", F.round(F.col("close") / F.col("past") - 1, 9).alias("yoy"))


@query(f"""WITH {RET_SQL}, b AS (SELECT asset, d, r, abs(r) * abs(lag(r) {W})) AS bp, r * r AS rv FROM r), s AS (SELECT asset, d, CASE WHEN count(bp) {W} ROWS 29 PRECEDING) = 30 THEN pi() / 2 * sum(bp) {W} ROWS 29 PRECEDING) END AS bpv, CASE WHEN count(rv) {W} ROWS 29 PRECEDING) = 30 THEN sum(rv) {W} ROWS 29 PRECEDING) END AS rv FROM b),
v AS (SELECT *, sqrt(rv / 30) AS vol FROM s) SELECT asset, d, round(bpv, 8) AS bipower, round(greatest(0, 1 - bpv / nullif(rv, 0)), 8) AS jump_share, round(CASE WHEN count(vol) {W} ROWS 29 PRECEDING) = 30 THEN stddev_samp(vol) {W} ROWS 29 PRECEDING) END, 8) AS vol_of_vol FROM v WHERE bpv IS NOT NULL""", text=D)
def bipower_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipower variation, the share of variance that is jumps, and the volatility of volatility."""
    w = S.over("asset", "d")
    b = _returns(spark, sf_dir).select("asset", "d", (F.abs("r") * F.abs(F.lag("r").over(w))).alias("bp"), (F.col("r") ** 2).alias("q"))
    s = b.select("asset", "d", (np.pi / 2 * S.rolling(F.sum, "bp", w, 30)).alias("bpv"), S.rolling(F.sum, "q", w, 30).alias("rv")).withColumn("vol", F.sqrt(F.col("rv") / 30))
    s = s.withColumn("vov", S.rolling(F.stddev_samp, "vol", w, 30)).where("bpv IS NOT NULL")
    # The frame of the twin begins at the first bipower value, too.
    first = F.row_number().over(w)
    return rounded(s.select("asset", "d", F.col("bpv").alias("bipower"), F.greatest(F.lit(0.0), 1 - ratio("bpv", "rv")).alias("jump_share"), F.when(first >= 30, F.col("vov")).alias("vol_of_vol")), 8)


@query(f"""WITH {RET_SQL}, l AS (SELECT asset, d, r, lag(r) {W}) AS p FROM r), c AS (SELECT asset, d, count(p) {W} ROWS 59 PRECEDING) AS n, corr(r, p) {W} ROWS 59 PRECEDING) AS rho, var_pop(r) {W} ROWS 59 PRECEDING) AS v,
  avg(r * r * r) {W} ROWS 59 PRECEDING) AS m3, avg(r * r) {W} ROWS 59 PRECEDING) AS m2, avg(r) {W} ROWS 59 PRECEDING) AS m FROM l WHERE p IS NOT NULL) SELECT asset, d, round(rho, 6) AS rho1, round((m3 - 3 * m * m2 + 2 * m * m * m) / pow(m2 - m * m, 1.5), 6) AS skew FROM c WHERE n = 60""", text=D)
def slowing_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of critical slowing down: rolling first autocorrelation and skewness."""
    w = S.over("asset", "d")
    l = _returns(spark, sf_dir).select("asset", "d", "r", F.lag("r").over(w).alias("p")).where("p IS NOT NULL")  # noqa: E741
    f = w.rowsBetween(-59, 0)
    mean = lambda k: F.avg(F.col("r") ** k).over(f)
    skew = ratio(mean(3) - 3 * mean(1) * mean(2) + 2 * mean(1) ** 3, F.pow(mean(2) - mean(1) ** 2, F.lit(1.5)))
    c = l.select("asset", "d", F.count("p").over(f).alias("n"), corr("r", "p", f).alias("rho1"), skew.alias("skew")).where("n = 60")
    return rounded(c.select("asset", "d", "rho1", "skew"))


@query(f"""WITH {RET_SQL}, m AS (SELECT asset, avg(r) AS m, stddev_samp(r) AS s, count(r) AS n FROM r GROUP BY asset), z AS (SELECT r.asset, (r - m) / s AS z, 1.06 * pow(n, -0.2) AS bw, n FROM r JOIN m ON r.asset = m.asset WHERE r IS NOT NULL),
b AS (SELECT asset, bw, n, round(z * 200) / 200 AS z, count(*) AS k FROM z GROUP BY 1, 2, 3, round(z * 200) / 200), g AS (SELECT asset, bw, n, z, k, unnest(range(0, 512)) AS i FROM b), q AS (SELECT asset, i, -5 + i * 10 / 511.0 AS x, bw, n, z, k FROM g),
p AS (SELECT asset, i, sum(k * exp(-(x - z) * (x - z) / (2 * bw * bw))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())) AS p, sum(-k * (x - z) / (bw * bw) * exp(-(x - z) * (x - z) / (2 * bw * bw))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())) AS dp FROM q GROUP BY 1, 2),
f AS (SELECT asset, dp * dp / greatest(p, 1e-12) * CASE WHEN i IN (0, 511) THEN 0.5 ELSE 1 END * 10 / 511.0 AS f FROM p) SELECT asset, round(sum(f), 5) AS fisher, round(sum(f) - 1, 5) AS excess FROM f GROUP BY asset""")
def fisher_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fisher information of the density of standardised returns (a kernel estimate on 512 points); 1 for the normal law.

    Returns are counted in bins of 1/200 first, so that the grid is laid over counts, not rows.
    """
    r = _returns(spark, sf_dir).where("r IS NOT NULL")
    m = r.groupBy("asset").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.count("r").alias("n"))
    z = r.join(m, "asset").select("asset", (1.06 * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"), "n", (F.round(ratio(F.col("r") - F.col("m"), "s") * 200) / 200).alias("z"))
    q = z.groupBy("asset", "bw", "n", "z").agg(F.count("*").alias("k")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(511))))
    far = -5 + F.col("i") * 10 / 511.0 - F.col("z")
    bell = F.col("k") * F.exp(-far * far / (2 * F.col("bw") ** 2))
    norm = F.first("n") * F.first("bw") * float(np.sqrt(2 * np.pi))
    p = q.groupBy("asset", "i").agg((F.sum(bell) / norm).alias("p"), (F.sum(-far / F.col("bw") ** 2 * bell) / norm).alias("dp"))
    f = F.col("dp") ** 2 / F.greatest("p", F.lit(1e-12)) * F.when(F.col("i").isin(0, 511), 0.5).otherwise(1.0) * 10 / 511.0
    return p.groupBy("asset").agg(F.round(F.sum(f), 5).alias("fisher"), F.round(F.sum(f) - 1, 5).alias("excess"))


@query(f"""WITH {RET_SQL}, f AS (SELECT asset, d, 100 * r AS y, 100 * lag(r) {W}) AS a, 100 * avg(r) {W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b FROM r), g AS (SELECT * FROM f WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
e AS (SELECT asset, d, a, b, greatest(sqrt(avg((y - a) * (y - a)) {W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)), 0.5) AS ea, greatest(sqrt(avg((y - b) * (y - b)) {W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)), 0.5) AS eb FROM g), w AS (SELECT *, coalesce((1 / (ea + 1e-10)) / (1 / (ea + 1e-10) + 1 / (eb + 1e-10)), 0.5) AS w FROM e)
SELECT asset, d, round(w, 8) AS w, round(w * a + (1 - w) * b, 6) AS blend FROM w""", text=D)
def adaptive_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two forecasts weighted by their inverse errors over the last ten rows, errors floored at a half."""
    w = S.over("asset", "d")
    g = _returns(spark, sf_dir).select("asset", "d", (100 * F.col("r")).alias("y"), (100 * F.lag("r").over(w)).alias("a"), (100 * F.avg("r").over(w.rowsBetween(-5, -1))).alias("b")).dropna()
    error = lambda c: F.greatest(F.sqrt(F.avg((F.col("y") - F.col(c)) ** 2).over(w.rowsBetween(-10, -1))), F.lit(0.5))
    known = F.count("y").over(w.rowsBetween(-10, -1)) > 0
    e = g.select("asset", "d", "a", "b", (1 / (error("a") + 1e-10)).alias("ia"), (1 / (error("b") + 1e-10)).alias("ib"), known.alias("known"))
    e = e.withColumn("w", F.col("ia") / (F.col("ia") + F.col("ib")))
    return e.select("asset", "d", F.round("w", 8).alias("w"), F.round(F.col("w") * F.col("a") + (1 - F.col("w")) * F.col("b"), 6).alias("blend"))


@query(f"""WITH {BARS_SQL}, s AS (SELECT asset, d, unnest(['close', 'volume', 'quote']) AS metric, unnest([close, volume, quote]) AS x FROM bars), z AS (SELECT asset, d, metric, (x - avg(x) OVER f) / nullif(stddev_samp(x) OVER f, 0) AS z, count(x) OVER f AS n FROM s WINDOW f AS (PARTITION BY asset, metric ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
p AS (SELECT asset, d, metric, round(z, 9) AS z, round(2 * (1 - ({_cdf('abs(z)')})), 12) AS p FROM z WHERE n >= 10 AND z IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY asset, d ORDER BY p, metric) AS i, count(*) OVER (PARTITION BY asset, d) AS m FROM p),
q AS (SELECT *, least(1, min(p * m / i) OVER (PARTITION BY asset, d ORDER BY i DESC)) AS q FROM k) SELECT asset, d, metric, round(z, 6) AS z, round(p, 9) AS p, round(q, 9) AS q, q < 0.05 AS drifted FROM q""", text=D)
def drift_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's metrics against their last thirty values: two-sided chances, false discoveries controlled over the day."""
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("x")) for c in ("close", "volume", "quote")]))
    s = bars(spark, sf_dir).select("asset", "d", each)
    f = Window.partitionBy("asset", "metric").orderBy("d").rowsBetween(-30, -1)
    z = s.select("asset", "d", "metric", ratio(F.col("x") - F.avg("x").over(f), F.stddev_samp("x").over(f)).alias("z"), F.count("x").over(f).alias("n")).where("n >= 10 AND z IS NOT NULL")
    p = z.select("asset", "d", "metric", F.round("z", 9).alias("z"), F.round(2 * (1 - S.normal_cdf(F.abs("z"))), 12).alias("p")).withColumn("day", F.struct("asset", "d"))
    q = ST.benjamini_hochberg(p, "day", "p", "metric")
    return q.select("asset", "d", "metric", F.round("z", 6).alias("z"), F.round("p", 9).alias("p"), F.round("q", 9).alias("q"), (F.col("q") < 0.05).alias("drifted"))


@query(f"""WITH {BARS_SQL}, q AS (SELECT asset, quantile_cont(volume, 0.25) AS a, quantile_cont(volume, 0.75) AS b FROM bars GROUP BY asset) SELECT bars.asset, d, volume, CASE WHEN volume > b THEN 'HIGH' ELSE 'LOW' END AS side FROM bars JOIN q ON bars.asset = q.asset WHERE volume > b + 1.5 * (b - a) OR volume < a - 1.5 * (b - a)""", text=D)
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values further than one and a half quartile distances from the quartiles."""
    b = bars(spark, sf_dir).select("asset", "d", "volume")
    q = b.groupBy("asset").agg(F.percentile("volume", F.lit(0.25)).alias("a"), F.percentile("volume", F.lit(0.75)).alias("b"))
    reach = 1.5 * (F.col("b") - F.col("a"))
    return b.join(q, "asset").where((F.col("volume") > F.col("b") + reach) | (F.col("volume") < F.col("a") - reach)).select("asset", "d", "volume", F.when(F.col("volume") > F.col("b"), "HIGH").otherwise("LOW").alias("side"))


@query(f"""WITH RECURSIVE {RET_SQL}, s AS (SELECT asset, d, least(greatest(0.5 + 0.2 * r, 0), 1) AS x, least(1, volume / 60) AS conf, row_number() {W}) AS i FROM r WHERE r IS NOT NULL), e AS (SELECT asset, d, i, x, conf, x AS base FROM s WHERE i = 1 UNION ALL SELECT s.asset, s.d, s.i, s.x, s.conf, 0.3 * s.x + 0.7 * e.base FROM e JOIN s ON s.asset = e.asset AND s.i = e.i + 1)
SELECT asset, d, round(base, 6) AS base, round(least(greatest(0.8 * (conf * x + (1 - conf) * base) + 0.2 * x, 0), 1), 6) AS corrected FROM e""", text=D)
def online_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading pulled to its exponential mean the less sure it is, damped by the risk of a turn."""
    x = clamp(0.5 + 0.2 * F.col("r"), 0.0, 1.0)
    s = _returns(spark, sf_dir).where("r IS NOT NULL").select("asset", "d", x.alias("x"), F.least(F.lit(1.0), F.col("volume") / 60).alias("conf"))

    def step(f: pd.DataFrame) -> pd.DataFrame:
        v, c = O.column(f, "x"), O.column(f, "conf")
        base = O.ema(v, 0.3)
        return pd.DataFrame({"asset": f["asset"], "d": f["d"], "base": base, "corrected": np.clip(0.8 * (c * v + (1 - c) * base) + 0.2 * v, 0, 1)})

    return rounded(O.fold(s, "asset", "d", step, "asset string, d date, base double, corrected double"))


# The centres of six regimes in five layers (la, lt, cs, fs, pf), and the chances of going from one to another.
CENTRES = np.array([[75, 80, 20, 20, 45], [75, 30, 35, 30, 65], [35, 25, 75, 75, 60], [25, 15, 85, 85, 85], [55, 60, 45, 40, 25], [65, 70, 25, 25, 40]], float)
MOVES = np.array([
    [0.82, 0.10, 0.03, 0.01, 0.01, 0.03], [0.08, 0.76, 0.10, 0.02, 0.01, 0.03], [0.01, 0.04, 0.75, 0.12, 0.07, 0.01],
    [0.005, 0.005, 0.14, 0.68, 0.16, 0.01], [0.10, 0.04, 0.05, 0.02, 0.69, 0.10], [0.08, 0.08, 0.03, 0.01, 0.01, 0.79],
])


def regime_filter(x: np.ndarray, refit: int = 21, window: int = 252, fs: int = 3) -> np.ndarray:
    """Chances of the six regimes, row by row: distances to their centres (covariance refitted on the rows before), a softmax,
    the chances of the row before as prior, and a breaker when the fourth layer stays above 85."""
    out = np.full((len(x), len(CENTRES)), np.nan)
    for i in range(window, len(x)):
        if (i - window) % refit == 0:
            train = x[i - window : i]
            mean, sd = train.mean(axis=0), train.std(axis=0)
            sd = np.where(sd == 0, 1.0, sd)
            z = (train - mean) / sd
            cov = np.cov(z.T, bias=True)
            inverse = np.linalg.pinv(0.9 * cov + 0.1 * np.trace(cov) / len(cov) * np.eye(len(cov)))  # shrunk to its mean variance
            centres = (CENTRES - mean) / sd
            gaps = z[::10, None, :] - centres
            heat = max(float(np.median(np.sqrt(np.einsum("nki,ij,nkj->nk", gaps, inverse, gaps)))), 1e-6)
        gap = (x[i] - mean) / sd - centres
        p = np.exp(-np.sqrt(np.einsum("ki,ij,kj->k", gap, inverse, gap)) / heat)
        p /= p.sum()
        if i > window:
            p = p * (MOVES.T @ out[i - 1])
            p /= p.sum()
        if x[i, fs] > 85 and x[i - 1, fs] > 85 and (bad := p[2] + p[3]) < 0.70:
            p[2:4] *= 0.70 / max(bad, 1e-9)
            p[[0, 1, 4, 5]] *= 0.30 / max(1 - bad, 1e-9)
            p /= p.sum()
        out[i] = p
    return out


@query()
def regime_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regime of each day and how undecided it is (entropy over its maximum)."""

    def step(f: pd.DataFrame) -> pd.DataFrame:
        p = regime_filter(f[["la", "lt", "cs", "fs", "pf"]].to_numpy(float))
        ok = ~np.isnan(p[:, 0])
        q = np.clip(p[ok], 1e-12, 1)
        return pd.DataFrame({"asset": f["asset"][ok], "d": f["d"][ok], "regime": q.argmax(axis=1), "p_crisis": q[:, 2] + q[:, 3], "entropy": -(q * np.log(q)).sum(axis=1) / np.log(6)})

    return O.fold(_layers(spark, sf_dir), "asset", "d", step, "asset string, d date, regime int, p_crisis double, entropy double")
