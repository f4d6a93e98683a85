"""Window features over daily bars of each asset."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import corr, ratio, rounded
from ..operators import folds as O
from ..operators import series as S
from ..sources.tables import BARS_SQL, bars
from .registry import query

D = ("d",)
W = "OVER (PARTITION BY asset ORDER BY d"


def _bars(spark, sf_dir):
    return bars(spark, sf_dir), S.over("asset", "d")


def _frame(expr: str, n: int, x: str, least: int | None = None) -> str:
    """SQL of an aggregate over the last n rows, null until least values are there."""
    f = f"{W} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {f} >= {n if least is None else least} THEN {expr} {f} END"


@query(f"""WITH {BARS_SQL} SELECT asset, d, round(close / lag(close) {W}) - 1, 9) AS ret, round(ln(close) - ln(lag(close) {W})), 9) AS log_ret,
  round(close / lag(close, 7) {W}) - 1, 9) AS ret_7, close - lag(close) {W}) AS diff FROM bars""", text=D)
def returns_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w = _bars(spark, sf_dir)
    return b.select("asset", "d", F.round(S.pct_change("close", w), 9).alias("ret"), F.round(S.log_return("close", w), 9).alias("log_ret"), F.round(S.pct_change("close", w, 7), 9).alias("ret_7"), (F.col("close") - F.lag("close").over(w)).alias("diff"))


@query(f"""WITH {BARS_SQL} SELECT asset, d, round(lead(close, 7) {W}) / close - 1, 9) AS fwd_7, round(ln(lead(close, 30) {W})) - ln(close), 9) AS fwd_log_30 FROM bars""", text=D)
def forward_return_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w = _bars(spark, sf_dir)
    return b.select("asset", "d", F.round(S.forward_return("close", w, 7), 9).alias("fwd_7"), F.round(F.ln(F.lead("close", 30).over(w)) - F.ln("close"), 9).alias("fwd_log_30"))


@query(f"""WITH {BARS_SQL} SELECT asset, d, round({_frame('avg(close)', 30, 'close')}, 6) AS mean_30, round({_frame('sum(volume)', 30, 'volume')}, 6) AS sum_30,
  {_frame('min(low)', 30, 'low')} AS min_30, {_frame('max(high)', 30, 'high')} AS max_30 FROM bars""", text=D)
def rolling_mean_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w = _bars(spark, sf_dir)
    return b.select("asset", "d", F.round(S.rolling(F.avg, "close", w, 30), 6).alias("mean_30"), F.round(S.rolling(F.sum, "volume", w, 30), 6).alias("sum_30"), S.rolling(F.min, "low", w, 30).alias("min_30"), S.rolling(F.max, "high", w, 30).alias("max_30"))


@query(f"""WITH {BARS_SQL} SELECT asset, d, round({_frame('stddev_samp(close)', 30, 'close')}, 4) AS std_30, round({_frame('stddev_pop(close)', 90, 'close')}, 4) AS pop_90 FROM bars""", text=D)
def rolling_std_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w = _bars(spark, sf_dir)
    return b.select("asset", "d", F.round(S.rolling(F.stddev_samp, "close", w, 30), 4).alias("std_30"), F.round(S.rolling(F.stddev_pop, "close", w, 90), 4).alias("pop_90"))


@query(f"""WITH {BARS_SQL} SELECT asset, d, round(CASE WHEN count(close) {W}) >= 30 THEN (close - avg(close) {W})) / nullif(stddev_samp(close) {W}), 0) END, 6) AS z FROM bars""", text=D)
def expanding_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w = _bars(spark, sf_dir)
    return b.select("asset", "d", F.round(S.expanding_z("close", w), 6).alias("z"))


@query(f"""WITH {BARS_SQL} SELECT asset, d, round(CASE WHEN count(close) {W} ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) >= 60 THEN
  (close - avg(close) {W} ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING)) / nullif(stddev_pop(close) {W} ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING), 0) END, 6) AS z FROM bars""", text=D)
def trailing_z_excl(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w = _bars(spark, sf_dir)
    return b.select("asset", "d", F.round(S.trailing_z("close", w, 90, 60), 6).alias("z"))


@query(f"""WITH {BARS_SQL}, m AS (SELECT asset, d, close, quantile_cont(close, 0.5) {W} ROWS 119 PRECEDING) AS med, list(close) {W} ROWS 119 PRECEDING) AS held FROM bars)
SELECT asset, d, round(CASE WHEN len(held) >= 60 THEN (close - med) / nullif(1.4826 * list_aggregate(list_transform(held, lambda v: abs(v - med)), 'median'), 0) END, 6) AS z FROM m""", text=D)
def robust_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.robust_z(bars(spark, sf_dir), "close", "z", "asset", "d", 120, 60).select("asset", "d", F.round("z", 6).alias("z"))


@query(f"""WITH {BARS_SQL}, m AS (SELECT asset, d, close, list(close) {W} ROWS 119 PRECEDING) AS held FROM bars)
SELECT asset, d, round(CASE WHEN len(held) >= 60 THEN (len(list_filter(held, lambda v: v < close)) + (len(list_filter(held, lambda v: v = close)) + 1) / 2) / len(held) END, 9) AS r FROM m""", text=D)
def pct_rank_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w = _bars(spark, sf_dir)
    return b.select("asset", "d", F.round(S.rolling_rank("close", w, 120, 60), 9).alias("r"))


@query(f"""WITH {BARS_SQL} SELECT asset, d, round(CASE WHEN count(close) {W} ROWS 119 PRECEDING) >= 60 THEN quantile_cont(close, 0.75) {W} ROWS 119 PRECEDING) END, 6) AS q75 FROM bars""", text=D)
def rolling_quantile_75(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w = _bars(spark, sf_dir)
    return b.select("asset", "d", F.round(S.rolling_quantile("close", w, 120, 0.75, 60), 6).alias("q75"))


@query(f"""WITH {BARS_SQL} SELECT asset, d, round(CASE WHEN count(*) {W} ROWS 59 PRECEDING) >= 60 THEN corr(close, volume) {W} ROWS 59 PRECEDING) END, 6) AS c FROM bars""", text=D)
def rolling_corr_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w = _bars(spark, sf_dir)
    f = w.rowsBetween(-59, 0)
    return b.select("asset", "d", F.round(F.when(F.count("*").over(f) >= 60, corr("close", "volume", f)), 6).alias("c"))


@query(f"""WITH {BARS_SQL}, r AS (SELECT asset, d, ln(close) - ln(lag(close) {W})) AS r FROM bars)
SELECT asset, d, round(CASE WHEN count(r) {W} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) = 20 THEN stddev_samp(r) {W} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) END, 6) AS fwd_vol FROM r""", text=D)
def forward_vol_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w = _bars(spark, sf_dir)
    r = b.withColumn("r", S.log_return("close", w))
    f = w.rowsBetween(1, 20)
    return r.select("asset", "d", F.round(F.when(F.count("r").over(f) == 20, F.stddev_samp("r").over(f)), 6).alias("fwd_vol"))


@query(f"""WITH {BARS_SQL}, m AS (SELECT asset, d, close, list(close) {W}) AS held FROM bars)
SELECT asset, d, round(CASE WHEN len(held) >= 60 THEN len(list_filter(held, lambda v: v <= close)) / len(held) END, 9) AS p FROM m""", text=D)
def expanding_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all values so far at or under this one, from a sorted list that grows by a value a row."""

    def step(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"asset": f["asset"], "d": f["d"], "p": O.expanding_share(O.column(f, "close"), 60)})

    return O.fold(bars(spark, sf_dir).select("asset", "d", "close"), "asset", "d", step, "asset string, d date, p double").select("asset", "d", F.round(F.nanvl("p", F.lit(None)), 9).alias("p"))


@query(f"""WITH {BARS_SQL}, m AS (SELECT asset, d, volume, list(volume) {W} ROWS BETWEEN 365 PRECEDING AND 1 PRECEDING) AS held FROM bars)
SELECT asset, d, round(len(list_filter(held, lambda v: v < volume)) / nullif(len(held), 0), 9) AS p FROM m""", text=D)
def percentile_365(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the last 365 values strictly under this one."""
    b, w = _bars(spark, sf_dir)
    held = F.collect_list("volume").over(w.rowsBetween(-365, -1))
    return b.select("asset", "d", F.round(ratio(F.size(F.filter(held, lambda v: v < F.col("volume"))), F.size(held)), 9).alias("p"))


@query(f"""WITH {BARS_SQL} SELECT asset, d, round(CASE WHEN count(volume) {W} ROWS 29 PRECEDING) >= 7 THEN avg(volume) {W} ROWS 29 PRECEDING) END, 6) AS sma FROM bars""", text=D)
def sma_30_min_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w = _bars(spark, sf_dir)
    return b.select("asset", "d", F.round(S.rolling(F.avg, "volume", w, 30, 7), 6).alias("sma"))


@query(f"""WITH {BARS_SQL} SELECT asset, d, round(close / max(close) {W}) - 1, 9) AS dd, round(close / max(close) {W} ROWS 89 PRECEDING) - 1, 9) AS dd_90 FROM bars""", text=D)
def drawdown_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w = _bars(spark, sf_dir)
    return b.select("asset", "d", F.round(S.drawdown("close", w), 9).alias("dd"), F.round(ratio("close", F.max("close").over(w.rowsBetween(-89, 0))) - 1, 9).alias("dd_90"))


@query(f"""WITH {BARS_SQL}, x AS (SELECT asset, d, volume, close - lag(close) {W}) AS c FROM bars)
SELECT asset, d, sum(CASE WHEN c > 0 THEN volume WHEN c < 0 THEN -volume ELSE 0 END) {W}) AS obv FROM x""", text=D)
def on_balance_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w = _bars(spark, sf_dir)
    x = b.withColumn("c", F.col("close") - F.lag("close").over(w))
    signed = F.when(F.col("c") > 0, F.col("volume")).when(F.col("c") < 0, -F.col("volume")).otherwise(0.0)
    return x.select("asset", "d", F.sum(signed).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("obv"))


@query(f"""WITH {BARS_SQL}, x AS (SELECT *, lag(close) {W}) AS pc FROM bars),
t AS (SELECT asset, d, close, high, low, volume, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, (high + low + close) / 3 AS tp,
  CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END AS mult FROM x)
SELECT asset, d, round({_frame('avg(tr)', 14, 'tr')}, 4) AS atr, round({_frame('avg(close)', 20, 'close')} + 2 * {_frame('stddev_pop(close)', 20, 'close')}, 4) AS upper,
  round({_frame('avg(close)', 20, 'close')} - 2 * {_frame('stddev_pop(close)', 20, 'close')}, 4) AS lower,
  round({_frame('sum(mult * volume)', 20, 'volume')} / nullif({_frame('sum(volume)', 20, 'volume')}, 0), 6) AS cmf,
  round({_frame('sum(tp * volume)', 14, 'volume')} / nullif({_frame('sum(volume)', 14, 'volume')}, 0), 4) AS vwap FROM t""", text=D)
def technical_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ATR, Bollinger bands, Chaikin money flow and VWAP."""
    b, w = _bars(spark, sf_dir)
    pc = F.lag("close").over(w)
    spread = F.col("high") - F.col("low")
    t = b.withColumn("tr", F.when(pc.isNull(), spread).otherwise(F.greatest(spread, F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))))
    t = t.withColumn("tpv", (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume"))
    t = t.withColumn("mfv", F.coalesce(F.when(spread > 0, ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / spread), F.lit(0.0)) * F.col("volume"))
    mean, sd = S.rolling(F.avg, "close", w, 20), S.rolling(F.stddev_pop, "close", w, 20)
    vol = lambda n: S.rolling(F.sum, "volume", w, n)
    return t.select("asset", "d", F.round(S.rolling(F.avg, "tr", w, 14), 4).alias("atr"), F.round(mean + 2 * sd, 4).alias("upper"), F.round(mean - 2 * sd, 4).alias("lower"), F.round(ratio(S.rolling(F.sum, "mfv", w, 20), vol(20)), 6).alias("cmf"), F.round(ratio(S.rolling(F.sum, "tpv", w, 14), vol(14)), 4).alias("vwap"))


@query(f"""WITH {BARS_SQL}, x AS (SELECT asset, d, pow(ln(high / low), 2) AS hl, pow(ln(close / open), 2) AS co,
  ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs, ln(close) - ln(lag(close) {W})) AS r FROM bars)
SELECT asset, d, round(sqrt({_frame('avg(hl)', 30, 'hl')} / (4 * ln(2))), 6) AS parkinson, round({_frame('avg(0.5 * hl - (2 * ln(2) - 1) * co)', 30, 'hl')}, 6) AS garman_klass,
  round({_frame('avg(rs)', 30, 'rs')}, 6) AS rogers_satchell, round(sqrt({_frame('avg(CASE WHEN r < 0 THEN r * r ELSE 0 END)', 30, 'd')}), 6) AS semidev FROM x""", text=D)
def range_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility from ranges: Parkinson, Garman-Klass, Rogers-Satchell, and the downside deviation."""
    b, w = _bars(spark, sf_dir)
    ln = lambda a, c: F.ln(F.col(a) / F.col(c))
    x = b.withColumns({"hl": F.pow(ln("high", "low"), F.lit(2)), "co": F.pow(ln("close", "open"), F.lit(2)), "rs": ln("high", "close") * ln("high", "open") + ln("low", "close") * ln("low", "open"), "r": S.log_return("close", w)})
    k = 2 * 0.6931471805599453
    x = x.withColumn("gk", 0.5 * F.col("hl") - (k - 1) * F.col("co")).withColumn("down", F.when(F.col("r") < 0, F.col("r") * F.col("r")).otherwise(0.0))
    return x.select("asset", "d", F.round(F.sqrt(S.rolling(F.avg, "hl", w, 30) / (2 * k)), 6).alias("parkinson"), F.round(S.rolling(F.avg, "gk", w, 30), 6).alias("garman_klass"), F.round(S.rolling(F.avg, "rs", w, 30), 6).alias("rogers_satchell"), F.round(F.sqrt(S.rolling(F.avg, "down", w, 30)), 6).alias("semidev"))


@query(f"""WITH {BARS_SQL}, x AS (SELECT asset, d, abs(close / lag(close) {W}) - 1) / quote AS illiq, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS loc, volume FROM bars)
SELECT asset, d, round({_frame('quantile_cont(illiq, 0.5)', 20, 'illiq')}, 12) AS amihud, round({_frame('avg(loc)', 20, 'loc')}, 6) AS close_location,
  round({_frame('max(volume)', 20, 'volume')} / nullif({_frame('sum(volume)', 20, 'volume')}, 0), 9) AS concentration FROM x""", text=D)
def liquidity_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median illiquidity, where closes lie in their ranges, and how much of the volume fell on one day."""
    b, w = _bars(spark, sf_dir)
    x = b.withColumn("illiq", ratio(F.abs(S.pct_change("close", w)), "quote"))
    x = x.withColumn("loc", F.coalesce(F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))), F.lit(0.5)))
    return x.select("asset", "d", F.round(S.rolling_quantile("illiq", w, 20, 0.5, 20), 12).alias("amihud"), F.round(S.rolling(F.avg, "loc", w, 20), 6).alias("close_location"), F.round(ratio(S.rolling(F.max, "volume", w, 20), S.rolling(F.sum, "volume", w, 20)), 9).alias("concentration"))


@query(f"""WITH {BARS_SQL}, x AS (SELECT asset, d, volume AS v, avg(volume) {W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS m,
  greatest(stddev_pop(volume) {W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0.5) AS s, count(volume) {W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS n FROM bars)
SELECT asset, d, round(CASE WHEN n >= 5 AND abs((v - m) / s) > 4 THEN m + 0.3 * (v - m) ELSE v END, 6) AS guarded, coalesce(n >= 5 AND abs((v - m) / s) > 4, false) AS damped FROM x""", text=D)
def outlier_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values more than four deviations off the last ten are damped; the history keeps the raw value."""
    b, w = _bars(spark, sf_dir)
    f = w.rowsBetween(-10, -1)
    x = b.select("asset", "d", F.col("volume").alias("v"), F.avg("volume").over(f).alias("m"), F.greatest(F.stddev_pop("volume").over(f), F.lit(0.5)).alias("s"), F.count("volume").over(f).alias("n"))
    off = F.coalesce((F.col("n") >= 5) & (F.abs((F.col("v") - F.col("m")) / F.col("s")) > 4), F.lit(False))
    return x.select("asset", "d", F.round(F.when(off, F.col("m") + 0.3 * (F.col("v") - F.col("m"))).otherwise(F.col("v")), 6).alias("guarded"), off.alias("damped"))


@query(f"""WITH {BARS_SQL}, x AS (SELECT asset, d, close > avg(close) {W} ROWS 29 PRECEDING) AS up, count(*) {W}) AS n FROM bars), f AS (SELECT *, lag(up) {W}) AS was FROM x WHERE n >= 30)
SELECT asset, d, CASE WHEN up THEN 'BULL' ELSE 'BEAR' END AS state, was IS NOT NULL AND up <> was AS changed FROM f""", text=D)
def change_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Above or below the 30-row mean, and whether that changed: an alert fires on the change only."""
    b, w = _bars(spark, sf_dir)
    x = b.select("asset", "d", (F.col("close") > F.avg("close").over(w.rowsBetween(-29, 0))).alias("up"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n")).where("n >= 30")
    was = F.lag("up").over(w)
    return x.select("asset", "d", F.when(F.col("up"), "BULL").otherwise("BEAR").alias("state"), (was.isNotNull() & (F.col("up") != was)).alias("changed"))


@query(f"""WITH {BARS_SQL}, x AS (SELECT asset, d, quote - lag(quote) {W}) AS l FROM bars), y AS (SELECT asset, d, l, CASE WHEN count(l) {W} ROWS 11 PRECEDING) >= 12 THEN
  (l - avg(l) {W} ROWS 11 PRECEDING)) / nullif(stddev_pop(l) {W} ROWS 11 PRECEDING), 0) END AS li FROM x)
SELECT asset, d, round(l, 2) AS l, round(li, 6) AS li, round(li - lag(li) {W}), 6) AS la FROM y""", text=D)
def impulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First difference, its z over twelve rows, and the difference of that."""
    b, w = _bars(spark, sf_dir)
    f = w.rowsBetween(-11, 0)
    x = b.withColumn("l", F.col("quote") - F.lag("quote").over(w))
    x = x.withColumn("li", S.full(ratio(F.col("l") - F.avg("l").over(f), F.stddev_pop("l").over(f)), "l", f, 12))
    return x.select("asset", "d", F.round("l", 2).alias("l"), F.round("li", 6).alias("li"), F.round(F.col("li") - F.lag("li").over(w), 6).alias("la"))


@query(f"""WITH {BARS_SQL}, x AS (SELECT asset, d, close, list(close) {W} ROWS 29 PRECEDING) AS seq, lead(close, 1) {W}) AS y1, lead(close, 3) {W}) AS y3, lead(close, 6) {W}) AS y6 FROM bars)
SELECT asset, d, len(seq) AS n, round(list_sum(seq), 4) AS total, y1, y3, y6 FROM x WHERE len(seq) = 30 AND y6 IS NOT NULL""", text=D)
def ml_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of thirty rows with targets 1, 3 and 6 rows ahead."""
    b, w = _bars(spark, sf_dir)
    x = b.select("asset", "d", F.collect_list("close").over(w.rowsBetween(-29, 0)).alias("seq"), *[F.lead("close", h).over(w).alias(f"y{h}") for h in (1, 3, 6)])
    total = F.aggregate("seq", F.lit(0.0), lambda a, v: a + v)
    return x.where((F.size("seq") == 30) & F.col("y6").isNotNull()).select("asset", "d", F.size("seq").alias("n"), F.round(total, 4).alias("total"), "y1", "y3", "y6")


@query(f"""WITH {BARS_SQL} SELECT asset, d, ntile(10) {W.replace('ORDER BY d', 'ORDER BY close, d')}) AS decile, round(close / lag(close, 12) {W}) - 1, 9) AS yoy_obs FROM bars""", text=D)
def decile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deciles with the remainder in the first ones, and the change over twelve observations."""
    b, w = _bars(spark, sf_dir)
    return b.select("asset", "d", F.ntile(10).over(Window.partitionBy("asset").orderBy("close", "d")).alias("decile"), F.round(S.pct_change("close", w, 12), 9).alias("yoy_obs"))


@query(f"""WITH {BARS_SQL}, s AS (SELECT *, row_number() {W}) - 1 AS i FROM bars) SELECT asset, d, close FROM s WHERE i % 5 = 0""", text=D)
def every_fifth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth row of each series: sampling is the feature."""
    b, w = _bars(spark, sf_dir)
    return b.withColumn("i", F.row_number().over(w) - 1).where("i % 5 = 0").select("asset", "d", "close")


@query(f"""WITH {BARS_SQL}, k AS (SELECT asset, d, close - lag(close) {W}) AS x, row_number() {W}) AS i FROM bars) SELECT asset, round(coalesce(100 - 100 / (1 + avg(greatest(x, 0)) / nullif(avg(greatest(-x, 0)), 0)), 100), 6) AS rsi FROM k WHERE i BETWEEN 2 AND 15 GROUP BY asset""")
def rsi_first_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index from the means of the first fourteen changes only; 100 without a fall."""
    b, w = _bars(spark, sf_dir)
    k = b.select("asset", (F.col("close") - F.lag("close").over(w)).alias("x"), F.row_number().over(w).alias("i")).where("i BETWEEN 2 AND 15")
    return k.groupBy("asset").agg(F.round(F.coalesce(100 - 100 / (1 + ratio(F.avg(F.greatest("x", F.lit(0.0))), F.avg(F.greatest(-F.col("x"), F.lit(0.0))))), F.lit(100.0)), 6).alias("rsi"))


@query(f"""WITH {BARS_SQL}, l AS (SELECT asset, d, close AS x0, lag(close, 3) {W}) AS x1, lag(close, 6) {W}) AS x2 FROM bars) SELECT asset, d, round(x0, 6) AS x0, round(x1, 6) AS x1, round(x2, 6) AS x2 FROM l WHERE x2 IS NOT NULL""", text=D)
def delay_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value with those three and six rows before: points of a delay embedding."""
    b, w = _bars(spark, sf_dir)
    return b.select("asset", "d", F.round("close", 6).alias("x0"), *[F.round(F.lag("close", 3 * k).over(w), 6).alias(f"x{k}") for k in (1, 2)]).where("x2 IS NOT NULL")


@query(f"""WITH {BARS_SQL}, r AS (SELECT asset, d, unnest(['close/quote', 'close/volume', 'quote/volume']) AS pair, unnest([corr(close, quote) {W} ROWS 59 PRECEDING), corr(close, volume) {W} ROWS 59 PRECEDING), corr(quote, volume) {W} ROWS 59 PRECEDING)]) AS c, count(*) {W} ROWS 59 PRECEDING) AS n FROM bars)
SELECT asset, d, pair, round(c, 6) AS c FROM r WHERE n >= 60""", text=D)
def rolling_corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a few series' rolling correlations, over one window."""
    b, w = _bars(spark, sf_dir)
    f = w.rowsBetween(-59, 0)
    pairs = [("close", "quote"), ("close", "volume"), ("quote", "volume")]
    c = b.select("asset", "d", F.count("*").over(f).alias("n"), *[corr(x, y, f).alias(f"{x}/{y}") for x, y in pairs]).where("n >= 60")
    return c.select("asset", "d", F.inline(F.array(*[F.struct(F.lit(f"{x}/{y}").alias("pair"), F.round(F.col(f"{x}/{y}"), 6).alias("c")) for x, y in pairs])))


@query(f"""WITH {BARS_SQL}, r AS (SELECT asset, d, close / lag(close, 90) {W}) - 1 AS r90 FROM bars), z AS (SELECT asset, d, count(r90) {W}) AS n, (r90 - avg(r90) {W})) / nullif(stddev_samp(r90) {W}), 0) AS z FROM r)
SELECT asset, d, round(z, 6) AS z, CASE WHEN z > 1 THEN 'EXPANDING' WHEN z < -1 THEN 'SHRINKING' ELSE 'STEADY' END AS state FROM z WHERE n >= 30 AND z IS NOT NULL""", text=D)
def momentum_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change over ninety rows against all changes so far."""
    b, w = _bars(spark, sf_dir)
    r = b.select("asset", "d", S.pct_change("close", w, 90).alias("r90"))
    z = r.select("asset", "d", S.expanding_z("r90", w, 30).alias("z")).where("z IS NOT NULL")
    return z.select("asset", "d", F.round("z", 6).alias("z"), F.when(F.col("z") > 1, "EXPANDING").when(F.col("z") < -1, "SHRINKING").otherwise("STEADY").alias("state"))
