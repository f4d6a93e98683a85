"""Recursive filters over daily bars; the twins are recursive SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds as O  # noqa: E741, N812
from ..operators import series as S
from ..sources.tables import BARS_SQL, bars
from .registry import query

D = ("d",)
_S = "s AS (SELECT asset, d, close, row_number() OVER (PARTITION BY asset ORDER BY d) AS i FROM bars)"
_R = "r0 AS (SELECT asset, d, ln(close) - ln(lag(close) OVER (PARTITION BY asset ORDER BY d)) AS r FROM bars), s AS (SELECT asset, d, r, row_number() OVER (PARTITION BY asset ORDER BY d) AS i FROM r0 WHERE r IS NOT NULL)"


def _closes(spark, sf_dir) -> DataFrame:
    return bars(spark, sf_dir).select("asset", "d", "close")


def _returns(spark, sf_dir) -> DataFrame:
    return bars(spark, sf_dir).select("asset", "d", S.log_return("close", S.over("asset", "d")).alias("r")).where("r IS NOT NULL")


@query(f"""WITH RECURSIVE {BARS_SQL}, {_S}, e AS (SELECT asset, d, i, close AS f, close AS s FROM s WHERE i = 1 UNION ALL
SELECT s.asset, s.d, s.i, 2.0 / 13 * s.close + (1 - 2.0 / 13) * e.f, 2.0 / 27 * s.close + (1 - 2.0 / 27) * e.s FROM e JOIN s ON s.asset = e.asset AND s.i = e.i + 1)
SELECT asset, d, round(f, 4) AS ema_12, round(s, 4) AS ema_26, round(f - s, 4) AS macd FROM e""", text=D)
def ema_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exponential means and their difference."""

    def step(f: pd.DataFrame) -> pd.DataFrame:
        fast, slow = O.ema(O.column(f, "close"), 2 / 13), O.ema(O.column(f, "close"), 2 / 27)
        return pd.DataFrame({"asset": f["asset"], "d": f["d"], "ema_12": fast, "ema_26": slow, "macd": fast - slow})

    out = O.fold(_closes(spark, sf_dir), "asset", "d", step, "asset string, d date, ema_12 double, ema_26 double, macd double")
    return out.select("asset", "d", *[F.round(c, 4).alias(c) for c in ("ema_12", "ema_26", "macd")])


@query(f"""WITH RECURSIVE {BARS_SQL}, {_S}, c AS (SELECT asset, d, i, close - lag(close) OVER (PARTITION BY asset ORDER BY d) AS x FROM s),
b AS (SELECT asset, avg(greatest(x, 0)) AS g, avg(greatest(-x, 0)) AS l FROM c WHERE i BETWEEN 2 AND 15 GROUP BY asset),
w AS (SELECT c.asset, c.d, c.i, b.g, b.l FROM c JOIN b ON c.asset = b.asset WHERE i = 15 UNION ALL
SELECT c.asset, c.d, c.i, (w.g * 13 + greatest(c.x, 0)) / 14, (w.l * 13 + greatest(-c.x, 0)) / 14 FROM w JOIN c ON c.asset = w.asset AND c.i = w.i + 1)
SELECT asset, d, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi FROM w""", text=D)
def rsi_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"asset": f["asset"], "d": f["d"], "rsi": O.rsi_wilder(O.column(f, "close"))}).dropna()

    return O.fold(_closes(spark, sf_dir), "asset", "d", step, "asset string, d date, rsi double").withColumn("rsi", F.round("rsi", 6))


@query(f"""WITH RECURSIVE {BARS_SQL}, {_S}, c AS (SELECT asset, d, i, close - lag(close) OVER (PARTITION BY asset ORDER BY d) AS x FROM s),
w AS (SELECT asset, d, i, greatest(x, 0) AS g, greatest(-x, 0) AS l FROM c WHERE i = 2 UNION ALL
SELECT c.asset, c.d, c.i, greatest(c.x, 0) / 14 + w.g * 13 / 14, greatest(-c.x, 0) / 14 + w.l * 13 / 14 FROM w JOIN c ON c.asset = w.asset AND c.i = w.i + 1)
SELECT asset, d, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi FROM w""", text=D)
def rsi_ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"asset": f["asset"], "d": f["d"], "rsi": O.rsi_ewm(O.column(f, "close"))}).dropna()

    return O.fold(_closes(spark, sf_dir), "asset", "d", step, "asset string, d date, rsi double").withColumn("rsi", F.round("rsi", 6))


@query(f"""WITH RECURSIVE {BARS_SQL}, {_R}, v AS (SELECT asset, var_pop(r) AS v FROM s GROUP BY asset), g AS (SELECT s.asset, s.d, s.i, s.r, v.v FROM s JOIN v ON s.asset = v.asset WHERE i = 1 UNION ALL
SELECT s.asset, s.d, s.i, s.r, 0.00001 + 0.05 * g.r * g.r + 0.94 * g.v FROM g JOIN s ON s.asset = g.asset AND s.i = g.i + 1) SELECT asset, d, round(v, 9) AS variance FROM g""", text=D)
def garch_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"asset": f["asset"], "d": f["d"], "variance": O.garch(O.column(f, "r"))})

    return O.fold(_returns(spark, sf_dir), "asset", "d", step, "asset string, d date, variance double").withColumn("variance", F.round("variance", 9))


@query(f"""WITH RECURSIVE {BARS_SQL}, {_R}, g AS (SELECT asset, d, i, CAST(NULL AS DOUBLE) AS z, r * r AS v FROM s WHERE i = 1 UNION ALL
SELECT s.asset, s.d, s.i, CASE WHEN g.v > 0 THEN s.r / sqrt(g.v) END, 0.94 * g.v + 0.06 * s.r * s.r FROM g JOIN s ON s.asset = g.asset AND s.i = g.i + 1) SELECT asset, d, round(z, 6) AS z FROM g WHERE z IS NOT NULL""", text=D)
def ewma_vol_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"asset": f["asset"], "d": f["d"], "z": O.ewma_z(O.column(f, "r"))}).dropna()

    return O.fold(_returns(spark, sf_dir), "asset", "d", step, "asset string, d date, z double").withColumn("z", F.round("z", 6))


@query(f"""WITH RECURSIVE {BARS_SQL}, {_R}, x AS (SELECT asset, d, i, CASE WHEN i % 7 = 3 THEN NULL ELSE r END AS x FROM s), k AS (SELECT asset, d, i, x AS level, CAST(1.0 AS DOUBLE) AS p FROM x WHERE i = 1 UNION ALL
SELECT x.asset, x.d, x.i, CASE WHEN x.x IS NULL THEN k.level ELSE k.level + (k.p + 0.001) / (k.p + 0.001 + 0.1) * (x.x - k.level) END,
  CASE WHEN x.x IS NULL THEN k.p + 0.001 ELSE (1 - (k.p + 0.001) / (k.p + 0.001 + 0.1)) * (k.p + 0.001) END FROM k JOIN x ON x.asset = k.asset AND x.i = k.i + 1) SELECT asset, d, round(level, 6) AS level FROM k""", text=D)
def kalman_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level filter that only predicts where a value is missing (every seventh here)."""

    def step(f: pd.DataFrame) -> pd.DataFrame:
        x = O.column(f, "r").copy()
        x[np.arange(1, len(x) + 1) % 7 == 3] = np.nan
        return pd.DataFrame({"asset": f["asset"], "d": f["d"], "level": O.kalman(x)})

    return O.fold(_returns(spark, sf_dir), "asset", "d", step, "asset string, d date, level double").withColumn("level", F.round("level", 6))


@query()
def event_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest volume days of each series, none within 120 rows of another."""

    def step(f: pd.DataFrame) -> pd.DataFrame:
        return f[O.episodes(O.column(f, "volume"), 10, 120)]

    return O.fold(bars(spark, sf_dir).select("asset", "d", "volume"), "asset", "d", step, "asset string, d date, volume double")


@query()
def hmm_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered probabilities of three hidden states."""

    def step(f: pd.DataFrame) -> pd.DataFrame:
        p = O.hmm_filter(np.clip(O.column(f, "r"), -3, 3))
        return pd.DataFrame({"asset": f["asset"], "d": f["d"], "p_up": p[:, 0], "p_mid": p[:, 1], "p_down": p[:, 2]})

    return O.fold(_returns(spark, sf_dir), "asset", "d", step, "asset string, d date, p_up double, p_mid double, p_down double")
