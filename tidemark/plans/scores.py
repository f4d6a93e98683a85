"""Scored composites over a wide daily frame made of the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as C
from ..functions.exprs import bucket, clamp, corr, decay, ratio, rounded, weighted_mean
from ..operators import series as S
from ..sources.tables import BARS_SQL, bars
from .registry import query

D = ("d",)
W = "OVER (PARTITION BY asset ORDER BY d"
WIDE_SQL = f"""{BARS_SQL}, wide AS (SELECT asset, d, close, volume, quote, n, 100 * (close / lag(close) {W}) - 1) / 10 AS chg, 40 + 30 * low / high AS dom, 0.5 + n / 20.0 AS pc,
  least(100, volume / 4) AS fng, 40 + 60 * (1 - low / high) AS dvol, 95 + n AS dxy, CASE WHEN count(*) {W} ROWS 59 PRECEDING) >= 2 THEN nullif(corr(close, volume) {W} ROWS 59 PRECEDING), 'nan'::DOUBLE) END AS c FROM bars)"""


def _wide(spark, sf_dir) -> DataFrame:
    """Stand-ins for the market inputs of the scores."""
    w = S.over("asset", "d")
    low_high = F.col("low") / F.col("high")
    return bars(spark, sf_dir).select(
        "asset", "d", "close", "volume", "quote", "n",
        (100 * (F.col("close") / F.lag("close").over(w) - 1) / 10).alias("chg"), (40 + 30 * low_high).alias("dom"), (0.5 + F.col("n") / 20.0).alias("pc"),
        F.least(F.lit(100.0), F.col("volume") / 4).alias("fng"), (40 + 60 * (1 - low_high)).alias("dvol"), (95 + F.col("n")).cast("double").alias("dxy"), F.when(F.count("*").over(w.rowsBetween(-59, 0)) >= 2, corr("close", "volume", w.rowsBetween(-59, 0))).alias("c"),
    )


_sq = lambda x, c, k: f"(6.0 / (1.0 + exp(-{k} * ({x} - {c}))) - 3.0)"
_cl = lambda x, a, b: f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {a}), {b}) END"
_F = f"""f AS (SELECT *, {_cl(_sq('chg', 0, 0.15), -3, 3)} AS lt, {_cl('-' + _sq('dom', 55, 0.2) + ' - ' + _sq('pc', 0.8, 2), -3, 3)} AS st, {_cl(_sq('fng', 50, 0.08), -3, 3)} AS rt, {_cl('-' + _sq('dvol', 65, 0.06), -3, 3)} AS ft,
  {_cl(f"(CASE WHEN c > 0.3 THEN {_sq('dxy', 100, 0.2)} WHEN c > -0.3 AND c <= 0.3 THEN -0.5 * {_sq('dxy', 100, 0.2)} ELSE -{_sq('dxy', 100, 0.2)} END - CASE WHEN dom > 65 AND (c IS NULL OR c < 0.3) THEN 0.5 ELSE 0 END)", -3, 3)} AS sc FROM wide)"""


@query(f"WITH {WIDE_SQL}, {_F} SELECT asset, d, round(lt, 6) AS lt, round(st, 6) AS st, round(rt, 6) AS rt, round(ft, 6) AS ft, round(sc, 6) AS sc FROM f", text=D)
def factor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five factors."""
    w = _wide(spark, sf_dir)
    return rounded(w.select("asset", "d", *[c.alias(k) for k, c in C.factors("chg", "dom", "pc", "fng", "dvol", "dxy", "c").items()]))


_B0, _B1 = C._logit_line()
_ks = ["lt", "st", "rt", "ft", "sc"]
_n = {k: f"({k} / 6)" for k in _ks}
_sum = " + ".join
_M = f"""m AS (SELECT *, ({_sum(f"(CASE WHEN {_n[k]} < -0.333 THEN 1.0 WHEN {_n[k]} < -0.167 THEN 0.7 WHEN {_n[k]} < 0 THEN 0.3 ELSE 0.0 END) / {C.FACTOR_RARITY[k]}" for k in _ks)}) / {sum(1 / r for r in C.FACTOR_RARITY.values())!r} AS m1,
  {_sum(f'{C.FACTOR_WEIGHTS[k]} * {k}' for k in _ks)} AS z, 0.08 / 0.92 * {' * '.join(f'CASE WHEN {_n[k]} < -0.3 THEN {C.BAYES_ODDS[k]} ELSE 1.0 END' for k in _ks)} AS odds,
  ({_sum(f'{C.EWC[k]} * abs({k})' for k in _ks)}) / 3 AS m4, ({_sum(_n.values())}) / 5 AS mean FROM f),
v AS (SELECT *, ({_sum(f'({_n[k]} - mean) * ({_n[k]} - mean)' for k in _ks)}) / 5 AS var, 1 / (1 + exp(-({_B0!r} + {_B1!r} * z))) AS m2, odds / (1 + odds) AS m3,
  CASE WHEN z <= -8 THEN 0.95 WHEN z <= -5 THEN 0.95 + (z + 8) * (0.75 - 0.95) / 3 WHEN z <= -3 THEN 0.75 + (z + 5) * (0.5 - 0.75) / 2 WHEN z <= -1.5 THEN 0.5 + (z + 3) * (0.25 - 0.5) / 1.5
    WHEN z <= -0.5 THEN 0.25 + (z + 1.5) * (0.1 - 0.25) WHEN z <= 0.5 THEN 0.1 + (z + 0.5) * (0.04 - 0.1) WHEN z <= 2 THEN 0.04 + (z - 0.5) * (0.01 - 0.04) / 1.5 WHEN z > 2 THEN 0.01 END AS m5 FROM m),
s AS (SELECT *, least(greatest(least(greatest(-mean * 0.72, 0), 0.5) + 0.15 * ({_sum(f'CAST({_n[k]} < -0.167 AS INTEGER)' for k in _ks)}) + 0.20 * ({_sum(f'CAST({_n[k]} < -0.333 AS INTEGER)' for k in _ks)})
  + CASE WHEN mean < -0.083 AND var < 0.12 THEN 0.10 * (1 - var) ELSE 0 END + 0.15 * CAST(ft / 6 < -0.25 AS INTEGER) + 0.10 * CAST(lt / 6 < -0.25 AS INTEGER), 0.01), 0.99) AS m6 FROM v WHERE lt IS NOT NULL),
b AS (SELECT *, {_sum(f'{w} * {k}' for k, w in C.BLEND.items())} AS score, (m1 + m2 + m3 + m4 + m5 + m6) / 6 AS mm FROM s)"""


@query(f"""WITH {WIDE_SQL}, {_F}, {_M} SELECT asset, d, round(m1, 6) AS m1, round(m2, 6) AS m2, round(m3, 6) AS m3, round(m4, 6) AS m4, round(m5, 6) AS m5, round(m6, 6) AS m6, round(score, 6) AS score,
  round(least(greatest(1 - sqrt(({_sum(f'(m{i} - mm) * (m{i} - mm)' for i in range(1, 7))}) / 6) / 0.20, 0), 1), 6) AS agreement, CASE WHEN score > 0.75 THEN 'CRITICAL' WHEN score > 0.5 THEN 'HIGH' WHEN score > 0.25 THEN 'ELEVATED' ELSE 'CALM' END AS zone FROM b""", text=D)
def ensemble_m1_m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six sub-models, their blend, agreement and zone."""
    w = _wide(spark, sf_dir)
    f = w.select("asset", "d", *[c.alias(k) for k, c in C.factors("chg", "dom", "pc", "fng", "dvol", "dxy", "c").items()]).where("lt IS NOT NULL")
    m = f.select("asset", "d", *[c.alias(k) for k, c in C.ensemble({k: k for k in C.FACTOR_WEIGHTS}).items()])
    return rounded(m.select("*", *[c.alias(k) for k, c in C.blend({k: k for k in C.BLEND}).items()]))


@query(f"""WITH {WIDE_SQL}, p AS (SELECT asset, d, CASE WHEN n % 3 = 0 THEN NULL ELSE fng / 100 END AS a, CASE WHEN n % 4 = 0 THEN NULL ELSE dvol / 100 END AS b, CASE WHEN n % 5 <> 0 THEN NULL ELSE dom / 100 END AS e FROM wide),
q AS (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE 0.3 END + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END + CASE WHEN e IS NULL THEN 0 ELSE 0.45 END AS held FROM p)
SELECT asset, d, round(CASE WHEN held >= 0.3 THEN (coalesce(a * 0.3, 0) + coalesce(b * 0.25, 0) + coalesce(e * 0.45, 0)) / nullif(held, 0) END, 6) AS s FROM q""", text=D)
def weighted_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing parts drop out and the weights are renormalised; too little cover gives null."""
    part = lambda on, x: F.when(on, F.col(x) / 100)
    p = _wide(spark, sf_dir).select("asset", "d", part(F.col("n") % 3 != 0, "fng").alias("a"), part(F.col("n") % 4 != 0, "dvol").alias("b"), part(F.col("n") % 5 == 0, "dom").alias("e"))
    return p.select("asset", "d", F.round(weighted_mean([("a", 0.3), ("b", 0.25), ("e", 0.45)], 0.3), 6).alias("s"))


@query(f"""WITH {WIDE_SQL}, p AS (SELECT asset, d, 0.30 AS wf, least(greatest((chg - 5.5) / 8, -3), 3) AS zf, least(greatest((fng / 10 - 6) / 4, -3), 3) AS zm, -least(greatest((dxy - 100) / 5, -2), 2) AS zd, chg FROM wide),
q AS (SELECT asset, d, least(greatest(55 + 17.5 * ((CASE WHEN chg IS NULL THEN 0 ELSE 0.30 * zf END + 0.15 * zm + 0.13 * zd) / (CASE WHEN chg IS NULL THEN 0 ELSE 0.30 END + 0.15 + 0.13)), 0), 100) AS level FROM p)
SELECT asset, d, round(level, 6) AS level, CASE WHEN level > 70 THEN 0.15 WHEN level > 55 THEN 0.30 WHEN level > 40 THEN 0.50 WHEN level > 25 THEN 0.70 ELSE 0.85 END AS stress FROM q""", text=D)
def liquidity_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth rates against fixed moments, weighted, on 0 to 100."""
    w = _wide(spark, sf_dir).withColumn("m2", F.col("fng") / 10)
    out = C.liquidity({"fed": "chg", "m2": "m2"}, "dxy")
    return rounded(w.select("asset", "d", *[c.alias(k) for k, c in out.items()]))


@query(f"""WITH {WIDE_SQL}, p AS (SELECT asset, d, dvol, fng AS sfc, coalesce(chg, 0) / 10 AS sent, n AS news FROM wide), q AS (SELECT asset, d,
  0.4 * least(dvol / 120, 1) + 0.3 * least(sfc / 60, 1) + CASE WHEN sent < -0.3 THEN 0.3 * least(abs(sent), 1) ELSE 0 END AS cap, 0.45 * least(greatest((dvol - 50) / 50, 0), 1) + 0.40 * least(sfc / 30, 1) + 0.15 * least(news / 20, 1) AS s0 FROM p),
r AS (SELECT asset, d, cap, least(s0, 1 - cap) AS s FROM q), t AS (SELECT *, greatest(0, 1 - cap - s) AS n FROM r)
SELECT asset, d, round(cap, 6) AS p_capitulation, round(s, 6) AS p_stress, round(n, 6) AS p_normal, CASE WHEN cap = greatest(cap, s, n) THEN 'CAPITULATION' WHEN s = greatest(cap, s, n) THEN 'STRESS' ELSE 'NORMAL' END AS regime FROM t""", text=D)
def regime_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wide(spark, sf_dir).select("asset", "d", "dvol", F.col("fng").alias("sfc"), (F.coalesce("chg", F.lit(0.0)) / 10).alias("sent"), F.col("n").alias("news"))
    return rounded(w.select("asset", "d", *[c.alias(k) for k, c in C.regime("dvol", "sfc", "sent", "news").items()]))


@query(f"""WITH {WIDE_SQL}, l AS (SELECT asset, d, CASE WHEN dvol > 80 THEN 'STRESS' ELSE 'NORMAL' END AS a, CASE WHEN chg > 0 THEN 'BULL' WHEN chg < -4 THEN 'BEAR' ELSE 'SIDEWAYS' END AS b, CASE WHEN fng > 60 THEN 'BULL' ELSE 'CRISIS' END AS c FROM wide),
u AS (SELECT asset, d, unnest([a, b, c]) AS r FROM l), s AS (SELECT asset, d, CASE r WHEN 'NORMAL' THEN 20 WHEN 'STRESS' THEN 55 WHEN 'BULL' THEN 20 WHEN 'SIDEWAYS' THEN 25 WHEN 'BEAR' THEN 60 ELSE 85 END AS v FROM u)
SELECT asset, d, max(v) AS severity, CASE WHEN max(v) >= 60 THEN 'STRESSED' WHEN max(v) >= 35 THEN 'ELEVATED' ELSE 'CALM' END AS label, round(count(*) FILTER (v >= 60) / count(*), 6) AS agreement FROM s GROUP BY 1, 2""", text=D)
def regime_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several regime labels to severities: their maximum, its label, and how many agree. Row-wise, so nothing is shuffled."""
    l = _wide(spark, sf_dir).select("asset", "d", F.when(F.col("dvol") > 80, "STRESS").otherwise("NORMAL").alias("a"), F.when(F.col("chg") > 0, "BULL").when(F.col("chg") < -4, "BEAR").otherwise("SIDEWAYS").alias("b"), F.when(F.col("fng") > 60, "BULL").otherwise("CRISIS").alias("c"))  # noqa: E741
    table_ = F.create_map(*[F.lit(x) for kv in C.CONSENSUS.items() for x in kv])
    v = F.transform(F.array("a", "b", "c"), lambda r: table_[r])
    s = l.select("asset", "d", v.alias("v")).withColumn("severity", F.array_max("v"))
    return s.select("asset", "d", "severity", bucket("severity", [(0, 35, "CALM"), (35, 60, "ELEVATED"), (60, 1000, "STRESSED")]).alias("label"), F.round(F.size(F.filter("v", lambda x: x >= 60)) / F.size("v"), 6).alias("agreement"))


@query(f"""WITH {WIDE_SQL}, p AS (SELECT asset, d, least(0.4 * dom / 100 + 0.3 * least(n / 20.0, 1) + 0.3 * least(10 * abs(coalesce(chg, 0) / 1000), 1), 0.95) AS risk, least(1, dvol / 100) AS agr, fng AS st FROM wide),
q AS (SELECT *, least(greatest(least(greatest(0.30 + 0.15 * agr + 0.08 * greatest(0, 1 - st / 100), 0.05), 0.95) * (1 - risk), 0.05), 0.95) AS conf FROM p), k AS (SELECT *, greatest(0, (2 * conf - (1 - conf)) / 2) AS kelly FROM q)
SELECT asset, d, round(risk, 6) AS risk, round(conf, 6) AS confidence, round(kelly, 6) AS kelly, CASE WHEN kelly <= 0 OR st >= 50 THEN 'CASH' WHEN st < 25 THEN 'BUY' ELSE 'HOLD' END AS signal FROM k""", text=D)
def kelly_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wide(spark, sf_dir).select("asset", "d", (F.col("dom") / 100).alias("cas"), F.least(F.col("n") / 20.0, F.lit(1.0)).alias("sq"), (F.coalesce("chg", F.lit(0.0)) / 1000).alias("fund"), F.least(F.lit(1.0), F.col("dvol") / 100).alias("agr"), F.col("fng").alias("st"))
    return rounded(w.select("asset", "d", *[c.alias(k) for k, c in C.kelly("cas", "sq", "fund", "agr", "st").items()]))


@query("""SELECT l_returnflag AS asset, l_orderkey, l_linenumber, l_partkey, l_suppkey, round((0.5 * 0.02 * sqrt(l_quantity / 5000) + 0.1 * 0.02 * l_quantity / 5000) * 10000, 6) AS bps FROM lineitem""")
def market_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slippage of every trade: a projection only."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(F.col("l_returnflag").alias("asset"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(C.slippage("l_quantity", F.lit(5000.0), F.lit(0.02)), 6).alias("bps"))


@query(f"""WITH {WIDE_SQL}, p AS (SELECT asset, d, dvol AS a, dom AS b, fng AS e, least(100, n * 8.0) AS lev, dvol AS cor FROM wide)
SELECT asset, d, round(least(100 * exp((ln(greatest(a / 100, 1e-9)) + ln(greatest(b / 100, 1e-9)) + ln(greatest(e / 100, 1e-9)) + ln(greatest(lev / 100, 1e-9)) + ln(greatest(cor / 100, 1e-9))) / 5) * CASE WHEN lev >= 60 AND cor >= 60 THEN 1 + 0.25 * lev * cor / 10000 ELSE 1 END, 100), 6) AS tail FROM p""", text=D)
def tail_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _wide(spark, sf_dir).withColumn("lev", F.least(F.lit(100.0), F.col("n") * 8.0))
    return p.select("asset", "d", F.round(C.tail_risk(["dvol", "dom", "fng", "lev", "dvol"], "lev", "dvol"), 6).alias("tail"))


@query()
def probability_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictive spread, quantiles and exceedance chance (the normal law is an approximation, so there is no twin)."""
    w = _wide(spark, sf_dir).select("asset", "d", F.col("fng").alias("mean"), (F.col("dvol") / 20).alias("spread"), F.least(F.lit(1.0), F.col("n") / 20).alias("conf"))
    return rounded(w.select("asset", "d", *[c.alias(k) for k, c in C.probability_head("mean", "spread", "conf", F.lit(3.0)).items()]))


@query(f"""WITH {WIDE_SQL}, x AS (SELECT asset, d, 100 * fng / 25 - 20 AS raw FROM wide), c AS (SELECT asset, d, raw, raw < 0 OR raw > 100 AS clamped, least(greatest(raw, 0), 100) AS v FROM x),
j AS (SELECT *, abs(v - lag(v) {W})) > 60 AS jump FROM c), g AS (SELECT *, coalesce(jump, false) AS bad, sum(CASE WHEN coalesce(jump, false) THEN 0 ELSE 1 END) {W}) AS grp FROM j)
SELECT asset, d, round(v, 6) AS v, clamped, bad, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY asset, grp ORDER BY d) >= 2 AS tripped FROM g""", text=D)
def breaker_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range clamp, jump check, and a breaker that trips after two failures in a row."""
    w = S.over("asset", "d")
    x = _wide(spark, sf_dir).select("asset", "d", (100 * F.col("fng") / 25 - 20).alias("raw"))
    c = x.withColumn("clamped", (F.col("raw") < 0) | (F.col("raw") > 100)).withColumn("v", clamp("raw", 0.0, 100.0))
    g = c.withColumn("bad", F.coalesce(F.abs(F.col("v") - F.lag("v").over(w)) > 60, F.lit(False)))
    g = g.withColumn("grp", F.sum((~F.col("bad")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(F.col("bad").cast("int")).over(Window.partitionBy("asset", "grp").orderBy("d"))
    return g.select("asset", "d", F.round("v", 6).alias("v"), "clamped", "bad", (run >= 2).alias("tripped"))


@query(f"""WITH {BARS_SQL}, z AS (SELECT asset, d, (volume - avg(volume) {W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) / nullif(stddev_samp(volume) {W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0) AS z, count(*) {W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS n FROM bars),
b AS (SELECT *, coalesce(n >= 10 AND abs(z) > 2, false) AS out FROM z), g AS (SELECT *, sum(CASE WHEN out THEN 0 ELSE 1 END) {W}) AS grp FROM b)
SELECT asset, d, round(z, 6) AS z, out, sum(CASE WHEN out THEN 1 ELSE 0 END) OVER (PARTITION BY asset, grp ORDER BY d) >= 2 AS drift FROM g""", text=D)
def drift_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z against the last thirty rows, and drift after two outliers in a row."""
    w = S.over("asset", "d")
    f = w.rowsBetween(-30, -1)
    z = bars(spark, sf_dir).select("asset", "d", ratio(F.col("volume") - F.avg("volume").over(f), F.stddev_samp("volume").over(f)).alias("z"), F.count("*").over(f).alias("c"))
    b = z.withColumn("out", F.coalesce((F.col("c") >= 10) & (F.abs("z") > 2), F.lit(False)))
    g = b.withColumn("grp", F.sum((~F.col("out")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.select("asset", "d", F.round("z", 6).alias("z"), "out", (F.sum(F.col("out").cast("int")).over(Window.partitionBy("asset", "grp").orderBy("d")) >= 2).alias("drift"))


@query("""WITH e AS (SELECT event_type, value, date_diff('second', ts, TIMESTAMP '2024-01-31 00:00:00') / 86400.0 AS age FROM events)
SELECT event_type, round(sum(value * pow(2, -age / 3)) / sum(pow(2, -age / 3)), 6) AS fast, round(sum(value * pow(2, -age / 10)) / sum(pow(2, -age / 10)), 6) AS slow FROM e GROUP BY 1""")
def decay_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means in which observations fade with two half-lives."""
    age = (F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", "ts"))) / 86400.0
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value", age.alias("age"))
    mean = lambda h: F.round(F.sum(F.col("value") * decay("age", h)) / F.sum(decay("age", h)), 6)
    return e.groupBy("event_type").agg(mean(3).alias("fast"), mean(10).alias("slow"))
