"""State classifiers, overlays and derived features over the wide daily frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as C
from ..functions import states as G
from ..functions.exprs import clamp, ratio, rounded
from ..operators import series as S
from ..sources.tables import BARS_SQL, bars
from .registry import query
from .scores import _F, WIDE_SQL, _cl, _wide

D = ("d",)
W = "OVER (PARTITION BY asset ORDER BY d"
_RATES_SQL = "close / open AS eur, 100 * high / low AS jpy, open / high AS gbp, low / close + 0.3 AS cad, 10 + n AS sek, volume / 100 AS chf"


@query(f"""WITH {BARS_SQL}, r AS (SELECT asset, d, {_RATES_SQL} FROM bars) SELECT asset, d,
round(50.14348112 * pow(eur, -0.576) * pow(jpy, 0.136) * pow(gbp, -0.119) * pow(cad, 0.091) * pow(sek, 0.042) * pow(chf, 0.036), 6) AS basket FROM r""", text=D)
def dollar_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A geometric basket of six rates."""
    b = bars(spark, sf_dir)
    rates = {"eur": F.col("close") / F.col("open"), "jpy": 100 * F.col("high") / F.col("low"), "gbp": F.col("open") / F.col("high"), "cad": F.col("low") / F.col("close") + 0.3, "sek": (10 + F.col("n")).cast("double"), "chf": F.col("volume") / 100}
    return b.select("asset", "d", F.round(G.basket(rates), 6).alias("basket"))


@query(f"""WITH {WIDE_SQL}, p AS (SELECT asset, d, dvol / 100 AS l, fng / 100 AS s, chg FROM wide), e AS (SELECT *, CAST(l < 0.4 OR l >= 0.6 AS INTEGER) + CAST(s < 0.4 OR s >= 0.6 AS INTEGER) AS edges FROM p)
SELECT asset, d, CASE WHEN l < 0.4 AND s < 0.4 THEN 'STRENGTHENING' WHEN l < 0.4 AND s >= 0.6 THEN 'TRANSMISSION_GAP' WHEN l >= 0.6 AND s < 0.4 THEN 'DIVERGENCE' WHEN l >= 0.6 AND s >= 0.6 THEN 'DISTRESS_CASCADE' ELSE 'TRANSMITTING' END AS status,
  round(CASE WHEN chg IS NULL THEN 0.5 + 0.25 * edges ELSE least(0.95, 0.5 + 0.25 * edges + CASE WHEN chg >= 0 AND s < 0.6 THEN 0.1 WHEN chg < 0 AND s >= 0.4 THEN -0.1 ELSE 0 END) END, 6) AS confidence FROM e""", text=D)
def transmission_quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liquidity against structure: four corners and what lies between."""
    p = _wide(spark, sf_dir).select("asset", "d", (F.col("dvol") / 100).alias("l"), (F.col("fng") / 100).alias("s"), "chg")
    return rounded(p.select("asset", "d", *[c.alias(k) for k, c in G.transmission("l", "s", "chg").items()]))


@query(f"""WITH {WIDE_SQL}, p AS (SELECT asset, d, least(1, dvol / 90) AS risk, greatest(0, 1 - fng / 100) AS kelly FROM wide)
SELECT asset, d, round(risk, 6) AS risk, CASE WHEN risk > 0.6 THEN 0.0 WHEN risk > 0.5 THEN 0.5 ELSE 1.0 END AS leaves, round(kelly * CASE WHEN risk > 0.6 THEN 0.0 WHEN risk > 0.5 THEN 0.5 ELSE 1.0 END, 6) AS position FROM p""", text=D)
def transition_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions cut by the risk that the regime turns."""
    p = _wide(spark, sf_dir).select("asset", "d", F.least(F.lit(1.0), F.col("dvol") / 90).alias("risk"), F.greatest(F.lit(0.0), 1 - F.col("fng") / 100).alias("kelly"))
    return rounded(p.select("asset", "d", "risk", G.guard("risk").alias("leaves"), (F.col("kelly") * G.guard("risk")).alias("position")))


_has = lambda side, *names: " OR ".join(f"list_contains({side}, '{n}')" for n in names)


@query(f"""WITH {WIDE_SQL}, p AS (SELECT asset, d, dom AS mpi, fng AS g, (dvol - 40) / 60 AS cas, CASE WHEN chg < -3 THEN 'HIDDEN_ACCUMULATION' WHEN chg > 3 THEN 'HIDDEN_DISTRIBUTION' END AS div, n / 20.0 AS etf, least(1, quote / 2000000) AS wh,
  CASE WHEN dvol > 95 THEN 'CRISIS' WHEN chg > 0 THEN 'BULL' WHEN chg < 0 THEN 'BEAR' END AS rg FROM wide),
e AS (SELECT *, list_filter([CASE WHEN mpi >= 75 THEN 'cl' WHEN mpi >= 60 THEN 'pl' END, CASE WHEN g >= 85 THEN 'eg' WHEN g >= 70 THEN 'g' END, CASE WHEN etf >= 0.65 THEN 'in' END, CASE WHEN wh >= 0.65 THEN 'wb' END, CASE WHEN rg = 'BULL' THEN 'rb' END], lambda x: x IS NOT NULL) AS u,
  list_filter([CASE WHEN mpi <= 25 THEN 'ps' WHEN mpi <= 40 THEN 'pw' END, CASE WHEN g <= 15 THEN 'ef' WHEN g <= 25 THEN 'f' END, CASE WHEN cas >= 0.5 THEN 'ch' WHEN cas >= 0.25 THEN 'ce' END, CASE WHEN etf <= 0.35 THEN 'out' END, CASE WHEN wh <= 0.35 THEN 'ws' END, CASE WHEN rg IN ('BEAR', 'CRISIS') THEN 'rx' END], lambda x: x IS NOT NULL) AS b FROM p)
SELECT asset, d, len(u)::INTEGER AS n_bull, len(b)::INTEGER AS n_bear, CASE WHEN {_has('b', 'ch')} OR rg = 'CRISIS' THEN 'PANIC' WHEN ({_has('u', 'eg', 'cl')}) AND coalesce(div, '') != 'HIDDEN_DISTRIBUTION' THEN 'EUPHORIA'
  WHEN div = 'HIDDEN_DISTRIBUTION' OR ({_has('b', 'out')} AND {_has('u', 'pl')}) OR ({_has('b', 'ws')} AND {_has('u', 'g')}) THEN 'DISTRIBUTION'
  WHEN div = 'HIDDEN_ACCUMULATION' OR (({_has('u', 'in', 'wb')}) AND ({_has('b', 'f', 'ef')})) THEN 'ACCUMULATION' WHEN len(b) >= 3 AND len(u) = 0 THEN 'PANIC' WHEN len(u) >= 1 AND len(b) <= 1 THEN 'EXPANSION'
  WHEN len(u) > len(b) THEN 'ACCUMULATION' WHEN len(b) > len(u) THEN 'DISTRIBUTION' ELSE 'EXPANSION' END AS state FROM e""", text=D)
def evidence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of behaviour by bullish and bearish evidence."""
    p = _wide(spark, sf_dir).select(
        "asset", "d", F.col("dom").alias("mpi"), "fng", ((F.col("dvol") - 40) / 60).alias("cas"), F.when(F.col("chg") < -3, "HIDDEN_ACCUMULATION").when(F.col("chg") > 3, "HIDDEN_DISTRIBUTION").alias("div"),
        (F.col("n") / 20.0).alias("etf"), F.least(F.lit(1.0), F.col("quote") / 2000000).alias("wh"), F.when(F.col("dvol") > 95, "CRISIS").when(F.col("chg") > 0, "BULL").when(F.col("chg") < 0, "BEAR").alias("rg"),
    )
    return p.select("asset", "d", *[c.alias(k) for k, c in G.evidence("mpi", "fng", "cas", "div", "etf", "wh", "rg").items()])


@query(f"""WITH {WIDE_SQL}, s AS (SELECT asset, d, close, fng / 100 AS mom, CASE WHEN dvol > 80 THEN 'STRESS' WHEN dvol > 60 THEN 'ELEVATED' ELSE 'CALM' END AS bucket FROM wide),
h AS (SELECT asset, d, bucket, mom, h, lead(close, h) OVER (PARTITION BY asset, h ORDER BY d) > close AS up, d >= DATE '1995-06-01' AS late FROM s, unnest([30, 90, 180]) AS t(h)),
p AS (SELECT asset, bucket, h, avg(CAST(up AS INTEGER)) FILTER (late) AS p, avg(CAST(up AS INTEGER)) FILTER (NOT late) AS p0 FROM h WHERE up IS NOT NULL GROUP BY 1, 2, 3), b AS (SELECT asset, h, avg(CAST(up AS INTEGER)) FILTER (late) AS base FROM h WHERE up IS NOT NULL GROUP BY 1, 2),
m AS (SELECT p.asset, bucket, p - base AS m, CASE WHEN sign(p - base) = sign(p0 - base) THEN 1.0 ELSE 0.5 END AS st FROM p JOIN b ON p.asset = b.asset AND p.h = b.h WHERE p IS NOT NULL),
v AS (SELECT asset, bucket, coalesce(round(sum(abs(m) * st) FILTER (m > 0), 9), 0) AS follow, coalesce(round(sum(abs(m) * st) FILTER (m < 0), 9), 0) AS fade FROM m GROUP BY 1, 2),
g AS (SELECT s.asset, s.d, s.bucket, mom, CASE WHEN mom < 0.55 AND mom > 0.45 OR follow = fade THEN 'NEUTRAL' WHEN follow > fade THEN 'FOLLOW' ELSE 'FADE' END AS action, follow, fade FROM s JOIN v ON s.asset = v.asset AND s.bucket = v.bucket)
SELECT asset, d, bucket, action, round(CASE action WHEN 'NEUTRAL' THEN 50 ELSE least(greatest(50 + CASE action WHEN 'FOLLOW' THEN 1 ELSE -1 END * least(greatest((mom - 0.5) * 2, -1), 1) * greatest(follow, fade) / (follow + fade) * 50, 0), 100) END, 4) AS score FROM g""", text=D)
def overlay_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum followed or faded by a vote of horizons: how far each bucket's chance of going on lies from the base rate, half as
    much where an earlier era disagrees."""
    bucket = F.when(F.col("dvol") > 80, "STRESS").when(F.col("dvol") > 60, "ELEVATED").otherwise("CALM")
    s = _wide(spark, sf_dir).select("asset", "d", "close", (F.col("fng") / 100).alias("mom"), bucket.alias("bucket"))
    w = S.over("asset", "d")
    h = s.select("asset", "d", "bucket", *[(F.lead("close", n).over(w) > F.col("close")).alias(f"up{n}") for n in (30, 90, 180)])
    h = h.select("asset", "d", "bucket", F.inline(F.array(*[F.struct(F.lit(n).alias("h"), F.col(f"up{n}").alias("up")) for n in (30, 90, 180)]))).where("up IS NOT NULL")
    late = F.col("d") >= F.lit("1995-06-01").cast("date")
    share = lambda where: F.avg(F.when(where, F.col("up").cast("int")))
    p = h.groupBy("asset", "bucket", "h").agg(share(late).alias("p"), share(~late).alias("p0"))
    base = h.groupBy("asset", "h").agg(share(late).alias("base"))
    m = p.join(base, ["asset", "h"]).where("p IS NOT NULL").withColumn("m", F.col("p") - F.col("base"))
    m = m.withColumn("v", F.abs("m") * F.when(F.signum("m") == F.signum(F.col("p0") - F.col("base")), 1.0).otherwise(0.5))
    side = lambda where: F.coalesce(F.round(F.sum(F.when(where, F.col("v"))), 9), F.lit(0.0))
    v = m.groupBy("asset", "bucket").agg(side(F.col("m") > 0).alias("follow"), side(F.col("m") < 0).alias("fade"))
    g = s.join(v, ["asset", "bucket"])
    action = F.when((F.col("mom") < 0.55) & (F.col("mom") > 0.45) | (F.col("follow") == F.col("fade")), "NEUTRAL").when(F.col("follow") > F.col("fade"), "FOLLOW").otherwise("FADE")
    sure = F.greatest("follow", "fade") / (F.col("follow") + F.col("fade"))
    score = clamp(50 + F.when(action == "FOLLOW", 1.0).otherwise(-1.0) * clamp((F.col("mom") - 0.5) * 2, -1.0, 1.0) * sure * 50, 0.0, 100.0)
    return g.select("asset", "d", "bucket", action.alias("action"), F.round(F.when(action == "NEUTRAL", 50.0).otherwise(score), 4).alias("score"))


_RW = G.REGIME_WEIGHTS
_weighted = lambda r: " + ".join(f"least(greatest((3.0 - {k}) / 6, 0), 1) * {v}" for k, v in _RW[r].items())


@query(f"""WITH {WIDE_SQL}, {_F}, r AS (SELECT *, CASE WHEN dvol > 90 THEN 'CAPITULATION' WHEN dvol > 70 THEN 'STRESS' ELSE 'NORMAL' END AS regime FROM f WHERE lt IS NOT NULL)
SELECT asset, d, regime, round(CASE regime WHEN 'CAPITULATION' THEN {_weighted('CAPITULATION')} WHEN 'STRESS' THEN {_weighted('STRESS')} ELSE {_weighted('NORMAL')} END, 6) AS z FROM r""", text=D)
def regime_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors as stress, weighted by the regime; the table of weights is a map in the plan, so nothing is joined."""
    w = _wide(spark, sf_dir)
    regime = F.when(F.col("dvol") > 90, "CAPITULATION").when(F.col("dvol") > 70, "STRESS").otherwise("NORMAL")
    f = w.select("asset", "d", regime.alias("regime"), *[c.alias(k) for k, c in C.factors("chg", "dom", "pc", "fng", "dvol", "dxy", "c").items()]).where("lt IS NOT NULL")
    table = F.create_map(*[x for r, ws in _RW.items() for x in (F.lit(r), F.create_map(*[F.lit(y) for kv in ws.items() for y in kv]))])
    z = sum((G.stress_norm(k) * table[F.col("regime")][k] for k in ("lt", "st", "rt", "ft", "sc")), F.lit(0.0))
    return f.select("asset", "d", "regime", F.round(z, 6).alias("z"))


@query(f"""WITH {WIDE_SQL}, u AS (SELECT asset, d, close, unnest(['dom', 'dvol', 'fng']) AS name, unnest([dom / 100, dvol / 100, fng / 100]) AS x FROM wide)
SELECT asset, d, name, round(x * x, 6) AS squared, round(CASE WHEN x > 0 THEN ln(greatest(x, 1e-10)) END, 6) AS logged, round(1 / (1 + exp(2.5 - 5 * x)), 6) AS curved, round(CASE WHEN x > 0 THEN close / greatest(x, 1e-10) END, 4) AS against_price FROM u""", text=D)
def feature_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares, logarithms, sigmoids and price ratios of features, one row for each feature."""
    w = _wide(spark, sf_dir)
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("name"), (F.col(k) / 100).alias("x")) for k in ("dom", "dvol", "fng")]))
    u = w.select("asset", "d", "close", each)
    price = F.when(F.col("x") > 0, F.col("close") / F.greatest(F.col("x"), F.lit(1e-10)))
    return u.select("asset", "d", "name", *[F.round(c, 6).alias(k) for k, c in G.augmented("x").items()], F.round(price, 4).alias("against_price"))


@query(f"""WITH {BARS_SQL}, f AS (SELECT asset, d, close / lag(close) {W}) - 1 AS r1, close / lag(close, 7) {W}) - 1 AS r7, (high - low) / close AS rng, (close - low) / nullif(high - low, 0) AS loc, volume / avg(volume) {W} ROWS 19 PRECEDING) AS vol,
  stddev_samp(close) {W} ROWS 19 PRECEDING) / avg(close) {W} ROWS 19 PRECEDING) AS cv FROM bars)
SELECT asset, d, len(list_filter([r1, r7, rng, loc, vol, cv], lambda x: x IS NOT NULL))::INTEGER AS n_known, round(coalesce(r1, 0) + coalesce(r7, 0) + coalesce(rng, 0) + coalesce(loc, 0) + coalesce(vol, 0) + coalesce(cv, 0), 6) AS total FROM f""", text=D)
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed vector of features for each bar, missing ones as zero; given here by how many are known and their sum."""
    w = S.over("asset", "d")
    m = w.rowsBetween(-19, 0)
    f = bars(spark, sf_dir).select(
        "asset", "d", S.pct_change("close", w).alias("r1"), S.pct_change("close", w, 7).alias("r7"), ((F.col("high") - F.col("low")) / F.col("close")).alias("rng"),
        ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")).alias("loc"), (F.col("volume") / F.avg("volume").over(m)).alias("vol"), (F.stddev_samp("close").over(m) / F.avg("close").over(m)).alias("cv"),
    )
    x = F.array("r1", "r7", "rng", "loc", "vol", "cv")
    v = F.transform(x, lambda e: F.coalesce(e, F.lit(0.0)))
    return f.select("asset", "d", F.size(F.filter(x, lambda e: e.isNotNull())).alias("n_known"), F.round(F.aggregate(v, F.lit(0.0), lambda a, e: a + e), 6).alias("total"))


@query(f"""WITH {WIDE_SQL}, p AS (SELECT asset, d, close, dvol + 15 AS v, fng AS s, floor(close * (1 - least(fng / 100, 0.8) * 0.6)) AS floor FROM wide)
SELECT asset, d, floor::BIGINT AS floor, CASE WHEN v >= 100 AND close <= floor * 1.05 THEN 'TURNING POINT' WHEN v < 40 AND s > 30 THEN 'DISSIPATIVE SLIDE' WHEN s > 50 THEN 'STRUCTURAL DECAY' WHEN v > 80 THEN 'VOLATILITY BREAKDOWN' ELSE 'NORMAL OSCILLATION' END AS state FROM p""", text=D)
def price_floor_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price floor that falls with stress, and the state of the price."""
    p = _wide(spark, sf_dir).select("asset", "d", "close", (F.col("dvol") + 15).alias("v"), F.col("fng").alias("s")).withColumn("floor", G.price_floor("close", "s"))
    return p.select("asset", "d", "floor", G.price_state("v", "s", "close", "floor").alias("state"))


@query(f"""WITH {WIDE_SQL}, {_F}, p AS (SELECT asset, d, lt, rt, ft, dvol / 100 AS m81, n / 20.0 AS m82, fng / 100 AS m86, dom AS m90 FROM f)
SELECT asset, d, round({_cl(f"lt + {_cl('(0.5 - m82) * 1.5', -1.5, 1.5)} + {_cl('(m90 - 50) / 50', -1, 1)}", -3, 3)}, 6) AS lt, round({_cl(f"rt + {_cl('(0.5 - m81) * 1.5', -1.5, 1.5)}", -3, 3)}, 6) AS rt, round({_cl(f"ft + {_cl('(m86 - 0.5) * 1.5', -1.5, 1.5)}", -3, 3)}, 6) AS ft FROM p""", text=D)
def factor_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors moved by later readings, each by a bounded step, and clamped again."""
    w = _wide(spark, sf_dir)
    f = w.select("asset", "d", "dvol", "n", "fng", "dom", *[c.alias(k) for k, c in C.factors("chg", "dom", "pc", "fng", "dvol", "dxy", "c").items()])
    step = lambda x, k: clamp(x * k, -1.5, 1.5)
    lt = clamp(F.col("lt") + step(0.5 - F.col("n") / 20.0, 1.5) + clamp((F.col("dom") - 50) / 50, -1.0, 1.0), -3.0, 3.0)
    rt, ft = clamp(F.col("rt") + step(0.5 - F.col("dvol") / 100, 1.5), -3.0, 3.0), clamp(F.col("ft") + step(F.col("fng") / 100 - 0.5, 1.5), -3.0, 3.0)
    return rounded(f.select("asset", "d", lt.alias("lt"), rt.alias("rt"), ft.alias("ft")))


@query(f"""WITH {WIDE_SQL}, {_F}, w AS (SELECT asset, d, lt, st, rt, ft, sc FROM f WHERE lt IS NOT NULL), u AS (SELECT asset, d, unnest(['lt', 'st', 'rt', 'ft', 'sc', 'flat']) AS name, unnest([lt, st, rt, ft, sc, 1.0]) AS x FROM w)
SELECT asset, name, count(x) AS n, count(DISTINCT round(x, 6)) > 1 AS varies FROM u GROUP BY 1, 2 HAVING count(DISTINCT round(x, 6)) > 1""")
def varying_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that are neither constant nor empty, by one aggregation over the unpivoted frame."""
    f = _wide(spark, sf_dir).select("asset", *[c.alias(k) for k, c in C.factors("chg", "dom", "pc", "fng", "dvol", "dxy", "c").items()], F.lit(1.0).alias("flat")).where("lt IS NOT NULL")
    u = f.select("asset", F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("x")) for k in ("lt", "st", "rt", "ft", "sc", "flat")])))
    return u.groupBy("asset", "name").agg(F.count("x").alias("n"), (F.countDistinct(F.round("x", 6)) > 1).alias("varies")).where("varies")


@query(f"""WITH {BARS_SQL}, q AS (SELECT asset, count(*) AS n, count(*) FILTER (volume IS NULL OR volume <= 0) AS missing, count(*) FILTER (high < low OR close > high OR close < low) AS wrong, max(d) AS last, count(*) FILTER (n < 3) AS thin FROM bars GROUP BY asset),
s AS (SELECT asset, unnest(['missing', 'wrong', 'thin', 'stale']) AS name, unnest([CASE WHEN missing > 0 THEN 'FAIL' ELSE 'OK' END, CASE WHEN wrong > 0 THEN 'FAIL' ELSE 'OK' END, CASE WHEN thin > 0.05 * n THEN 'WARN' ELSE 'OK' END, CASE WHEN last < (SELECT max(d) FROM bars) - 7 THEN 'WARN' ELSE 'OK' END]) AS status FROM q)
SELECT asset, count(*) FILTER (status = 'OK') AS n_ok, count(*) FILTER (status = 'WARN') AS n_warn, count(*) FILTER (status = 'FAIL') AS n_fail,
  CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'CRITICAL' WHEN count(*) FILTER (status = 'WARN') > 1 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health FROM s GROUP BY asset""")
def data_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of each series counted by status, and the level of health that they add up to."""
    q = bars(spark, sf_dir).groupBy("asset").agg(
        F.count("*").alias("n"), F.count_if(F.col("volume").isNull() | (F.col("volume") <= 0)).alias("missing"),
        F.count_if((F.col("high") < F.col("low")) | (F.col("close") > F.col("high")) | (F.col("close") < F.col("low"))).alias("wrong"), F.max("d").alias("last"), F.count_if(F.col("n") < 3).alias("thin"),
    )
    latest = F.max("last").over(Window.partitionBy(F.lit(0)))  # one row for each series
    bad = lambda hit, name: F.when(hit, name).otherwise("OK")
    checks = F.array(bad(F.col("missing") > 0, "FAIL"), bad(F.col("wrong") > 0, "FAIL"), bad(F.col("thin") > 0.05 * F.col("n"), "WARN"), bad(F.col("last") < F.date_sub(latest, 7), "WARN"))
    s = q.withColumn("checks", checks)
    count = lambda name: F.size(F.filter("checks", lambda x: x == name)).cast("long")
    health = F.when(count("FAIL") > 0, "CRITICAL").when(count("WARN") > 1, "DEGRADED").otherwise("HEALTHY")
    return s.select("asset", count("OK").alias("n_ok"), count("WARN").alias("n_warn"), count("FAIL").alias("n_fail"), health.alias("health"))


@query(f"""WITH {WIDE_SQL}, p AS (SELECT asset, d, least(0.4 * dom / 100 + 0.3 * least(n / 20.0, 1), 0.95) AS risk, least(1, dvol / 100) AS agr, fng AS st, CASE WHEN c > 0.2 THEN 0.05 ELSE 0 END AS boost, CASE WHEN dvol > 90 THEN 0.10 ELSE 0 END + CASE WHEN chg IS NULL THEN 0.05 ELSE 0 END AS penalty, dvol / 120 AS turn FROM wide),
q AS (SELECT *, least(greatest(0.30 + 0.15 * agr + 0.08 * greatest(0, 1 - st / 100) + boost - penalty, 0.05), 0.95) AS macro FROM p), r AS (SELECT *, least(greatest(macro * (1 - risk), 0.05), 0.95) AS conf FROM q), k AS (SELECT *, greatest(0, (2 * conf - (1 - conf)) / 2) * CASE WHEN turn > 0.6 THEN 0.0 WHEN turn > 0.5 THEN 0.5 ELSE 1.0 END AS kelly FROM r)
SELECT asset, d, round(macro, 6) AS macro, round(conf, 6) AS confidence, round(kelly, 6) AS kelly, CASE WHEN kelly <= 0 OR st >= 60 THEN 'CASH' WHEN st < 30 THEN 'BUY' ELSE 'HOLD' END AS signal FROM k""", text=D)
def guarded_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence with boosts and penalties, the position it allows after the guard, and the signal at a regime's multiple of the
    thresholds (1.2 here)."""
    w = _wide(spark, sf_dir)
    risk = F.least(0.4 * F.col("dom") / 100 + 0.3 * F.least(F.col("n") / 20.0, F.lit(1.0)), F.lit(0.95))
    boost = F.when(F.col("c") > 0.2, 0.05).otherwise(0.0)
    penalty = F.when(F.col("dvol") > 90, 0.10).otherwise(0.0) + F.when(F.col("chg").isNull(), 0.05).otherwise(0.0)
    macro = clamp(0.30 + 0.15 * F.least(F.lit(1.0), F.col("dvol") / 100) + 0.08 * F.greatest(F.lit(0.0), 1 - F.col("fng") / 100) + boost - penalty, 0.05, 0.95)
    p = w.select("asset", "d", "fng", (F.col("dvol") / 120).alias("turn"), macro.alias("macro"), risk.alias("risk")).withColumn("confidence", clamp(F.col("macro") * (1 - F.col("risk")), 0.05, 0.95))
    p = p.withColumn("kelly", F.greatest(F.lit(0.0), (2 * F.col("confidence") - (1 - F.col("confidence"))) / 2) * G.guard("turn"))
    signal = F.when((F.col("kelly") <= 0) | (F.col("fng") >= 50 * 1.2), "CASH").when(F.col("fng") < 25 * 1.2, "BUY").otherwise("HOLD")
    return rounded(p.select("asset", "d", "macro", "confidence", "kelly", signal.alias("signal")))


@query(f"""WITH {WIDE_SQL}, j AS (SELECT asset, d, abs(fng - lag(fng) {W})) > 40 AS bad, row_number() {W}) AS i FROM wide), g AS (SELECT asset, d, i, coalesce(bad, false) AS bad, sum(CASE WHEN coalesce(bad, false) THEN 0 ELSE 1 END) {W}) AS grp FROM j),
t AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY asset, grp ORDER BY d) >= 2 AS trip FROM g), c AS (SELECT *, max(CASE WHEN trip THEN i END) {W}) AS last FROM t) SELECT asset, d, bad, trip, coalesce(i - last < 5, false) AS open FROM c""", text=D)
def breaker_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A breaker that trips after two jumps in a row, and stays open for five rows after the last trip."""
    w = S.over("asset", "d")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    j = _wide(spark, sf_dir).select("asset", "d", F.coalesce(F.abs(F.col("fng") - F.lag("fng").over(w)) > 40, F.lit(False)).alias("bad"), F.row_number().over(w).alias("i"))
    g = j.withColumn("grp", F.sum((~F.col("bad")).cast("int")).over(upto))
    t = g.withColumn("trip", F.sum(F.col("bad").cast("int")).over(Window.partitionBy("asset", "grp").orderBy("d")) >= 2)
    last = F.max(F.when(F.col("trip"), F.col("i"))).over(upto)
    return t.select("asset", "d", "bad", "trip", F.coalesce(F.col("i") - last < 5, F.lit(False)).alias("open"))
