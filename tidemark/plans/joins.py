"""Alignment of irregular series: as-of, LOCF, nearest, interval, gap and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..operators import series as S
from ..sources.tables import BARS_SQL, bars, events, table
from .registry import query

D = ("d",)
ORDERS_SQL = "o AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2)"
GRID_SQL = "g AS (SELECT p AS asset, CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT o_orderpriority AS p FROM orders))"


def _orders(spark, sf_dir) -> DataFrame:
    """A sparse daily series for each priority."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return o.groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("v"))


def _grid(spark, sf_dir) -> DataFrame:
    """Every day of the span for each priority."""
    days = F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-08-01").cast("date"))).alias("d")
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("asset")).distinct().select("asset", days)


@query(f"""WITH {ORDERS_SQL}, {GRID_SQL} SELECT g.asset, g.d, round(CASE WHEN date_diff('day', o.d, g.d) <= 9 THEN o.v END, 2) AS v FROM g ASOF LEFT JOIN o ON g.asset = o.asset AND g.d >= o.d""", text=D)
def asof_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of the last ten days."""
    return S.asof(_grid(spark, sf_dir), _orders(spark, sf_dir), "asset", "d", "v", "v", 10).withColumn("v", F.round("v", 2))


@query(f"""WITH {ORDERS_SQL}, {GRID_SQL}, j AS (SELECT g.asset, g.d, o.v, CASE WHEN o.v IS NOT NULL THEN g.d END AS seen FROM g LEFT JOIN o ON g.asset = o.asset AND g.d = o.d)
SELECT asset, d, round(last_value(v IGNORE NULLS) OVER w, 2) AS v, date_diff('day', last_value(seen IGNORE NULLS) OVER w, d) AS age,
  round(last_value(v IGNORE NULLS) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 2) AS v3
FROM j WINDOW w AS (PARTITION BY asset ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", text=D)
def locf_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values carried forward onto a calendar, their age, and with a limit of three days."""
    w = S.over("asset", "d")
    j = _grid(spark, sf_dir).join(_orders(spark, sf_dir), ["asset", "d"], "left")
    seen = F.when(F.col("v").isNotNull(), F.col("d"))
    return j.select("asset", "d", F.round(S.locf("v", w), 2).alias("v"), F.date_diff("d", S.locf(seen, w)).cast("long").alias("age"), F.round(S.locf("v", w, 3), 2).alias("v3"))


@query("""WITH l AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2),
b AS (SELECT l.*, r.value AS bv, epoch_us(l.ts) - epoch_us(r.ts) AS bd FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts),
a AS (SELECT b.*, r.value AS av, epoch_us(r.ts) - epoch_us(b.ts) AS ad FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.ts <= r.ts),
n AS (SELECT *, bd IS NOT NULL AND (ad IS NULL OR bd <= ad) AS back FROM a)
SELECT user_id, event_id, CASE WHEN (CASE WHEN back THEN bd ELSE ad END) <= 7200000000 THEN (CASE WHEN back THEN bv ELSE av END) END AS near FROM n""")
def nearest_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the view of the same user nearest in time, within two hours."""
    e = events(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return S.nearest(left, right, "user_id", "ts", "value", "near", 7200.0).select("user_id", "event_id", "near")


@query(f"""WITH {ORDERS_SQL}, m AS (SELECT asset, strftime(d, '%Y-%m') AS month, max(d) AS d, arg_max(v, d) AS v FROM o WHERE day(d) <= 5 GROUP BY 1, 2),
q AS (SELECT DISTINCT asset, CAST(date_trunc('month', d) AS DATE) AS want FROM o),
r AS (SELECT q.asset, q.want, m.v, row_number() OVER (PARTITION BY q.asset, q.want ORDER BY abs(date_diff('day', m.d, q.want)), m.d) AS i FROM q JOIN m ON q.asset = m.asset)
SELECT asset, CAST(want AS VARCHAR) AS want, round(v, 2) AS v FROM r WHERE i = 1""")
def nearest_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value nearest to each month's first day, without a bound on the distance."""
    o = _orders(spark, sf_dir)
    m = o.where(F.dayofmonth("d") <= 5).groupBy("asset", F.date_format("d", "yyyy-MM").alias("month")).agg(F.max_by("v", "d").alias("v"), F.max("d").alias("d"))
    q = o.select("asset", F.to_date(F.date_trunc("month", "d")).alias("d")).distinct()
    got = S.nearest(q, m.select("asset", "d", "v"), "asset", "d", "v", "v", float("inf"))
    return got.select("asset", F.col("d").cast("string").alias("want"), F.round("v", 2).alias("v"))


@query(f"""WITH {BARS_SQL} SELECT a.d, a.close AS a_close, n.close AS n_close, r.close AS r_close FROM bars a JOIN bars n ON a.d = n.d JOIN bars r ON a.d = r.d
WHERE a.asset = 'A' AND n.asset = 'N' AND r.asset = 'R'""", text=D)
def common_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets side by side on the days that all have: one grouping instead of self joins."""
    one = lambda a: F.max(F.when(F.col("asset") == a, F.col("close"))).alias(f"{a.lower()}_close")
    return bars(spark, sf_dir).groupBy("d").agg(one("A"), one("N"), one("R")).dropna()


@query(f"""WITH {BARS_SQL}, {ORDERS_SQL}, p AS (SELECT d, sum(v) AS v FROM o GROUP BY d), b AS (SELECT d, sum(quote) AS quote FROM bars GROUP BY d)
SELECT coalesce(b.d, p.d) AS d, round(quote, 2) AS quote, round(v, 2) AS v FROM b FULL JOIN p ON b.d = p.d""", text=D)
def outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds as one record for each day that either has."""
    b = bars(spark, sf_dir).groupBy("d").agg(F.sum("quote").alias("quote"))
    p = _orders(spark, sf_dir).groupBy("d").agg(F.sum("v").alias("v"))
    return b.join(p, "d", "full").select("d", F.round("quote", 2).alias("quote"), F.round("v", 2).alias("v"))


@query(f"""WITH {ORDERS_SQL}, ev AS (SELECT asset, d AS start, CASE WHEN v > 400000 THEN 1 ELSE -1 END AS direction FROM o WHERE v > 350000),
{GRID_SQL}, j AS (SELECT g.asset, g.d, direction * exp(-date_diff('day', start, g.d) / 10.0) * 100 AS prm FROM g JOIN ev ON g.asset = ev.asset AND g.d BETWEEN start AND start + INTERVAL 60 DAY),
m AS (SELECT asset, d, arg_max(prm, (abs(prm), prm)) AS prm FROM j GROUP BY 1, 2)
SELECT g.asset, g.d, round(coalesce(prm, 50), 6) AS prm FROM g LEFT JOIN m ON g.asset = m.asset AND g.d = m.d""", text=D)
def interval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events act for sixty days and fade; the strongest active one counts, 50 without any.

    The range is turned into an equi join: an event is laid on the days it acts on, so no pairs outside the range are made.
    """
    ev = _orders(spark, sf_dir).where("v > 350000").select("asset", F.col("d").alias("start"), F.when(F.col("v") > 400000, 1).otherwise(-1).alias("direction"))
    days = ev.select("asset", "start", "direction", F.explode(F.sequence("start", F.date_add("start", 60))).alias("d"))
    prm = F.col("direction") * F.exp(-F.date_diff("d", "start") / 10.0) * 100
    m = days.withColumn("prm", prm).groupBy("asset", "d").agg(F.max_by("prm", F.struct(F.abs("prm"), "prm")).alias("prm"))
    return _grid(spark, sf_dir).join(m, ["asset", "d"], "left").select("asset", "d", F.round(F.coalesce("prm", F.lit(50.0)), 6).alias("prm"))


@query(f"""WITH {BARS_SQL}, u AS (SELECT d, close, 'A' AS src FROM bars WHERE asset = 'A' AND d < DATE '1998-01-01' UNION ALL SELECT d, close, 'N' FROM bars WHERE asset = 'N' AND d >= DATE '1998-01-01') SELECT d, close, src FROM u""", text=D)
def splice_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source before a date, another from then on."""
    b = bars(spark, sf_dir)
    cut = F.lit("1998-01-01").cast("date")
    return b.where((F.col("asset") == "A") & (F.col("d") < cut)).unionByName(b.where((F.col("asset") == "N") & (F.col("d") >= cut))).select("d", "close", F.col("asset").alias("src"))


@query(f"""WITH {ORDERS_SQL}, {GRID_SQL} SELECT g.asset, g.d, dayofweek(g.d) IN (0, 6) AS weekend FROM g ANTI JOIN o ON g.asset = o.asset AND g.d = o.d""", text=D)
def gap_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar days that a series lacks."""
    return _grid(spark, sf_dir).join(_orders(spark, sf_dir), ["asset", "d"], "left_anti").select("asset", "d", F.dayofweek("d").isin(1, 7).alias("weekend"))


@query(f"""WITH {BARS_SQL} SELECT b.asset, b.d, round(f.close / b.close - 1, 9) AS ret_30d FROM bars b LEFT JOIN bars f ON b.asset = f.asset AND f.d = b.d + 30""", text=D)
def forward_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The return to the bar exactly thirty days later (by date, not by rows)."""
    b = bars(spark, sf_dir)
    ahead = b.select("asset", F.date_sub("d", 30).alias("d"), F.col("close").alias("later"))
    return b.join(ahead, ["asset", "d"], "left").select("asset", "d", F.round(ratio("later", "close") - 1, 9).alias("ret_30d"))


@query(f"""WITH {BARS_SQL}, x AS (SELECT asset, d, lag(close) OVER (PARTITION BY asset ORDER BY d) AS prior FROM bars) SELECT asset, d, prior FROM x WHERE prior IS NOT NULL""", text=D)
def lagged_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known one row earlier."""
    return bars(spark, sf_dir).withColumn("prior", F.lag("close").over(S.over("asset", "d"))).where("prior IS NOT NULL").select("asset", "d", "prior")


@query("""SELECT n.n_name, r.r_name, CASE WHEN r.r_name LIKE '%A' THEN 20 WHEN r.r_name LIKE '%E' THEN 55 ELSE 85 END AS severity FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small dimension and a rule on top of it."""
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("n_name", "r_name", F.when(F.col("r_name").endswith("A"), 20).when(F.col("r_name").endswith("E"), 55).otherwise(85).alias("severity"))


@query("""SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only customers that have a closed order."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(f"""WITH {BARS_SQL}, {ORDERS_SQL}, x AS (SELECT d FROM bars), y AS (SELECT DISTINCT d FROM o)
SELECT (SELECT count(*) FROM (SELECT d FROM x INTERSECT SELECT d FROM y)) AS common, (SELECT count(*) FROM (SELECT d FROM x UNION SELECT d FROM y)) AS either, (SELECT count(*) FROM (SELECT d FROM x EXCEPT SELECT d FROM y)) AS only_left""")
def date_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, union and difference of two calendars, from one grouping."""
    x, y = bars(spark, sf_dir).select("d").distinct().withColumn("l", F.lit(1)), _orders(spark, sf_dir).select("d").distinct().withColumn("r", F.lit(1))
    both = x.join(y, "d", "full")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"), F.count("*").alias("either"), F.count_if(F.col("l").isNotNull() & F.col("r").isNull()).alias("only_left"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE i <= 3""")
def upsert_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three entries of each key, newest first."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("i", F.row_number().over(w)).where("i <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, (ts, event_id)) AS last_value, count(*) AS n FROM events GROUP BY 1, 2""")
def latest_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot of each day."""
    k = F.struct("ts", "event_id")
    return events(spark, sf_dir).groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.max_by("event_type", k).alias("last_type"), F.max_by("value", k).alias("last_value"), F.count("*").alias("n"))


@query("""SELECT user_id, round(sum(value) FILTER (event_type = 'view'), 4) AS "view", round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'purchase'), 4) AS purchase FROM events GROUP BY 1""")
def metrics_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long table of metrics made wide; the columns are named, so no extra pass looks for them."""
    p = events(spark, sf_dir).groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.sum("value"))
    return p.select("user_id", *[F.round(c, 4).alias(c) for c in ("view", "click", "purchase")])
