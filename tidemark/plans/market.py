"""Trade tape aggregation: bars, order flow, concentration, ladders, depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio, rounded
from ..sources.tables import BARS_SQL, TRADES_SQL, bars, events, table, trades
from .registry import query

WHALE, BIG_WHALE = 50_000.0, 95_000.0


@query(f"""WITH {TRADES_SQL}
SELECT d, arg_max(price, k) AS price_close, sum(qty) FILTER (buy) AS taker_buy_qty, sum(qty) FILTER (NOT buy) AS taker_sell_qty,
  round(sum(notional) FILTER (buy), 2) AS taker_buy_quote, round(sum(notional) FILTER (NOT buy), 2) AS taker_sell_quote,
  sum(qty) AS total_qty, round(sum(notional), 2) AS total_quote,
  round((coalesce(sum(qty) FILTER (buy), 0) - coalesce(sum(qty) FILTER (NOT buy), 0)) / nullif(sum(qty), 0), 6) AS imbalance_qty,
  round(coalesce(sum(notional) FILTER (buy), 0) / nullif(sum(notional), 0), 6) AS buy_ratio,
  count(*) AS n_trades, count(*) FILTER (buy) AS n_buy, count(*) FILTER (NOT buy) AS n_sell,
  count(*) FILTER (notional >= 50000) AS whale_lo_count, round(coalesce(sum(notional) FILTER (notional >= 50000), 0), 2) AS whale_lo_quote,
  count(*) FILTER (notional >= 95000) AS whale_hi_count, round(coalesce(sum(notional) FILTER (notional >= 95000), 0), 2) AS whale_hi_quote
FROM trades GROUP BY d""", text=("d",))
def orderflow_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taker buys and sells, imbalance and large trades of each day."""
    t = trades(spark, sf_dir)
    buy, sell = F.col("buy"), ~F.col("buy")
    of = lambda c, on: F.sum(F.when(on, F.col(c)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = t.groupBy("d").agg(
        F.max_by("price", "k").alias("price_close"),
        of("qty", buy).alias("taker_buy_qty"),
        of("qty", sell).alias("taker_sell_qty"),
        of("notional", buy).alias("taker_buy_quote"),
        of("notional", sell).alias("taker_sell_quote"),
        F.sum("qty").alias("total_qty"),
        F.sum("notional").alias("total_quote"),
        F.count("*").alias("n_trades"),
        F.count_if(buy).alias("n_buy"),
        F.count_if(sell).alias("n_sell"),
        F.count_if(F.col("notional") >= WHALE).alias("whale_lo_count"),
        zero(of("notional", F.col("notional") >= WHALE)).alias("whale_lo_quote"),
        F.count_if(F.col("notional") >= BIG_WHALE).alias("whale_hi_count"),
        zero(of("notional", F.col("notional") >= BIG_WHALE)).alias("whale_hi_quote"),
    )
    out = out.withColumn("imbalance_qty", ratio(zero(F.col("taker_buy_qty")) - zero(F.col("taker_sell_qty")), "total_qty"))
    out = out.withColumn("buy_ratio", ratio(zero(F.col("taker_buy_quote")), "total_quote"))
    quotes = dict.fromkeys(["taker_buy_quote", "taker_sell_quote", "total_quote", "whale_lo_quote", "whale_hi_quote"], 2)
    return rounded(out, 6, price_close=None, **quotes)


@query(f"WITH {BARS_SQL} SELECT asset, d, open, high, low, close, volume, round(quote, 2) AS quote, n FROM bars", text=("d",))
def ohlcv_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).withColumn("quote", F.round("quote", 2))


@query(f"""WITH {BARS_SQL} SELECT asset, strftime(d, '%Y-%m') AS month, arg_min(open, d) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, d) AS close, sum(volume) AS volume, count(*) AS n_days, max(d) AS last_day FROM bars GROUP BY 1, 2""", text=("last_day",))
def ohlcv_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months from days: first open, last close, summed volume."""
    return bars(spark, sf_dir).groupBy("asset", F.date_format("d", "yyyy-MM").alias("month")).agg(
        F.min_by("open", "d").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "d").alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("n_days"), F.max("d").alias("last_day"),
    )


@query(f"""WITH {BARS_SQL} SELECT asset, CAST(date_trunc('week', d) AS DATE) AS week, arg_min(open, d) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, d) AS close, sum(volume) AS volume, count(*) AS n_days FROM bars GROUP BY 1, 2""", text=("week",))
def ohlcv_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).groupBy("asset", F.to_date(F.date_trunc("week", "d")).alias("week")).agg(
        F.min_by("open", "d").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "d").alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("n_days"),
    )


@query("""WITH h AS (SELECT hour(ts) AS hour, value FROM events), a AS (SELECT hour, avg(value) AS mean, median(value) AS median, count(*) AS n FROM h GROUP BY hour)
SELECT hour, round(mean, 6) AS mean, round(median, 6) AS median, n, round(100 * mean / (SELECT avg(mean) FROM a), 6) AS idx FROM a""")
def hourly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasonality by hour: mean, median, and 100 * mean over the mean of hourly means (24 rows after the aggregation)."""
    a = events(spark, sf_dir).groupBy(F.hour("ts").alias("hour")).agg(F.avg("value").alias("mean"), F.expr("percentile(value, 0.5)").alias("median"), F.count("*").alias("n"))
    return rounded(a.withColumn("idx", 100 * F.col("mean") / F.avg("mean").over(Window.partitionBy())))


@query(f"""WITH {TRADES_SQL}, s AS (SELECT asset, notional, row_number() OVER (PARTITION BY asset ORDER BY notional) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM trades)
SELECT asset, max(notional) FILTER (i = least(n - 1, CAST(floor(n * 0.5) AS BIGINT))) AS med_notional,
  max(notional) FILTER (i = least(n - 1, CAST(floor(n * 0.99) AS BIGINT))) AS p99_notional FROM s GROUP BY asset""")
def notional_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles: the value at place floor(n * p). Ranks come from counts of distinct values, pre-aggregated."""
    v = trades(spark, sf_dir).groupBy("asset", "notional").agg(F.count("*").alias("c"))
    w = Window.partitionBy("asset").orderBy("notional")
    r = v.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("asset")))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * p)), F.col("notional")))
    return r.groupBy("asset").agg(at(0.5).alias("med_notional"), at(0.99).alias("p99_notional"))


@query()
def notional_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of one bounded sketch per asset, in place of a reservoir sample."""
    q = F.percentile_approx("notional", F.array(F.lit(0.5), F.lit(0.99)), 10_000)
    return trades(spark, sf_dir).groupBy("asset").agg(q.alias("q")).select("asset", F.col("q")[0].alias("med_notional"), F.col("q")[1].alias("p99_notional"))


@query("""WITH s AS (SELECT c_nationkey AS k, sum(greatest(c_acctbal, 0)) AS v FROM customer GROUP BY 1), t AS (SELECT k, v / (SELECT sum(v) FROM s) AS share FROM s),
r AS (SELECT share, row_number() OVER (ORDER BY share DESC, k) AS i FROM t) SELECT round(sum(share * share), 9) AS hhi, round(sum(share) FILTER (i <= 3), 9) AS top3 FROM r""")
def hhi_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration of balances over nations: sum of squared shares, and the three largest shares."""
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("v"))
    s = s.withColumn("share", F.col("v") / F.sum("v").over(Window.partitionBy()))
    s = s.withColumn("i", F.row_number().over(Window.orderBy(F.desc("share"), "k")))
    return rounded(s.agg(F.sum(F.col("share") * F.col("share")).alias("hhi"), F.sum(F.when(F.col("i") <= 3, F.col("share"))).alias("top3")), 9)


@query(f"""WITH {TRADES_SQL} SELECT asset, round(sum(qty) FILTER (NOT buy) / nullif(sum(qty) FILTER (buy), 0), 9) AS volume_ratio,
  round(count(*) FILTER (NOT buy) / nullif(count(*) FILTER (buy), 0), 9) AS count_ratio,
  round(avg(price) FILTER (NOT buy) - avg(price) FILTER (buy), 6) AS skew FROM trades GROUP BY asset""")
def skew_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of one side to the other, and the difference of mean prices; null where there is no other side."""
    buy = F.col("buy")
    return trades(spark, sf_dir).groupBy("asset").agg(
        F.round(ratio(F.sum(F.when(~buy, F.col("qty"))), F.sum(F.when(buy, F.col("qty")))), 9).alias("volume_ratio"),
        F.round(ratio(F.count_if(~buy), F.count_if(buy)), 9).alias("count_ratio"),
        F.round(F.avg(F.when(~buy, F.col("price"))) - F.avg(F.when(buy, F.col("price"))), 6).alias("skew"),
    )


@query(f"""WITH {TRADES_SQL}, l AS (SELECT asset, buy, round(price / 50) * 50 AS level, sum(qty) AS qty FROM trades GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY asset, buy ORDER BY CASE WHEN buy THEN -level ELSE level END) AS pos FROM l)
SELECT asset, buy, level, qty, pos FROM r WHERE pos <= 10""")
def level_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best price levels of each side of a book built from trades."""
    return _ladder(trades(spark, sf_dir)).where(F.col("pos") <= 10)


def _ladder(t: DataFrame) -> DataFrame:
    levels = t.groupBy("asset", "buy", (F.round(F.col("price") / 50) * 50).alias("level")).agg(F.sum("qty").alias("qty"))
    best = Window.partitionBy("asset", "buy").orderBy(F.when(F.col("buy"), -F.col("level")).otherwise(F.col("level")))
    return levels.withColumn("pos", F.row_number().over(best))


@query(f"""WITH {TRADES_SQL}, l AS (SELECT asset, round(price / 50) * 50 AS level, sum(qty) AS qty FROM trades WHERE NOT buy GROUP BY 1, 2),
c AS (SELECT *, sum(level * qty) OVER (PARTITION BY asset ORDER BY level) - level * qty AS before FROM l),
t AS (SELECT asset, level, greatest(least(level * qty, 1000000 - before), 0) AS spent FROM c),
b AS (SELECT asset, min(level) AS best FROM l GROUP BY asset)
SELECT t.asset, round(sum(spent), 2) AS filled, round(sum(spent) / nullif(sum(spent / nullif(level, 0)), 0), 6) AS avg_price,
  round((sum(spent) / nullif(sum(spent / nullif(level, 0)), 0) / nullif(any_value(best), 0) - 1) * 10000, 6) AS slippage_bps
FROM t JOIN b ON t.asset = b.asset GROUP BY t.asset""")
def depth_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of taking one million from the cheapest levels up."""
    levels = trades(spark, sf_dir).where(~F.col("buy")).groupBy("asset", (F.round(F.col("price") / 50) * 50).alias("level")).agg(F.sum("qty").alias("qty"))
    w = Window.partitionBy("asset").orderBy("level")
    worth = F.col("level") * F.col("qty")
    c = levels.withColumn("before", F.sum(worth).over(w) - worth).withColumn("best", F.min("level").over(Window.partitionBy("asset")))
    c = c.withColumn("spent", F.greatest(F.least(worth, 1_000_000.0 - F.col("before")), F.lit(0.0)))
    price = ratio(F.sum("spent"), F.sum(ratio("spent", "level")))
    return rounded(c.groupBy("asset").agg(F.sum("spent").alias("filled"), price.alias("avg_price"), ((ratio(price, F.first("best")) - 1) * 10_000).alias("slippage_bps")), 6, filled=2)


@query(f"""WITH {TRADES_SQL}, l AS (SELECT asset, buy, round(price / 50) * 50 AS level, sum(qty) AS qty FROM trades GROUP BY 1, 2, 3),
b AS (SELECT asset, level, qty AS bid FROM l WHERE buy), a AS (SELECT asset, level, qty AS ask FROM l WHERE NOT buy)
SELECT coalesce(a.asset, b.asset) AS asset, coalesce(a.level, b.level) AS level, bid, ask FROM a FULL JOIN b ON a.asset = b.asset AND a.level = b.level""")
def ladder_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bids and asks side by side by price level."""
    levels = trades(spark, sf_dir).groupBy("asset", "buy", (F.round(F.col("price") / 50) * 50).alias("level")).agg(F.sum("qty").alias("qty"))
    bid, ask = levels.where("buy").select("asset", "level", F.col("qty").alias("bid")), levels.where("not buy").select("asset", "level", F.col("qty").alias("ask"))
    return ask.join(bid, ["asset", "level"], "full").select("asset", "level", "bid", "ask")


@query(f"""WITH {TRADES_SQL}, l AS (SELECT asset, buy, round(price / 50) * 50 AS level, sum(qty) AS qty FROM trades GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY asset, buy ORDER BY CASE WHEN buy THEN -level ELSE level END) AS pos FROM l)
SELECT asset, round((sum(qty) FILTER (buy) - sum(qty) FILTER (NOT buy)) / sum(qty), 9) AS imbalance,
  min(level) FILTER (NOT buy) - max(level) FILTER (buy) AS spread, (min(level) FILTER (NOT buy) + max(level) FILTER (buy)) / 2 AS mid
FROM r WHERE pos <= 20 GROUP BY asset""")
def book_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imbalance, spread and middle of the 20 best levels."""
    top = _ladder(trades(spark, sf_dir)).where(F.col("pos") <= 20)
    bid, ask = F.sum(F.when(F.col("buy"), F.col("qty"))), F.sum(F.when(~F.col("buy"), F.col("qty")))
    low_ask, high_bid = F.min(F.when(~F.col("buy"), F.col("level"))), F.max(F.when(F.col("buy"), F.col("level")))
    return top.groupBy("asset").agg(F.round((bid - ask) / F.sum("qty"), 9).alias("imbalance"), (low_ask - high_bid).alias("spread"), ((low_ask + high_bid) / 2).alias("mid"))


@query("""SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts by group."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join: the fact is aggregated by supplier first, so the dimensions meet a small table."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"), F.count("*").alias("c"))
    joined = per.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.sum("c").alias("n"))


@query(f"""WITH {BARS_SQL}, m AS (SELECT asset, d, quote, row_number() OVER (PARTITION BY asset, strftime(d, '%Y-%m') ORDER BY quote DESC, d) AS r, strftime(d, '%Y-%m') AS month FROM bars)
SELECT asset, month, round(sum(quote) FILTER (r <= 5), 2) AS top5, round(sum(quote) FILTER (r <= 5) + 0.1 * sum(quote), 2) AS total FROM m GROUP BY asset, month""")
def topk_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest of each month, and these plus a tenth of all."""
    w = Window.partitionBy("asset", "month").orderBy(F.desc("quote"), "d")
    m = bars(spark, sf_dir).withColumn("month", F.date_format("d", "yyyy-MM")).withColumn("r", F.row_number().over(w))
    top = F.sum(F.when(F.col("r") <= 5, F.col("quote")))
    return m.groupBy("asset", "month").agg(F.round(top, 2).alias("top5"), F.round(top + 0.1 * F.sum("quote"), 2).alias("total"))


@query("""WITH o AS (SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS d, l_partkey % 30 AS term, 20 + 100 * l_discount AS iv, l_quantity AS oi FROM lineitem),
g AS (SELECT asset, d, sum(iv * oi) / sum(oi) AS iv, sum(iv * oi) FILTER (term <= 15) / sum(oi) FILTER (term <= 15) AS near, sum(iv * oi) FILTER (term > 15) / sum(oi) FILTER (term > 15) AS far FROM o GROUP BY 1, 2)
SELECT asset, d, round(iv, 6) AS iv, round(far - near, 6) AS slope, CASE WHEN near > far THEN 'BACKWARDATION' WHEN near < far THEN 'CONTANGO' END AS shape FROM g""", text=("d",))
def term_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility weighted by open interest, near against far terms; one pass."""
    t = table(spark, sf_dir, "lineitem")
    o = t.select(F.col("l_returnflag").alias("asset"), F.to_date("l_shipdate").alias("d"), (F.col("l_partkey") % 30).alias("term"), (20 + 100 * F.col("l_discount")).alias("iv"), F.col("l_quantity").alias("oi"))
    mean = lambda hit: ratio(F.sum(F.when(hit, F.col("iv") * F.col("oi"))), F.sum(F.when(hit, F.col("oi"))))
    g = o.groupBy("asset", "d").agg(mean(F.lit(True)).alias("iv"), mean(F.col("term") <= 15).alias("near"), mean(F.col("term") > 15).alias("far"))
    shape = F.when(F.col("near") > F.col("far"), "BACKWARDATION").when(F.col("near") < F.col("far"), "CONTANGO")
    return rounded(g.select("asset", "d", "iv", (F.col("far") - F.col("near")).alias("slope"), shape.alias("shape")))
