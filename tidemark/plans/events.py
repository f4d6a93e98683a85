"""Event streams as tables: sessions, change-only emission, label resolution, books of orders, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import series as S
from ..sources.tables import BARS_SQL, bars, events
from .registry import query

D = ("d",)


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, s AS session, count(*) AS n, round(sum(value), 4) AS total, CAST(min(event_id) AS BIGINT) AS first_event FROM s GROUP BY 1, 2""")
def islands_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions: events of a user at most six hours apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    g = events(spark, sf_dir).withColumn("new", (gap.isNull() | (gap > 21_600_000_000)).cast("int"))
    s = g.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("event_id").alias("first_event"))


@query(f"""WITH {BARS_SQL}, s AS (SELECT asset, d FROM (SELECT asset, d, close / max(close) OVER (PARTITION BY asset ORDER BY d) - 1 AS dd FROM bars) WHERE dd < -0.95),
g AS (SELECT *, sum(CASE WHEN d - lag_d <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY d) AS k FROM (SELECT *, lag(d) OVER (PARTITION BY asset ORDER BY d) AS lag_d FROM s))
SELECT asset, min(d) AS d, count(*) AS days FROM g GROUP BY asset, k""", text=D)
def stress_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stress days at most three days apart become one episode."""
    w = S.over("asset", "d")
    s = bars(spark, sf_dir).withColumn("dd", S.drawdown("close", w)).where("dd < -0.95").select("asset", "d")
    return S.islands(s, "asset", "d", 3).groupBy("asset", "_island").agg(F.min("d").alias("d"), F.count("*").alias("days")).select("asset", "d", "days")


@query("""WITH e AS (SELECT *, round(value) AS v, lag(round(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, event_id, v FROM e WHERE p IS NULL OR p <> v""")
def change_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only values that differ from the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, sf_dir).withColumn("v", F.round("value")).withColumn("p", F.lag(F.round("value")).over(w))
    return e.where("p IS NULL OR p <> v").select("user_id", "event_id", "v")


@query("""WITH b AS (SELECT e.event_id, e.user_id, e.value, e.ts + INTERVAL 6 HOUR AS want FROM events e), t AS (SELECT b.event_id, b.value, f.value AS later, row_number() OVER (PARTITION BY b.event_id ORDER BY abs(epoch_us(f.ts) - epoch_us(b.want)), f.ts, f.event_id) AS k
FROM b JOIN events f ON b.user_id = f.user_id AND f.ts BETWEEN b.want - INTERVAL 1 HOUR AND b.want + INTERVAL 1 HOUR)
SELECT b.event_id, CASE WHEN t.later IS NULL THEN NULL WHEN t.later < 0.97 * b.value THEN 1 ELSE 0 END AS label FROM b LEFT JOIN t ON b.event_id = t.event_id AND t.k = 1""")
def label_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pending label is set by the event nearest to six hours later, within an hour; else it stays null.

    The range is cut into hourly slots, so each event meets at most three slots of its own user.
    """
    e = events(spark, sf_dir)
    hour = 3_600_000_000
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    b = e.select("event_id", "user_id", "value", (us + 6 * hour).alias("want")).withColumn("slot", F.explode(F.sequence(F.floor((F.col("want") - hour) / hour), F.floor((F.col("want") + hour) / hour))))
    f = e.select("user_id", F.col("value").alias("later"), us.alias("at"), F.col("event_id").alias("fid"), F.floor(us / hour).alias("slot"))
    near = b.join(f, ["user_id", "slot"]).where(F.abs(F.col("at") - F.col("want")) <= hour)
    got = near.groupBy("event_id").agg(F.min_by("later", F.struct(F.abs(F.col("at") - F.col("want")), "at", "fid")).alias("later"))
    out = e.select("event_id", "value").join(got, "event_id", "left")
    return out.select("event_id", F.when(F.col("later").isNull(), None).when(F.col("later") < 0.97 * F.col("value"), 1).otherwise(0).alias("label"))


@query("""WITH m AS (SELECT user_id % 40 AS side_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS order_id, CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'F' ELSE 'A' END AS action, value, ts, event_id FROM events),
l AS (SELECT side_id, order_id, arg_max(action, (ts, event_id)) AS action, arg_max(value, (ts, event_id)) AS price FROM m GROUP BY 1, 2), o AS (SELECT * FROM l WHERE action = 'A')
SELECT side_id, count(*) AS open_orders, round(min(price), 4) AS best_ask, round(max(price), 4) AS best_bid, round(avg(price), 6) AS mean_price FROM o GROUP BY side_id""")
def order_book_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders alive after adds, changes, deletions and fills: the last message of each order decides."""
    order = F.from_json("props", "k long")["k"].alias("order_id")
    m = events(spark, sf_dir).select((F.col("user_id") % 40).alias("side_id"), order, F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "F").otherwise("A").alias("action"), "value", F.struct("ts", "event_id").alias("k"))
    last = m.groupBy("side_id", "order_id").agg(F.max_by("action", "k").alias("action"), F.max_by("value", "k").alias("price")).where("action = 'A'")
    return last.groupBy("side_id").agg(F.count("*").alias("open_orders"), F.round(F.min("price"), 4).alias("best_ask"), F.round(F.max("price"), 4).alias("best_bid"), F.round(F.avg("price"), 6).alias("mean_price"))


@query("""SELECT event_type, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, count(*) AS n, round(sum(value), 4) AS total, round(arg_max(value, (ts, event_id)), 4) AS last_value FROM events GROUP BY 1, 2""")
def tumbling_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of each event type."""
    k = F.struct("ts", "event_id")
    out = events(spark, sf_dir).groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max_by("value", k), 4).alias("last_value"))
    return out.select("event_type", F.col("w.start").cast("string").alias("hour"), "n", "total", "last_value")


@query("""WITH w AS (SELECT unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS s, value FROM events) SELECT CAST(s AS VARCHAR) AS start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY s""")
def sliding_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of seven days that begin every day."""
    out = events(spark, sf_dir).groupBy(F.window("ts", "7 days", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("string").alias("start"), "n", "total")


@query("""SELECT conv_id, count(*) AS turns, arg_min(role, turn) AS opener, sum(length(text)) AS chars, count(*) FILTER (role = 'user') AS user_turns FROM conversations GROUP BY 1""")
def conversation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as ordered sequences."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("role", "turn").alias("opener"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("role") == "user").alias("user_turns"))


@query("""WITH m AS (SELECT event_type, max(ts) AS newest FROM events GROUP BY 1), n AS (SELECT max(newest) AS now FROM m), l AS (SELECT event_type, user_id % 10 AS source, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2),
a AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1) SELECT l.event_type, source, l.ts < now - INTERVAL 12 HOUR AS stale, round(CASE WHEN l.ts < now - INTERVAL 12 HOUR THEN mean ELSE value END, 6) AS value FROM l, n, a WHERE l.event_type = a.event_type""")
def staleness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest value of each source if it is fresh, and else the fallback of its kind."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", (F.col("user_id") % 10).alias("source"), "ts", "event_id", "value")
    now = F.max("at").over(Window.partitionBy(F.lit(0)))  # one row for each source and kind
    g = e.groupBy("event_type", "source").agg(F.max("ts").alias("at"), F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.sum("value").alias("total"), F.count("value").alias("n"))
    kind = Window.partitionBy("event_type")
    stale = F.col("at") < now - F.expr("INTERVAL 12 HOURS")
    g = g.withColumns({"stale": stale, "mean": F.sum("total").over(kind) / F.sum("n").over(kind)})
    return g.select("event_type", "source", "stale", F.round(F.when(F.col("stale"), F.col("mean")).otherwise(F.col("value")), 6).alias("value"))
