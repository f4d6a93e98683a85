"""Streaming jobs run to the end of their input; the twins are the batch results they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_folder
from ..sources.tables import table
from ..streaming import jobs as J  # noqa: N812
from ..streaming import state as O  # noqa: E741, N812
from .registry import query


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_daily_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = J.run_available(J.daily_flow(J.events_stream(spark, sf_dir)), "daily", "update")
    return J.last_state(got, ["day", "event_type"]).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT *, round_even(value, 0) AS v, lag(round_even(value, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, event_id, v FROM e WHERE p IS NULL OR p <> v""")
def stream_change_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.run_available(J.change_only(J.events_stream(spark, sf_dir)), "changes", "append").drop("_batch")


@query("""SELECT a.user_id, a.event_id AS signup, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'signup' AND b.event_type = 'purchase'""")
def stream_label_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.run_available(J.resolve_labels(J.events_stream(spark, sf_dir)), "labels", "append").drop("_batch")


@query("""SELECT event_id, user_id, value FROM events""")
def stream_unique_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.run_available(J.unique_ticks(J.events_stream(spark, sf_dir)), "ticks", "append").drop("_batch")


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 21600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g), t AS (SELECT user_id, s, count(*) AS n, sum(value) AS total FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, sum(n) AS n, round(sum(total), 4) AS total FROM t GROUP BY 1""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows, closed by the end of the input (complete mode keeps all of them)."""
    got = J.run_available(J.sessions(J.events_stream(spark, sf_dir)), "sessions", "complete")
    s = J.last_state(got, ["user_id", "start"])
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


_CUT = "SELECT max(epoch_ms(ts)) - 86400000 FROM events"
_GAIN = f"((s.spread + {O.DRIFT}) / (s.spread + {O.DRIFT} + {O.NOISE}))"


@query(f"""WITH RECURSIVE o AS (SELECT event_type, event_id, epoch_ms(ts) AS at, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i
  FROM events WHERE epoch_ms(ts) <= ({_CUT})),
s AS (SELECT event_type, 0::BIGINT AS event_id, 0::BIGINT AS i, NULL::DOUBLE AS mean, NULL::DOUBLE AS level, 1.0::DOUBLE AS spread, 0 AS bad, NULL::BIGINT AS opened,
  0 AS trips, FALSE AS held FROM (SELECT DISTINCT event_type FROM o)
UNION ALL SELECT o.event_type, o.event_id, o.i,
  CASE WHEN shut OR NOT fits THEN s.mean WHEN s.mean IS NULL THEN x ELSE {O.ALPHA} * x + (1 - {O.ALPHA}) * s.mean END,
  CASE WHEN shut OR NOT fits THEN s.level WHEN s.mean IS NULL THEN x ELSE s.level + {_GAIN} * (x - s.level) END,
  CASE WHEN shut OR NOT fits THEN s.spread WHEN s.mean IS NULL THEN 1.0 ELSE (1 - {_GAIN}) * (s.spread + {O.DRIFT}) END,
  CASE WHEN shut THEN s.bad WHEN fits OR s.bad + 1 >= {O.MAX_BAD} THEN 0 ELSE s.bad + 1 END,
  CASE WHEN shut THEN s.opened WHEN NOT fits AND s.bad + 1 >= {O.MAX_BAD} THEN o.at END,
  s.trips + CASE WHEN NOT shut AND NOT fits AND s.bad + 1 >= {O.MAX_BAD} THEN 1 ELSE 0 END, shut OR NOT fits
  FROM s JOIN o ON o.event_type = s.event_type AND o.i = s.i + 1,
  LATERAL (SELECT s.opened IS NOT NULL AND o.at < s.opened + {O.COOL_MS} AS shut, x BETWEEN {O.RANGE[0]} AND {O.RANGE[1]} AS fits) k)
SELECT event_type, event_id, i AS n, round(mean, 6) AS mean, round(level, 6) AS level, bad, trips, held FROM s WHERE i > 0""")
def stream_online_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online levels of each metric over several batches with late rows; the twin folds the same rows in order of time."""
    path = shared_folder(spark, "arrivals")
    stream = O.in_batches(table(spark, sf_dir, "events").drop("props"), path, 4)
    with O.state_store(spark):
        got = J.run_available(O.online_levels(stream), "levels", "append").drop("_batch")
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "level")}).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("mean", "level")})


@query("""SELECT event_type, user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 6) AS value
FROM events GROUP BY 1, 2""", text=("ts",))
def stream_last_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each user and type, kept as a published table by a stream; the last batch is then run once more."""
    path = shared_folder(spark, "last-values")
    stream = O.in_batches(table(spark, sf_dir, "events").drop("props"), f"{path}/in", 4).drop("at")
    sink = O.keep_last(f"{path}/table", ["event_type", "user_id"], ["ts", "event_id"])
    O.run_sink(stream, sink, f"{path}/state")
    sink(spark.read.parquet(f"{path}/in").limit(0), 3)  # a replayed batch: nothing changes
    return O.last_values(spark, f"{path}/table").select("event_type", "user_id", "ts", "event_id", F.round("value", 6).alias("value"))
