"""Structured Streaming jobs; run_available() runs one over what is there now and returns its table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.storage import shared_folder

#: How long the state of a silent key is kept.
KEEP_STATE_MS = 30 * 86_400_000
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a file stream, with a proper event time."""
    return spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events*.parquet").withColumn("at", F.col("ts").cast("timestamp"))


def run_available(out: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a streaming frame until its input is used up; every batch is one idempotent write, numbered by _batch."""
    spark = out.sparkSession
    folder = shared_folder(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/b={number}")

    q = out.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").withColumnRenamed("b", "_batch")


def last_state(table: DataFrame, key: list[str]) -> DataFrame:
    """The newest row of each key of an update-mode table."""
    w = Window.partitionBy(*key).orderBy(F.desc("_batch"))
    return table.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_batch")


def daily_flow(events: DataFrame) -> DataFrame:
    """Tumbling days with a watermark of two days for late rows."""
    e = events.withWatermark("at", "2 days")
    return e.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def change_only(events: DataFrame) -> DataFrame:
    """Values that differ from the user's one before; state is the last value and its time, so rows older than it are dropped, and
    it goes when the watermark has passed it by KEEP_STATE_MS."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen = state.get if state.exists else (None, None)
        # A user's rows come in several frames, whose labels repeat: they are numbered anew.
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"], ignore_index=True)
        if seen is not None:
            rows = rows[rows["at"].astype("datetime64[us]").astype("int64") >= seen]
        v = rows["value"].round()
        prior = v.shift(1)
        if len(prior):
            prior.iloc[0] = last if last is not None else float("nan")
            newest = int(rows["at"].astype("datetime64[us]").astype("int64").iloc[-1])
            state.update((float(v.iloc[-1]), newest))
            state.setTimeoutTimestamp(max(newest // 1000, state.getCurrentWatermarkMs()) + KEEP_STATE_MS)
        out = rows[prior.isna() | (prior != v)]
        yield pd.DataFrame({"user_id": out["user_id"], "event_id": out["event_id"], "v": v[out.index]})

    rows = events.withWatermark("at", "2 days").select("user_id", "event_id", "at", "value")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, v double", "v double, at long", "append", GroupStateTimeout.EventTimeTimeout)


def resolve_labels(events: DataFrame) -> DataFrame:
    """Signups joined with purchases of the same user in the six hours that follow; both sides' state is bounded by watermarks."""
    a = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup"), F.col("at").alias("t0")).withWatermark("t0", "1 hour")
    b = events.where("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("event_id").alias("purchase"), F.col("at").alias("t1")).withWatermark("t1", "1 hour")
    return a.join(b, F.expr("user_id = u AND t1 > t0 AND t1 <= t0 + INTERVAL 6 HOURS")).select("user_id", "signup", "purchase")


def sessions(events: DataFrame) -> DataFrame:
    """Session windows of six hours by user."""
    e = events.withWatermark("at", "2 days")
    return e.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")


def unique_ticks(events: DataFrame) -> DataFrame:
    """Each tick once, duplicates within a day dropped."""
    return events.withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "value")
