"""Keyed online state: a level per metric that is right whatever order its values come in, and a table of last values.

OnlineLevels keeps two states for each key: a value (exponential mean, Kalman level, run of values out of range, breaker) and a
list of values that still wait, packed in blocks of many, so that a value costs no call to the store of its own. A value is used
when the watermark has passed it, in order of time, so late rows within the delay change nothing; an event-time timer stands at
the earliest waiting value. The same timer clears a key that has been silent for KEEP_MS. State lives in Spark's state store (RocksDB), checkpointed with the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources import storage

ALPHA = 0.15  # of the exponential mean
DRIFT, NOISE = 0.001, 0.1  # of the Kalman level
RANGE = (1.0, 150.0)
MAX_BAD, COOL_MS = 2, 6 * 3_600_000  # values out of range in a row that open the breaker, and for how long
KEEP_MS = 30 * 86_400_000
DELAY = "1 day"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_D, _L, _I = T.DoubleType(), T.LongType(), T.IntegerType()
_LEVEL = T.StructType([T.StructField(n, t) for n, t in (("n", _L), ("mean", _D), ("level", _D), ("spread", _D), ("bad", _I), ("opened", _L), ("trips", _I), ("last", _L))])
_WAITING = T.StructType([T.StructField("rows", T.BinaryType())])  # a block of values as the bytes of a _ROW array
_ROW = np.dtype([("at", "<i8"), ("id", "<i8"), ("x", "<f8")])
BLOCK = 10_000
LEVELS = "event_type string, event_id long, n long, mean double, level double, bad int, trips int, held boolean"


def advance(s: tuple, at: int, x: float) -> tuple[tuple, bool]:
    """The state after one more value, and whether the breaker holds it back. While the breaker is open nothing but its clock
    changes; a value out of range is counted and not used."""
    n, mean, level, spread, bad, opened, trips, _ = s
    if opened >= 0 and at < opened + COOL_MS:
        return (n + 1, mean, level, spread, bad, opened, trips, at), True
    if not RANGE[0] <= x <= RANGE[1]:
        bad += 1
        if bad >= MAX_BAD:
            return (n + 1, mean, level, spread, 0, at, trips + 1, at), True
        return (n + 1, mean, level, spread, bad, -1, trips, at), True
    if np.isnan(mean):
        mean, level, spread = x, x, 1.0
    else:
        gain = (spread + DRIFT) / (spread + DRIFT + NOISE)
        mean, level, spread = ALPHA * x + (1 - ALPHA) * mean, level + gain * (x - level), (1 - gain) * (spread + DRIFT)
    return (n + 1, mean, level, spread, 0, -1, trips, at), False


NEW = (0, float("nan"), float("nan"), 1.0, 0, -1, 0, -1)


class OnlineLevels(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("level", _LEVEL)
        self.waiting = handle.getListState("waiting", _WAITING)

    def _wait(self, rows: np.ndarray) -> None:
        """Let rows wait too, with a timer at the earliest of them."""
        if len(rows):
            self.waiting.appendList([(rows[s : s + BLOCK].tobytes(),) for s in range(0, len(rows), BLOCK)])
            self.handle.registerTimer(int(rows["at"].min()) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed, fresh = timerValues.getCurrentWatermarkInMs(), []
        for f in rows:
            own = np.empty(len(f), _ROW)
            own["at"], own["id"], own["x"] = f["at_us"], f["event_id"], f["value"]
            fresh.append(own[own["at"] // 1000 > passed])
        if fresh:
            self._wait(np.concatenate(fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        held = np.frombuffer(b"".join(r[0] for r in self.waiting.get()) if self.waiting.exists() else b"", _ROW)
        used = held["at"] // 1000 <= passed
        due = held[used]
        state = tuple(self.value.get()) if self.value.exists() else NEW
        if not len(due):
            if not len(held) and state[-1] >= 0 and state[-1] // 1000 + KEEP_MS <= passed:
                self.value.clear()
            return
        due = due[np.lexsort((due["x"], due["id"], due["at"]))]
        for s in range(0, len(due), BLOCK):
            out = []
            for at, i, x in due[s : s + BLOCK].tolist():
                state, back = advance(state, at // 1000, x)
                out.append((key[0], i, state[0], state[1], state[2], state[4], state[6], back))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LEVELS.split(", ")])
        last = int(due["at"][-1])
        self.value.update(state[:-1] + (last,))
        self.waiting.clear()
        self._wait(held[~used])
        self.handle.registerTimer(last // 1000 + KEEP_MS)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which states of several variables need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def online_levels(events: DataFrame) -> DataFrame:
    """A row for each value of each key (event_type) in order of time, once the watermark has passed it."""
    rows = events.withWatermark("at", DELAY).select("event_type", "event_id", "value", "at", F.unix_micros("at").alias("at_us"))
    return rows.where("value IS NOT NULL").groupBy("event_type").transformWithStateInPandas(OnlineLevels(), LEVELS, "append", "eventTime")


def levels_of(rows: pd.DataFrame) -> pd.DataFrame:
    """The same in one piece, for one key's rows: the batch form."""
    state, out = NEW, []
    for at, i, x in sorted(zip(rows["at_us"], rows["event_id"], rows["value"], strict=True)):
        state, back = advance(state, int(at) // 1000, float(x))
        out.append((rows["event_type"].iloc[0], int(i), state[0], state[1], state[2], state[4], state[6], back))
    return pd.DataFrame(out, columns=[c.split()[0] for c in LEVELS.split(", ")])


def in_batches(events: DataFrame, path: str, files: int, jitter: str = "12 hours") -> DataFrame:
    """Events written as so many files in order of arrival, which is their time and up to `jitter` more: a stream of them, one
    file a batch, has late rows."""
    late = F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + late * F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00Z' + INTERVAL {jitter})")
    placed = events.withColumn("_a", arrival)
    low, high = placed.agg(F.min("_a"), F.max("_a")).first()
    width = ((high or 1) - (low or 0)) / files + 1
    for k in range(files):  # a fixed number of small writes, one after the other, so that files are as old as they should be
        part = placed.where((F.col("_a") >= (low or 0) + k * width) & (F.col("_a") < (low or 0) + (k + 1) * width))
        part.drop("_a").repartition(1).write.mode("append").parquet(path)
    spark = events.sparkSession
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def keep_last(path: str, key: list[str], order: list[str], keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the newest row of each key as a published table, a version for each batch.

    A batch that is run again finds its version published and changes nothing; rows older than what the table has do not
    replace it; readers see whole versions, and all but the newest `keep` are removed.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = storage.versions(spark, path)
        if known and known[-1] >= number:
            return
        rows = batch
        if known:
            rows = rows.unionByName(storage.published(spark, path))
        w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
        newest = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        storage.publish(newest, path, number)
        storage.expire(spark, path, keep)

    return put


def run_sink(stream: DataFrame, sink: Callable[[DataFrame, int], None], state: str) -> None:
    """Run a stream into a foreachBatch sink until its input is used up."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def last_values(spark: SparkSession, path: str) -> DataFrame:
    return storage.published(spark, path)
