"""Time-series operators over frames with a series key and an order: returns, rolling, expanding and robust frames, LOCF, as-of
and nearest joins, gaps, runs of days. All partition by the series key, so series run in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clamp, col, normal_cdf, ratio


def over(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def pct_change(x, w, k: int = 1) -> Column:
    """x over its value k rows before, less one."""
    return ratio(col(x), F.lag(col(x), k).over(w)) - 1


def log_return(x, w, k: int = 1) -> Column:
    return F.ln(col(x)) - F.ln(F.lag(col(x), k).over(w))


def forward_return(x, w, h: int) -> Column:
    """The return over the next h rows: a label, the only thing that looks ahead."""
    return ratio(F.lead(col(x), h).over(w), col(x)) - 1


def full(value: Column, x, frame, least: int) -> Column:
    """value where the frame holds at least so many non-null x."""
    return F.when(F.count(col(x)).over(frame) >= least, value)


def rolling(f, x, w, n: int, least: int | None = None) -> Column:
    """f over the last n rows including this one; null until least (n) values are there."""
    frame = w.rowsBetween(1 - n, 0)
    return full(f(col(x)).over(frame), x, frame, n if least is None else least)


def rolling_quantile(x, w, n: int, q: float, least: int) -> Column:
    frame = w.rowsBetween(1 - n, 0)
    return full(F.percentile(col(x), F.lit(q)).over(frame), x, frame, least)


def expanding_z(x, w, least: int = 30) -> Column:
    """z against all rows up to this one."""
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    return full(ratio(col(x) - F.avg(col(x)).over(frame), F.stddev_samp(col(x)).over(frame)), x, frame, least)


def trailing_z(x, w, n: int, least: int) -> Column:
    """z against the n rows before this one, without it."""
    frame = w.rowsBetween(-n, -1)
    return full(ratio(col(x) - F.avg(col(x)).over(frame), F.stddev_pop(col(x)).over(frame)), x, frame, least)


def robust_z(df: DataFrame, x: str, out: str, key: str, order: str, n: int, least: int) -> DataFrame:
    """(x - median) / (1.4826 * MAD) over a trailing frame; the MAD is about each row's own median."""
    frame = over(key, order).rowsBetween(1 - n, 0)
    df = df.withColumn("_med", F.percentile(x, F.lit(0.5)).over(frame)).withColumn("_held", F.collect_list(x).over(frame))
    off = F.array_sort(F.transform("_held", lambda v: F.abs(v - F.col("_med"))))
    size = F.size("_held")
    middle = (F.get(off, F.floor((size - 1) / 2).cast("int")) + F.get(off, F.floor(size / 2).cast("int"))) / 2
    return df.withColumn(out, F.when(size >= least, ratio(F.col(x) - F.col("_med"), 1.4826 * middle))).drop("_med", "_held")


def robust_pct(df: DataFrame, x: str, out: str, key: str, order: str, n: int, least: int) -> DataFrame:
    """The robust z as a percentile (0 to 100) by the normal law, cut at three deviations."""
    df = robust_z(df, x, "_z", key, order, n, least)
    return df.withColumn(out, 100 * normal_cdf(clamp("_z", -3.0, 3.0))).drop("_z")


def rolling_rank(x: str, w, n: int, least: int) -> Column:
    """The percentile rank of x in its trailing frame, ties averaged."""
    held = F.collect_list(col(x)).over(w.rowsBetween(1 - n, 0))
    less = F.size(F.filter(held, lambda v: v < col(x)))
    same = F.size(F.filter(held, lambda v: v == col(x)))
    return F.when(F.size(held) >= least, (less + (same + 1) / 2) / F.size(held))


def drawdown(x, w) -> Column:
    """x over its running maximum, less one."""
    return ratio(col(x), F.max(col(x)).over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1


def locf(x, w, limit: int | None = None) -> Column:
    """The last non-null x up to this row, at most limit rows old."""
    frame = w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return F.last(col(x), ignorenulls=True).over(frame)


def asof(left: DataFrame, right: DataFrame, key: str, at: str, value: str, out: str, lookback_days: int | None = None) -> DataFrame:
    """left with the latest right value at or before its time, not older than lookback_days - 1 days.

    Both sides are laid in one order per key and the last value carried forward: one shuffle, no pairs of rows. Both have the
    columns key and at (a date or timestamp); right has one row per key and time.
    """
    cols = [c for c in left.columns if c not in (key, at)]
    one = left.select(key, at, F.lit(1).alias("_side"), F.struct(*cols).alias("_left") if cols else F.lit(1).alias("_left"), F.lit(None).cast("struct<v:double,t:timestamp>").alias("_seen"))
    two = right.select(key, at, F.lit(0).alias("_side"), F.lit(None).alias("_left"), F.struct(F.col(value).cast("double").alias("v"), F.col(at).cast("timestamp").alias("t")).alias("_seen"))
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = one.unionByName(two).withColumn("_got", F.last("_seen", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    fresh = F.lit(True) if lookback_days is None else F.date_diff(F.col(at), F.col("_got.t")) <= lookback_days - 1
    return both.select(key, at, *([f"_left.{c}" for c in cols]), F.when(fresh, F.col("_got.v")).alias(out))


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, value: str, out: str, tolerance: float) -> DataFrame:
    """left with the right value nearest in time on either side, within tolerance seconds (the earlier one on ties)."""
    cols = [c for c in left.columns if c not in (key, at)]
    seen = "struct<v:double,t:timestamp>"
    one = left.select(key, at, F.lit(1).alias("_side"), F.struct(F.lit(0).alias("_"), *cols).alias("_left"), F.lit(None).cast(seen).alias("_seen"))
    two = right.select(key, at, F.lit(0).alias("_side"), F.lit(None).alias("_left"), F.struct(F.col(value).cast("double").alias("v"), F.col(at).cast("timestamp").alias("t")).alias("_seen"))
    both = one.unionByName(two)
    back = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(at, F.desc("_side")).rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumns({"_b": F.last("_seen", ignorenulls=True).over(back), "_a": F.first("_seen", ignorenulls=True).over(ahead)}).where(F.col("_side") == 1)
    secs = lambda c: F.col(c).cast("timestamp").cast("double")
    db, da = secs(at) - secs("_b.t"), secs("_a.t") - secs(at)
    take_b = F.col("_b.t").isNotNull() & (F.col("_a.t").isNull() | (db <= da))
    gap = F.when(take_b, db).otherwise(da)
    value_ = F.when(take_b, F.col("_b.v")).otherwise(F.col("_a.v"))
    return both.select(key, at, *([f"_left.{c}" for c in cols]), F.when(gap <= tolerance, value_).alias(out), F.when(gap <= tolerance, gap).alias(f"{out}_gap"))


def islands(df: DataFrame, key: str, order: str, max_gap: int) -> DataFrame:
    """df with _island: rows of a key whose days lie at most max_gap apart share a number."""
    w = over(key, order)
    new = (F.date_diff(F.col(order), F.lag(order).over(w)) > max_gap) | F.lag(order).over(w).isNull()
    return df.withColumn("_island", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
