"""Statistical operators as aggregations and windows: bins, information, ranks, AUC, false discovery, bootstrap, purged folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio


def equal_bins(df: DataFrame, key: str, x: str, out: str, n: int) -> DataFrame:
    """The equal-width bin of x between its key's extremes; the last bin is closed."""
    w = Window.partitionBy(key)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return df.withColumn(out, F.least(F.floor(ratio(F.col(x) - low, high - low) * n), F.lit(n - 1)).cast("int"))


def mutual_information(joint: DataFrame, key: str, a: str, b: str, n: str) -> DataFrame:
    """Mutual information from joint counts."""
    total, pa, pb = F.sum(n).over(Window.partitionBy(key)), F.sum(n).over(Window.partitionBy(key, a)), F.sum(n).over(Window.partitionBy(key, b))
    s = joint.select(key, (F.col(n) / total).alias("p"), (pa / total).alias("pa"), (pb / total).alias("pb"))
    return s.groupBy(key).agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"))


def average_rank(x: str, key: str) -> Column:
    """Rank from 1, ties sharing their mean."""
    return F.rank().over(Window.partitionBy(key).orderBy(x)) + (F.count("*").over(Window.partitionBy(key, x)) - 1) / 2


def auc(df: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """Area under the curve by Mann-Whitney, from counts of each distinct score (pre-aggregated on the map side)."""
    c = df.groupBy(key, score).agg(F.count("*").alias("_n"), F.count_if(F.col(label) == 1).alias("_p"))
    upto = F.sum("_n").over(Window.partitionBy(key).orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("_rank", F.coalesce(upto, F.lit(0)) + (F.col("_n") + 1) / 2)
    p, n = F.sum("_p"), F.sum("_n")
    return c.groupBy(key).agg(n.alias("n"), F.round(ratio(F.sum(F.col("_p") * F.col("_rank")) - p * (p + 1) / 2, p * (n - p)), 9).alias("auc"))


def benjamini_hochberg(df: DataFrame, key: str, p: str, tie: str) -> DataFrame:
    """df with q values within each key."""
    w = Window.partitionBy(key).orderBy(p, tie)
    k = df.withColumn("_i", F.row_number().over(w)).withColumn("_m", F.count("*").over(Window.partitionBy(key)))
    down = Window.partitionBy(key).orderBy(F.desc("_i"))
    return k.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_i")).over(down))).drop("_i", "_m")


def bootstrap_mean(df: DataFrame, key: str, x: str, order: str, replicates: int = 200, block: int = 1, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean of x by (moving-block) bootstrap with a hash as the source of chance.

    Instead of building resamples, each block is drawn a Poisson(1) number of times in each replicate (the known limit of
    multinomial draws), so rows are read once, every replicate's sums are partial aggregates, and nothing is joined.
    """
    w = Window.partitionBy(key).orderBy(order)
    b = df.where(F.col(x).isNotNull()).withColumn("_b", F.floor((F.row_number().over(w) - 1) / block)) if block > 1 else df.where(F.col(x).isNotNull()).withColumn("_b", F.xxhash64(order))
    sums = b.groupBy(key, "_b").agg(F.sum(x).alias("_s"), F.count("*").alias("_n"))
    reps = sums.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = (F.pmod(F.xxhash64(F.lit(seed), key, "_b", "_r"), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    # The Poisson(1) distribution function.
    cuts = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998980)
    times = sum(((u > c).cast("int") for c in cuts), F.lit(0))
    means = reps.withColumn("_k", times).groupBy(key, "_r").agg(ratio(F.sum(F.col("_k") * F.col("_s")), F.sum(F.col("_k") * F.col("_n"))).alias("_m"))
    point = sums.groupBy(key).agg((F.sum("_s") / F.sum("_n")).alias("mean"), F.sum("_n").alias("n"))
    ci = means.groupBy(key).agg(F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"), F.avg((F.col("_m") > 0).cast("double")).alias("p_positive"))
    return point.join(ci, key)


def purged_folds(df: DataFrame, key: str, order: str, folds: int, horizon: int) -> DataFrame:
    """df once for each fold it trains or tests in: fold, and role 'test' or 'train'. Rows within horizon of a test block are
    left out of its training."""
    w = Window.partitionBy(key).orderBy(order)
    n = F.count("*").over(Window.partitionBy(key))
    at = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", n).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    low, high = F.floor(F.col("fold") * F.col("_n") / folds), F.floor((F.col("fold") + 1) * F.col("_n") / folds)
    role = F.when((F.col("_i") >= low) & (F.col("_i") < high), "test").when((F.col("_i") < low - horizon) | (F.col("_i") >= high + horizon), "train")
    return at.withColumn("role", role).where("role IS NOT NULL").drop("_i", "_n")
