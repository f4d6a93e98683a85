"""Leakage-aware validation and models: bootstrap, purged folds, walk-forward regression, calibration, clustering."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import corr, ratio, rounded
from ..operators import series as S
from ..operators import stats as ST
from ..sources.storage import shared_folder
from ..sources.tables import BARS_SQL, bars, table
from .registry import query

D = ("d",)
W = "OVER (PARTITION BY asset ORDER BY d)"


def _labelled(spark, sf_dir) -> DataFrame:
    """Two features known on the day, and whether the next week rose."""
    w = S.over("asset", "d")
    b = bars(spark, sf_dir).select("asset", "d", F.round(S.log_return("volume", w), 10).alias("x1"), F.round(S.drawdown("close", w), 10).alias("x2"), S.forward_return("close", w, 7).alias("y"))
    return b.dropna().withColumn("label", (F.col("y") > 0).cast("int"))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean weekly return by a moving-block bootstrap."""
    return rounded(ST.bootstrap_mean(_labelled(spark, sf_dir), "asset", "y", "d", 200, 7), 6)


@query(f"""WITH {BARS_SQL}, l AS (SELECT asset, d, ln(volume) - ln(lag(volume) {W}) AS x, lead(close, 7) {W} / close - 1 AS y FROM bars),
s AS (SELECT asset, d, row_number() {W} - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM l WHERE x IS NOT NULL AND y IS NOT NULL), f AS (SELECT *, CAST(floor(fold * n / 5) AS BIGINT) AS lo, CAST(floor((fold + 1) * n / 5) AS BIGINT) AS hi FROM s, (SELECT unnest(range(0, 5)) AS fold)),
r AS (SELECT asset, fold, CASE WHEN i >= lo AND i < hi THEN 'test' WHEN i < lo - 7 OR i >= hi + 7 THEN 'train' END AS role FROM f) SELECT asset, fold, role, count(*) AS n FROM r WHERE role IS NOT NULL GROUP BY 1, 2, 3""")
def purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of five folds after purging a week around each test block."""
    return ST.purged_folds(_labelled(spark, sf_dir), "asset", "d", 5, 7).groupBy("asset", "fold", "role").agg(F.count("*").alias("n"))


@query()
def purged_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled out-of-fold AUC of each series by its own logistic regression, standardised on the training rows of each fold."""
    rows = ST.purged_folds(_labelled(spark, sf_dir), "asset", "d", 3, 7).persist()
    assets = sorted(r["asset"] for r in rows.select("asset").distinct().collect())  # a handful of series
    m = VectorAssembler(inputCols=["x1", "x2"], outputCol="features")
    parts = rows.where("false").select("asset", "label", F.lit(0.0).alias("p"))
    for asset in assets:
        for fold in range(3):  # a fixed number of fits
            own = rows.where((F.col("asset") == asset) & (F.col("fold") == fold))
            train, test = own.where(F.col("role") == "train"), own.where(F.col("role") == "test")
            model = LogisticRegression(maxIter=20, regParam=0.01).fit(m.transform(train))
            p = model.transform(m.transform(test)).select("asset", "label", vector_to_array("probability")[1].alias("p"))
            parts = parts.unionByName(p)
    out = ST.auc(parts.withColumn("p", F.round("p", 9)), "asset", "label", "p")
    return out


@query(f"""WITH {BARS_SQL}, l AS (SELECT asset, d, round(ln(volume) - ln(lag(volume) {W}), 10) AS x, lead(close, 7) {W} / close - 1 AS y FROM bars), s AS (SELECT * FROM l WHERE x IS NOT NULL AND y IS NOT NULL),
a AS (SELECT asset, d, x, y, count(*) OVER p AS n, sum(x) OVER p AS sx, sum(y) OVER p AS sy, sum(x * y) OVER p AS sxy, sum(x * x) OVER p AS sxx FROM s WINDOW p AS (PARTITION BY asset ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 7 PRECEDING)),
b AS (SELECT *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS slope FROM a WHERE n >= 100) SELECT asset, d, round((sy - slope * sx) / n + slope * x, 5) AS pred FROM b""", text=D)
def walk_forward_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-sample predictions: each row from sums over rows whose labels are known by then."""
    p = S.over("asset", "d").rowsBetween(Window.unboundedPreceding, -7)
    s = _labelled(spark, sf_dir).withColumn("x", F.col("x1"))
    a = s.select("asset", "d", "x", F.count("*").over(p).alias("n"), F.sum("x").over(p).alias("sx"), F.sum("y").over(p).alias("sy"), F.sum(F.col("x") * F.col("y")).over(p).alias("sxy"), F.sum(F.col("x") * F.col("x")).over(p).alias("sxx")).where("n >= 100")
    slope = ratio(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    a = a.withColumn("slope", slope)
    return a.select("asset", "d", F.round((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n") + F.col("slope") * F.col("x"), 5).alias("pred"))


@query(f"""WITH {BARS_SQL}, l AS (SELECT asset, d, round(ln(volume) - ln(lag(volume) {W}), 10) AS x, lead(close, 7) {W} / close - 1 AS y FROM bars), s AS (SELECT *, CASE WHEN d < DATE '1998-01-01' THEN 'early' ELSE 'late' END AS era FROM l WHERE x IS NOT NULL AND y IS NOT NULL),
k AS (SELECT *, ntile(5) OVER (PARTITION BY asset, era ORDER BY x, d) AS q FROM s)
SELECT asset, era, count(*) AS n, round(avg(y) FILTER (q = 5) - avg(y) FILTER (q = 1), 5) AS gap, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) FILTER (q = 5), 6) AS p_up_top, round(corr(x, y), 6) AS ic FROM k GROUP BY 1, 2""")
def validate_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a signal is worth in each era: gap between outer fifths, chance of a rise, correlation."""
    s = _labelled(spark, sf_dir).withColumn("era", F.when(F.col("d") < F.lit("1998-01-01").cast("date"), "early").otherwise("late"))
    k = s.withColumn("q", F.ntile(5).over(Window.partitionBy("asset", "era").orderBy("x1", "d")))
    on = lambda q, c: F.avg(F.when(F.col("q") == q, c))
    up = (F.col("y") > 0).cast("double")
    return k.groupBy("asset", "era").agg(F.count("*").alias("n"), F.round(on(5, F.col("y")) - on(1, F.col("y")), 5).alias("gap"), F.round(on(5, up), 6).alias("p_up_top"), F.round(corr("x1", "y"), 6).alias("ic"))


@query()
def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rising map from a score to a probability."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("features"))
    s = d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    model = IsotonicRegression().fit(s)
    return model.transform(s).select("doc_id", F.round("prediction", 6).alias("calibrated"))


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query()
def kmeans_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four clusters of feature vectors, numbered by falling size."""
    v = _vectors(spark, sf_dir)
    c = KMeans(k=4, seed=42).fit(v).transform(v).groupBy("prediction").agg(F.count("*").alias("n"))
    return c.select(F.row_number().over(Window.orderBy(F.desc("n"), "prediction")).alias("cluster"), "n")


@query()
def mixture_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gaussian mixture of two features: regimes without transitions."""
    s = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(_labelled(spark, sf_dir))
    out = GaussianMixture(k=3, seed=42, maxIter=20).fit(s).transform(s)
    return out.groupBy("prediction").agg(F.count("*").alias("n"), F.round(F.avg("x2"), 4).alias("mean_drawdown"))


@query()
def forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of each feature in a random forest."""
    s = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(_labelled(spark, sf_dir))
    model = RandomForestClassifier(numTrees=20, maxDepth=4, seed=42).fit(s)
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in zip(["x1", "x2"], model.featureImportances.toArray(), strict=True)], "feature string, importance double")


@query("""WITH x AS (SELECT label, unnest(embedding) AS v, unnest(range(0, 64)) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1),
p AS (SELECT a.label AS a, b.label AS b, sum(a.m * b.m) AS dot FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2)
SELECT a, b, round(dot / (na.n * nb.n), 6) AS cosine FROM p JOIN n na ON na.label = a JOIN n nb ON nb.label = b""")
def cross_asset_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every pair of group means: few groups, joined on the dimension."""
    c = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    n = c.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    a, b = c.select(F.col("label").alias("a"), "i", F.col("m").alias("ma")), c.select(F.col("label").alias("b"), "i", F.col("m").alias("mb"))
    p = a.join(b, "i").where("a < b").groupBy("a", "b").agg(F.sum(F.col("ma") * F.col("mb")).alias("dot"))
    p = p.join(n.select(F.col("label").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("label").alias("b"), F.col("n").alias("nb")), "b")
    return p.select("a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("cosine"))


@query()
def platt_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score to a probability through a logistic curve with two parameters."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("score"))
    s = d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    x = VectorAssembler(inputCols=["score"], outputCol="features").transform(s)
    p = LogisticRegression(maxIter=50).fit(x).transform(x)
    return p.select("doc_id", F.round(vector_to_array("probability")[1], 6).alias("calibrated"))


@query()
def boosted_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees learned on each series' first seven tenths, written and read back as a model, and scored on the rest."""
    w = Window.partitionBy("asset").orderBy("d")
    s = _labelled(spark, sf_dir).withColumn("early", F.percent_rank().over(w) < 0.7)
    x = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(s)
    path = shared_folder(spark, "boosted")
    GBTClassifier(maxIter=10, maxDepth=3, seed=42).fit(x.where("early")).save(path)
    p = GBTClassificationModel.load(path).transform(x.where("NOT early"))
    return ST.auc(p.select("asset", "label", F.round(vector_to_array("probability")[1], 9).alias("p")), "asset", "label", "p")


@query()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much AUC a model loses on rows it has not seen when one feature is dealt out anew (by a hash order) among them.

    It learns from the first seven tenths of each series, less the last week of these, whose labels look into the rest.
    """
    w = S.over("asset", "d")
    at = (F.row_number().over(w) - 1) / F.count("*").over(Window.partitionBy("asset"))
    whole = _labelled(spark, sf_dir).select("asset", "d", "x1", "x2", "label", at.alias("at"))
    whole = whole.withColumn("gap", F.lead("at", 7, 1.0).over(w))
    s = whole.where("at >= 0.7").drop("at", "gap")
    m = VectorAssembler(inputCols=["x1", "x2"], outputCol="features")
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(m.transform(whole.where("gap < 0.7")))

    def area(rows: DataFrame, name: str) -> DataFrame:
        p = model.transform(m.transform(rows)).select("asset", "label", F.round(vector_to_array("probability")[1], 9).alias("p"))
        return ST.auc(p, "asset", "label", "p").select("asset", F.col("auc").alias(name))

    at = lambda order: F.row_number().over(Window.partitionBy("asset").orderBy(*order))
    placed = s.withColumn("i", at(["d"]))
    out = area(s, "whole")
    for c in ("x1", "x2"):
        dealt = s.select("asset", F.col(c).alias("_new"), at([F.xxhash64(F.lit(11), "d"), "d"]).alias("i"))
        out = out.join(area(placed.join(dealt, ["asset", "i"]).withColumn(c, F.col("_new")), f"without_{c}"), "asset")
    return out.select("asset", "whole", *[F.round(F.col("whole") - F.col(f"without_{c}"), 9).alias(f"loss_{c}") for c in ("x1", "x2")])


@query()
def volatility_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four clusters of mean return and volatility over twenty rows, numbered by rising volatility."""
    w = S.over("asset", "d")
    r = bars(spark, sf_dir).select("asset", "d", S.log_return("close", w).alias("r"))
    x = r.select("asset", "d", S.rolling(F.avg, "r", w, 20).alias("mean"), S.rolling(F.stddev_samp, "r", w, 20).alias("vol")).dropna()
    v = VectorAssembler(inputCols=["mean", "vol"], outputCol="features").transform(x)
    c = KMeans(k=4, seed=42).fit(v).transform(v).groupBy("prediction").agg(F.count("*").alias("n"), F.avg("vol").alias("vol"), F.avg("mean").alias("mean"))
    return rounded(c.select(F.row_number().over(Window.orderBy("vol")).alias("regime"), "n", "vol", "mean"), 4)
