"""Statistics of series and forecasts: risk, information, correlation, regression, calibration, tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import corr, ratio, rounded
from ..operators import series as S
from ..operators import stats as ST
from ..sources.tables import BARS_SQL, bars, table
from .registry import query

D = ("d",)
W = "OVER (PARTITION BY asset ORDER BY d)"
RET_SQL = f"{BARS_SQL}, r AS (SELECT asset, d, close, volume, round(ln(close) - ln(lag(close) {W}), 10) AS r, round(ln(volume) - ln(lag(volume) {W}), 10) AS v FROM bars)"


def _returns(spark, sf_dir) -> DataFrame:
    w = S.over("asset", "d")
    r, v = (F.round(S.log_return(c, w), 10) for c in ("close", "volume"))  # equal changes tie exactly
    return bars(spark, sf_dir).select("asset", "d", "close", "volume", r.alias("r"), v.alias("v"))


@query(f"""WITH {RET_SQL}, q AS (SELECT asset, quantile_cont(r, 0.05) AS var FROM r GROUP BY asset)
SELECT r.asset, round(any_value(var), 9) AS var, round(avg(r) FILTER (r <= var), 9) AS es FROM r JOIN q ON r.asset = q.asset GROUP BY r.asset""")
def var_es(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empirical value at risk at 5 % (linear interpolation), and the mean of what lies at or under it."""
    r = _returns(spark, sf_dir)
    q = r.groupBy("asset").agg(F.percentile("r", F.lit(0.05)).alias("var"))
    return rounded(r.join(q, "asset").groupBy("asset").agg(F.first("var").alias("var"), F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))).alias("es")), 9)


@query(f"""WITH {RET_SQL}, l AS (SELECT asset, -r AS x FROM r WHERE r IS NOT NULL), u AS (SELECT asset, quantile_cont(x, 0.9) AS u, count(*) AS n FROM l GROUP BY asset),
e AS (SELECT l.asset, any_value(u) AS u, any_value(n) AS n, count(*) AS k, avg(x - u) AS m, var_samp(x - u) AS s2 FROM l JOIN u ON l.asset = u.asset WHERE x > u GROUP BY l.asset),
g AS (SELECT *, 0.5 * (1 - m * m / s2) AS xi, 0.5 * m * (m * m / s2 + 1) AS beta FROM e)
SELECT asset, round(u, 6) AS u, round(xi, 6) AS xi, round(beta, 6) AS beta, round(u + beta / xi * (pow(n / k * 0.01, -xi) - 1), 6) AS var99,
  round((u + beta / xi * (pow(n / k * 0.01, -xi) - 1) + beta - xi * u) / (1 - xi), 6) AS es99 FROM g""")
def evt_pot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks over the 90 % threshold of losses, generalised Pareto by moments, and the tail risk at 99 %."""
    x = _returns(spark, sf_dir).where("r IS NOT NULL").select("asset", (-F.col("r")).alias("x"))
    u = x.groupBy("asset").agg(F.percentile("x", F.lit(0.9)).alias("u"), F.count("*").alias("n"))
    e = x.join(u, "asset").where("x > u").groupBy("asset").agg(F.first("u").alias("u"), F.first("n").alias("n"), F.count("*").alias("k"), F.avg(F.col("x") - F.col("u")).alias("m"), F.var_samp(F.col("x") - F.col("u")).alias("s2"))
    sq = F.col("m") * F.col("m") / F.col("s2")
    g = e.withColumn("xi", 0.5 * (1 - sq)).withColumn("beta", 0.5 * F.col("m") * (sq + 1))
    var = F.col("u") + F.col("beta") / F.col("xi") * (F.pow(F.col("n") / F.col("k") * 0.01, -F.col("xi")) - 1)
    g = g.withColumn("var99", var)
    return rounded(g.select("asset", "u", "xi", "beta", "var99", ((F.col("var99") + F.col("beta") - F.col("xi") * F.col("u")) / (1 - F.col("xi"))).alias("es99")))


@query(f"""WITH {RET_SQL}, m AS (SELECT asset, min(r) AS lo, max(r) AS hi FROM r GROUP BY asset),
b AS (SELECT r.asset, least(CAST(floor((r - lo) / nullif(hi - lo, 0) * 10) AS INTEGER), 9) AS b, count(*) AS c FROM r JOIN m ON r.asset = m.asset WHERE r IS NOT NULL GROUP BY 1, 2),
p AS (SELECT asset, c / sum(c) OVER (PARTITION BY asset) AS p FROM b) SELECT asset, round(-sum(p * ln(p)) / ln(10), 9) AS entropy FROM p GROUP BY asset""")
def entropy_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of ten equal-width bins of returns over its maximum."""
    r = ST.equal_bins(_returns(spark, sf_dir).where("r IS NOT NULL"), "asset", "r", "b", 10)
    p = r.groupBy("asset", "b").agg(F.count("*").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("asset")))
    return p.groupBy("asset").agg(F.round(-F.sum(F.col("p") * F.ln("p")) / F.ln(F.lit(10.0)), 9).alias("entropy"))


@query(f"""WITH {RET_SQL}, t AS (SELECT asset, ntile(3) OVER (PARTITION BY asset ORDER BY r, d) AS a, ntile(3) OVER (PARTITION BY asset ORDER BY v, d) AS b FROM r WHERE r IS NOT NULL AND v IS NOT NULL),
j AS (SELECT asset, a, b, count(*) AS c FROM t GROUP BY 1, 2, 3), s AS (SELECT *, c / sum(c) OVER (PARTITION BY asset) AS p, sum(c) OVER (PARTITION BY asset, a) / sum(c) OVER (PARTITION BY asset) AS pa,
  sum(c) OVER (PARTITION BY asset, b) / sum(c) OVER (PARTITION BY asset) AS pb FROM j) SELECT asset, round(sum(p * ln(p / (pa * pb))), 9) AS mi FROM s GROUP BY asset""")
def mutual_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information of tercile bins of two returns."""
    r = _returns(spark, sf_dir).where("r IS NOT NULL AND v IS NOT NULL")
    tile = lambda x: F.ntile(3).over(Window.partitionBy("asset").orderBy(x, "d"))
    j = r.select("asset", tile("r").alias("a"), tile("v").alias("b")).groupBy("asset", "a", "b").agg(F.count("*").alias("c"))
    return ST.mutual_information(j, "asset", "a", "b", "c").select("asset", F.round("mi", 9).alias("mi"))


@query(f"""WITH {RET_SQL}, s AS (SELECT asset, d, sign(r) AS y, sign(v) AS x, lead(sign(r)) OVER (PARTITION BY asset ORDER BY d) AS f FROM r WHERE r IS NOT NULL AND v IS NOT NULL),
c AS (SELECT asset, f, y, x, grouping_id(f, y, x) AS g, count(*) AS n FROM s WHERE f IS NOT NULL GROUP BY GROUPING SETS ((asset, f, y, x), (asset, f, y), (asset, y, x), (asset, y))),
h AS (SELECT asset, g, -sum(n / t * ln(n / t)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY asset, g) AS t FROM c) GROUP BY 1, 2)
SELECT asset, round(sum(CASE g WHEN 1 THEN h WHEN 4 THEN h WHEN 5 THEN -h ELSE -h END), 9) AS te FROM h GROUP BY asset""")
def transfer_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H(y+,y) + H(y,x) - H(y) - H(y+,y,x) over signs; all four joint counts in one pass of grouping sets."""
    s = _returns(spark, sf_dir).where("r IS NOT NULL AND v IS NOT NULL").select("asset", "d", F.signum("r").alias("y"), F.signum("v").alias("x"))
    s = s.withColumn("f", F.lead("y").over(S.over("asset", "d"))).where("f IS NOT NULL")
    c = s.groupingSets([["asset", "f", "y", "x"], ["asset", "f", "y"], ["asset", "y", "x"], ["asset", "y"]], "asset", "f", "y", "x").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    t = F.sum("n").over(Window.partitionBy("asset", "g"))
    h = c.withColumn("p", F.col("n") / t).groupBy("asset", "g").agg((-F.sum(F.col("p") * F.ln("p"))).alias("h"))
    return h.groupBy("asset").agg(F.round(F.sum(F.when(F.col("g").isin(1, 4), F.col("h")).otherwise(-F.col("h"))), 9).alias("te"))


@query(f"""WITH {RET_SQL}, s AS (SELECT asset, d, CASE WHEN r > 0.5 THEN 'UP' WHEN r < -0.5 THEN 'DOWN' ELSE 'FLAT' END AS s FROM r WHERE r IS NOT NULL),
l AS (SELECT asset, s, lag(s) OVER (PARTITION BY asset ORDER BY d) AS p FROM s), c AS (SELECT asset, p, s, count(*) AS n FROM l WHERE p IS NOT NULL GROUP BY 1, 2, 3)
SELECT asset, p AS from_state, s AS to_state, n, round(n / sum(n) OVER (PARTITION BY asset, p), 9) AS prob FROM c""")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markov transitions between three states, rows normalised."""
    s = _returns(spark, sf_dir).where("r IS NOT NULL").select("asset", "d", F.when(F.col("r") > 0.5, "UP").when(F.col("r") < -0.5, "DOWN").otherwise("FLAT").alias("to_state"))
    c = s.withColumn("from_state", F.lag("to_state").over(S.over("asset", "d"))).where("from_state IS NOT NULL").groupBy("asset", "from_state", "to_state").agg(F.count("*").alias("n"))
    return c.withColumn("prob", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("asset", "from_state")), 9))


@query(f"""WITH {BARS_SQL}, l AS (UNPIVOT (SELECT asset, d, open, high, low, close, volume FROM bars) ON open, high, low, close, volume INTO NAME x VALUE v)
SELECT a.asset, a.x AS x, b.x AS y, round(corr(a.v, b.v), 6) AS c FROM l a JOIN l b ON a.asset = b.asset AND a.d = b.d AND a.x < b.x GROUP BY 1, 2, 3""")
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of every pair of columns: one pass with one aggregate for each pair, no self join."""
    names = sorted(["open", "high", "low", "close", "volume"])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    wide = bars(spark, sf_dir).groupBy("asset").agg(*[corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    each = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{a}|{b}").alias("c")) for a, b in pairs])
    return wide.select("asset", F.inline(each)).select("asset", "x", "y", F.round("c", 6).alias("c"))


@query(f"""WITH {RET_SQL}, f AS (SELECT asset, d, round(v, 10) AS x, round(ln(lead(close, 7) OVER (PARTITION BY asset ORDER BY d)) - ln(close), 10) AS y FROM r),
k AS (SELECT asset, rank() OVER (PARTITION BY asset ORDER BY x) + (count(*) OVER (PARTITION BY asset, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY asset ORDER BY y) + (count(*) OVER (PARTITION BY asset, y) - 1) / 2 AS ry FROM f WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT asset, round(corr(rx, ry), 9) AS ic FROM k GROUP BY asset""")
def rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman's correlation of a feature with the return that follows (ties averaged)."""
    f = _returns(spark, sf_dir).select("asset", "d", F.round("v", 10).alias("x"), F.round(F.ln(F.lead("close", 7).over(S.over("asset", "d"))) - F.ln("close"), 10).alias("y")).dropna()
    k = f.select("asset", ST.average_rank("x", "asset").alias("rx"), ST.average_rank("y", "asset").alias("ry"))
    return k.groupBy("asset").agg(F.round(corr("rx", "ry"), 9).alias("ic"))


@query(f"""WITH {RET_SQL}, l AS (SELECT asset, r AS y, lag(v) {W} AS x FROM r)
SELECT asset, round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 9) AS intercept, round(regr_r2(y, x), 9) AS r2, regr_count(y, x) AS n FROM l GROUP BY asset""")
def ols_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares on the regressor one row before."""
    l = _returns(spark, sf_dir).select("asset", F.col("r").alias("y"), F.lag("v").over(S.over("asset", "d")).alias("x"))  # noqa: E741
    return l.groupBy("asset").agg(F.round(F.regr_slope("y", "x"), 9).alias("slope"), F.round(F.regr_intercept("y", "x"), 9).alias("intercept"), F.round(F.regr_r2("y", "x"), 9).alias("r2"), F.regr_count("y", "x").alias("n"))


@query(f"""WITH {RET_SQL}, l AS (SELECT asset, r AS y, lag(r) {W} AS a, lag(v) {W} AS b FROM r),
c AS (SELECT asset, count(*) AS n, regr_r2(y, a) AS r0, corr(y, a) AS ya, corr(y, b) AS yb, corr(a, b) AS ab FROM l WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY asset),
f AS (SELECT *, (ya * ya + yb * yb - 2 * ya * yb * ab) / (1 - ab * ab) AS r1 FROM c)
SELECT asset, n, round((r1 - r0) / ((1 - r1) / (n - 3)), 6) AS f_stat, round(exp((n * ln(1 - r0) - n * ln(1 - r1) - ln(n)) / 2) / (1 + exp((n * ln(1 - r0) - n * ln(1 - r1) - ln(n)) / 2)), 6) AS bic_posterior FROM f""")
def granger_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a second series' past adds to a series' own past: the F statistic, and the posterior from BIC."""
    w = S.over("asset", "d")
    l = _returns(spark, sf_dir).select("asset", F.col("r").alias("y"), F.lag("r").over(w).alias("a"), F.lag("v").over(w).alias("b")).dropna()  # noqa: E741
    c = l.groupBy("asset").agg(F.count("*").alias("n"), corr("y", "a").alias("ya"), corr("y", "b").alias("yb"), corr("a", "b").alias("ab"))
    ya, yb, ab, n = (F.col(k) for k in ("ya", "yb", "ab", "n"))
    c = c.withColumn("r0", ya * ya).withColumn("r1", ratio(ya * ya + yb * yb - 2 * ya * yb * ab, 1 - ab * ab))
    gain = F.exp((n * F.ln(1 - F.col("r0")) - n * F.ln(1 - F.col("r1")) - F.ln(n)) / 2)
    return rounded(c.select("asset", "n", ratio(F.col("r1") - F.col("r0"), ratio(1 - F.col("r1"), n - 3)).alias("f_stat"), (gain / (1 + gain)).alias("bic_posterior")))


@query(f"""WITH {RET_SQL}, f AS (SELECT asset, d, v AS x, lead(close, 7) {W} / close - 1 AS y FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY x, d) AS i, count(*) OVER (PARTITION BY asset) AS n FROM f WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT asset, round(avg(y) FILTER (i > n - CAST(floor(n * 0.2) AS BIGINT)) - avg(y) FILTER (i <= CAST(floor(n * 0.2) AS BIGINT)), 6) AS gap, any_value(CAST(floor(n * 0.2) AS BIGINT)) AS k FROM k GROUP BY asset""")
def quantile_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean return after the top fifth of a feature less that after the bottom fifth."""
    w = S.over("asset", "d")
    f = _returns(spark, sf_dir).select("asset", "d", F.col("v").alias("x"), S.forward_return("close", w, 7).alias("y")).dropna()
    k = f.withColumn("i", F.row_number().over(Window.partitionBy("asset").orderBy("x", "d"))).withColumn("k", F.floor(F.count("*").over(Window.partitionBy("asset")) * 0.2)).withColumn("n", F.count("*").over(Window.partitionBy("asset")))
    top, low = F.avg(F.when(F.col("i") > F.col("n") - F.col("k"), F.col("y"))), F.avg(F.when(F.col("i") <= F.col("k"), F.col("y")))
    return k.groupBy("asset").agg(F.round(top - low, 6).alias("gap"), F.first("k").alias("k"))


@query(f"""WITH {RET_SQL}, f AS (SELECT asset, d, ntile(10) OVER (PARTITION BY asset ORDER BY v, d) AS decile, lead(r) {W} AS y FROM r WHERE v IS NOT NULL)
SELECT asset, decile, count(y) AS n, round(avg(y), 6) AS mean, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 6) AS p_up FROM f WHERE y IS NOT NULL GROUP BY 1, 2""")
def decile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What followed each decile of a feature."""
    f = _returns(spark, sf_dir).where("v IS NOT NULL").select("asset", F.ntile(10).over(Window.partitionBy("asset").orderBy("v", "d")).alias("decile"), F.lead("r").over(S.over("asset", "d")).alias("y")).where("y IS NOT NULL")
    return f.groupBy("asset", "decile").agg(F.count("y").alias("n"), F.round(F.avg("y"), 6).alias("mean"), F.round(F.avg((F.col("y") > 0).cast("double")), 6).alias("p_up"))


@query(f"""WITH {RET_SQL}, f AS (SELECT asset, CASE WHEN d < DATE '1997-01-01' THEN 'early' WHEN d < DATE '1999-01-01' THEN 'middle' ELSE 'late' END AS era,
  CASE WHEN abs(r) < 0.5 THEN 'CALM' WHEN abs(r) < 1.5 THEN 'ELEVATED' ELSE 'STRESS' END AS bucket, lead(r) {W} AS y FROM r WHERE r IS NOT NULL)
SELECT coalesce(era, 'ALL') AS era, coalesce(bucket, 'ALL') AS bucket, count(*) AS n, round(avg(y), 6) AS mean, round(avg(y) - 1.96 * stddev_samp(y) / sqrt(count(*)), 6) AS low, round(avg(y) + 1.96 * stddev_samp(y) / sqrt(count(*)), 6) AS high
FROM f WHERE y IS NOT NULL GROUP BY CUBE (era, bucket)""")
def bucket_era_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean next return and its interval by era and bucket, with all totals."""
    era = F.when(F.col("d") < F.lit("1997-01-01").cast("date"), "early").when(F.col("d") < F.lit("1999-01-01").cast("date"), "middle").otherwise("late")
    bucket = F.when(F.abs("r") < 0.5, "CALM").when(F.abs("r") < 1.5, "ELEVATED").otherwise("STRESS")
    f = _returns(spark, sf_dir).where("r IS NOT NULL").select(era.alias("era"), bucket.alias("bucket"), F.lead("r").over(S.over("asset", "d")).alias("y")).where("y IS NOT NULL")
    half = 1.96 * F.stddev_samp("y") / F.sqrt(F.count("*"))
    c = f.cube("era", "bucket").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), (F.avg("y") - half).alias("low"), (F.avg("y") + half).alias("high"))
    return rounded(c.withColumns({"era": F.coalesce("era", F.lit("ALL")), "bucket": F.coalesce("bucket", F.lit("ALL"))}))


SCORED_SQL = "s AS (SELECT d.doc_id, toxic AS y, least(0.99, greatest(0.01, n_chars / 5000.0)) AS p, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _scored(spark, sf_dir) -> DataFrame:
    """A label and a made-up probability for each labelled document."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), table(spark, sf_dir, "labels")  # noqa: E741
    return d.join(l, "doc_id").select("doc_id", F.col("toxic").alias("y"), F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("n_chars") / 5000.0)).alias("p"), "lang")


@query(f"""WITH {SCORED_SQL}, r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2 AS r FROM s)
SELECT lang, count(*) AS n, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 9) AS auc FROM r GROUP BY lang""")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC from average ranks. Counts by score come first, so a tie or a hot score is one row."""
    return ST.auc(_scored(spark, sf_dir), "lang", "y", "p")


@query(f"""WITH {SCORED_SQL}, b AS (SELECT least(CAST(floor(p * 10) AS INTEGER), 9) AS b, count(*) AS n, avg(p) AS p, avg(y) AS y FROM s GROUP BY 1),
t AS (SELECT count(*) AS n, avg(y) AS y, avg((p - y) * (p - y)) AS brier FROM s)
SELECT round(any_value(t.brier), 9) AS brier, round(sum(b.n * abs(b.p - b.y)) / any_value(t.n), 9) AS ece, round(sum(b.n * (b.p - b.y) * (b.p - b.y)) / any_value(t.n), 9) AS reliability,
  round(sum(b.n * (b.y - t.y) * (b.y - t.y)) / any_value(t.n), 9) AS resolution, round(any_value(t.y * (1 - t.y)), 9) AS uncertainty FROM b, t""")
def brier_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score, calibration error over ten bins, and the score's three parts, from ten partial sums."""
    s = _scored(spark, sf_dir)
    b = s.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("b")).agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sq"))
    all_ = Window.partitionBy()
    b = b.withColumns({"t": F.sum("n").over(all_), "ty": F.sum("sy").over(all_) / F.sum("n").over(all_), "p": F.col("sp") / F.col("n"), "y": F.col("sy") / F.col("n")})
    part = lambda e: F.sum(F.col("n") * e) / F.first("t")
    gap, lift = F.col("p") - F.col("y"), F.col("y") - F.col("ty")
    return rounded(b.agg((F.sum("sq") / F.first("t")).alias("brier"), part(F.abs(gap)).alias("ece"), part(gap * gap).alias("reliability"), part(lift * lift).alias("resolution"), (F.first("ty") * (1 - F.first("ty"))).alias("uncertainty")), 9)


@query(f"""WITH {RET_SQL}, g AS (SELECT asset, strftime(d, '%Y-%m') AS month, avg(r) / nullif(stddev_samp(r) / sqrt(count(r)), 0) AS t FROM r WHERE r IS NOT NULL GROUP BY 1, 2),
p AS (SELECT asset, month, exp(-t * t / 2) AS p FROM g WHERE t IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY p, month) AS i, count(*) OVER (PARTITION BY asset) AS n FROM p)
SELECT asset, month, round(p, 9) AS p, round(least(1, min(p * n / i) OVER (PARTITION BY asset ORDER BY i DESC)), 9) AS q FROM k""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benjamini-Hochberg: p * n / rank, then the running minimum from the largest rank down."""
    r = _returns(spark, sf_dir).where("r IS NOT NULL").groupBy("asset", F.date_format("d", "yyyy-MM").alias("month"))
    g = r.agg(ratio(F.avg("r"), F.stddev_samp("r") / F.sqrt(F.count("r"))).alias("t")).where("t IS NOT NULL")
    p = g.select("asset", "month", F.exp(-F.col("t") * F.col("t") / 2).alias("p"))
    return ST.benjamini_hochberg(p, "asset", "p", "month").select("asset", "month", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@query(f"""WITH {RET_SQL}, x AS (SELECT asset, d, r, quantile_cont(r, 0.05) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING) AS var, count(r) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING) AS n FROM r WHERE r IS NOT NULL),
h AS (SELECT asset, d, CAST(r < var AS INTEGER) AS hit, lag(CAST(r < var AS INTEGER)) OVER (PARTITION BY asset ORDER BY d) AS was FROM x WHERE n >= 250),
c AS (SELECT asset, count(*) AS n, sum(hit) AS k, count(*) FILTER (was = 0 AND hit = 0) AS n00, count(*) FILTER (was = 0 AND hit = 1) AS n01, count(*) FILTER (was = 1 AND hit = 0) AS n10, count(*) FILTER (was = 1 AND hit = 1) AS n11 FROM h GROUP BY asset)
SELECT asset, n, k, n00, n01, n10, n11, round(-2 * ((n - k) * ln(0.95) + k * ln(0.05) - (n - k) * ln(1 - k / n) - k * ln(k / n)), 6) AS lr_pof FROM c""")
def kupiec_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backtest of a trailing value at risk: hits, their transitions, and the proportion-of-failures statistic."""
    w = S.over("asset", "d")
    f = w.rowsBetween(-250, -1)
    x = _returns(spark, sf_dir).where("r IS NOT NULL").withColumn("var", F.percentile("r", F.lit(0.05)).over(f)).withColumn("c", F.count("r").over(f)).where("c >= 250")
    h = x.select("asset", "d", (F.col("r") < F.col("var")).cast("int").alias("hit")).withColumn("was", F.lag("hit").over(w))
    on = lambda a, b: F.count_if((F.col("was") == a) & (F.col("hit") == b))
    c = h.groupBy("asset").agg(F.count("*").alias("n"), F.sum("hit").alias("k"), on(0, 0).alias("n00"), on(0, 1).alias("n01"), on(1, 0).alias("n10"), on(1, 1).alias("n11"))
    n, k = F.col("n"), F.col("k")
    lr = -2 * ((n - k) * F.ln(F.lit(0.95)) + k * F.ln(F.lit(0.05)) - (n - k) * F.ln(1 - k / n) - k * F.ln(k / n))
    return c.withColumn("lr_pof", F.round(lr, 6))


@query(f"""WITH {RET_SQL}, e AS (SELECT asset, abs(r) - abs(v) AS dif FROM r WHERE r IS NOT NULL AND v IS NOT NULL)
SELECT asset, round(avg(dif) / (stddev_samp(dif) / sqrt(count(*))), 6) AS dm, round(avg(dif) / stddev_samp(dif), 6) AS cohen_d FROM e GROUP BY asset""")
def diebold_mariano(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two forecasts' losses differ, and the size of the effect."""
    e = _returns(spark, sf_dir).where("r IS NOT NULL AND v IS NOT NULL").select("asset", (F.abs("r") - F.abs("v")).alias("dif"))
    return rounded(e.groupBy("asset").agg(ratio(F.avg("dif"), F.stddev_samp("dif") / F.sqrt(F.count("*"))).alias("dm"), ratio(F.avg("dif"), F.stddev_samp("dif")).alias("cohen_d")))


@query(f"""WITH {RET_SQL}, m AS (SELECT asset, d, r, avg(r) OVER (PARTITION BY asset) AS mu FROM r WHERE r IS NOT NULL),
l AS (SELECT asset, d, r - mu AS x, k, lag(r - mu, k) OVER (PARTITION BY asset, k ORDER BY d) AS y FROM m, (SELECT unnest(range(1, 6)) AS k))
SELECT asset, k, round(sum(x * y) / sum(x * x), 9) AS acf FROM l GROUP BY 1, 2""")
def acf_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelation at five lags: one ordering, one aggregation."""
    w = S.over("asset", "d")
    m = _returns(spark, sf_dir).where("r IS NOT NULL").withColumn("x", F.col("r") - F.avg("r").over(Window.partitionBy("asset")))
    m = m.withColumns({f"y{k}": F.lag("x", k).over(w) for k in range(1, 6)})
    a = m.groupBy("asset").agg(*[ratio(F.sum(F.col("x") * F.col(f"y{k}")), F.sum(F.col("x") * F.col("x"))).alias(f"a{k}") for k in range(1, 6)])
    return a.select("asset", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.round(f"a{k}", 9).alias("acf")) for k in range(1, 6)])))


@query(f"""WITH {RET_SQL}, m AS (SELECT asset, strftime(d, '%Y-%m') AS month, sum(r * r) AS rv, skewness(r) AS skew, count(*) FILTER (abs(r) > 1) AS jumps FROM r WHERE r IS NOT NULL GROUP BY 1, 2) SELECT asset, month, round(rv, 6) AS rv, jumps FROM m""")
def realised_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed squared returns of each month, and large moves."""
    r = _returns(spark, sf_dir).where("r IS NOT NULL")
    return r.groupBy("asset", F.date_format("d", "yyyy-MM").alias("month")).agg(F.round(F.sum(F.col("r") * F.col("r")), 6).alias("rv"), F.count_if(F.abs("r") > 1).alias("jumps"))


@query(f"""WITH {RET_SQL}, s AS (SELECT asset, d, r, CASE WHEN lag(v) {W} > 0 THEN 1 ELSE 0 END AS pos FROM r), p AS (SELECT asset, d, r * pos * 0.01 AS pr, pos FROM s WHERE r IS NOT NULL),
e AS (SELECT *, exp(sum(pr) OVER (PARTITION BY asset ORDER BY d)) AS eq FROM p), dd AS (SELECT *, eq / max(eq) OVER (PARTITION BY asset ORDER BY d) - 1 AS dd FROM e)
SELECT asset, round(avg(pr) / nullif(stddev_samp(pr), 0) * sqrt(252), 6) AS sharpe, round(min(dd), 6) AS max_dd, round(avg(CASE WHEN pr > 0 THEN 1.0 ELSE 0.0 END) FILTER (pos = 1), 6) AS win_rate, round(avg(pos), 6) AS exposure FROM dd GROUP BY asset""")
def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio, drawdown, win rate and exposure of a rule."""
    w = S.over("asset", "d")
    p = _returns(spark, sf_dir).withColumn("pos", F.coalesce((F.lag("v").over(w) > 0).cast("int"), F.lit(0))).where("r IS NOT NULL").withColumn("pr", F.col("r") * F.col("pos") * 0.01)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = p.withColumn("eq", F.exp(F.sum("pr").over(run))).withColumn("dd", F.col("eq") / F.max("eq").over(run) - 1)
    win = F.avg(F.when(F.col("pos") == 1, (F.col("pr") > 0).cast("double")))
    return rounded(d.groupBy("asset").agg((ratio(F.avg("pr"), F.stddev_samp("pr")) * 252**0.5).alias("sharpe"), F.min("dd").alias("max_dd"), win.alias("win_rate"), F.avg("pos").alias("exposure")))


@query(f"""WITH {SCORED_SQL}, c AS (SELECT lang, count(*) AS n, sum(y) AS k FROM s GROUP BY lang)
SELECT lang, n, k, round((k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n), 9) AS low, round((k / n + 1.9208 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n), 9) AS high FROM c""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _scored(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    p, n = F.col("k") / F.col("n"), F.col("n")
    half = 1.96 * F.sqrt(p * (1 - p) / n + 0.9604 / n / n)
    return c.select("lang", "n", "k", F.round((p + 1.9208 / n - half) / (1 + 3.8416 / n), 9).alias("low"), F.round((p + 1.9208 / n + half) / (1 + 3.8416 / n), 9).alias("high"))


@query(f"""WITH {BARS_SQL}, s AS (SELECT asset, CASE WHEN d < DATE '1998-01-01' THEN 'ref' ELSE 'new' END AS era, volume FROM bars), q AS (SELECT asset, quantile_cont(volume, [0.2, 0.4, 0.6, 0.8]) AS e FROM s WHERE era = 'ref' GROUP BY asset),
b AS (SELECT s.asset, era, len(list_filter(e, lambda v: v < volume)) AS b, count(*) AS n FROM s JOIN q ON s.asset = q.asset GROUP BY 1, 2, 3),
p AS (SELECT asset, b, greatest(coalesce(sum(n) FILTER (era = 'ref'), 0), 0.5) AS r, greatest(coalesce(sum(n) FILTER (era = 'new'), 0), 0.5) AS w FROM b GROUP BY 1, 2), t AS (SELECT *, r / sum(r) OVER (PARTITION BY asset) AS pr, w / sum(w) OVER (PARTITION BY asset) AS pw FROM p)
SELECT asset, round(sum((pw - pr) * ln(pw / pr)), 9) AS psi FROM t GROUP BY asset""")
def psi_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population stability between two eras over quintiles of the first."""
    s = bars(spark, sf_dir).select("asset", (F.col("d") < F.lit("1998-01-01").cast("date")).alias("ref"), "volume")
    q = s.where("ref").groupBy("asset").agg(F.percentile("volume", F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).alias("e"))
    b = s.join(q, "asset").groupBy("asset", F.size(F.filter("e", lambda v: v < F.col("volume"))).alias("b")).agg(F.greatest(F.count_if("ref"), F.lit(0.5)).alias("r"), F.greatest(F.count_if(~F.col("ref")), F.lit(0.5)).alias("w"))
    all_ = Window.partitionBy("asset")
    t = b.withColumn("pr", F.col("r") / F.sum("r").over(all_)).withColumn("pw", F.col("w") / F.sum("w").over(all_))
    return t.groupBy("asset").agg(F.round(F.sum((F.col("pw") - F.col("pr")) * F.ln(F.col("pw") / F.col("pr"))), 9).alias("psi"))


@query(f"""WITH {BARS_SQL}, l AS (UNPIVOT (SELECT d, asset, open, close, volume FROM bars) ON open, close, volume INTO NAME field VALUE v)
SELECT field, count(v) AS n, round(count(v) / count(*), 9) AS share, CAST(max(d) AS VARCHAR) AS last_day, count(DISTINCT v) > 1 AS varies FROM l GROUP BY field""")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each column is there, since when nothing came, and whether it varies."""
    l = bars(spark, sf_dir).unpivot(["d", "asset"], ["open", "close", "volume"], "field", "v")  # noqa: E741
    last = F.max(F.when(F.col("v").isNotNull(), F.col("d"))).cast("string")
    return l.groupBy("field").agg(F.count("v").alias("n"), F.round(F.count("v") / F.count("*"), 9).alias("share"), last.alias("last_day"), (F.min("v") != F.max("v")).alias("varies"))


_FEATURES = {"v": "v", "rng": "rng", "mom": "mom"}


@query(f"""WITH {RET_SQL}, f AS (SELECT b.asset, b.d, r.v, (high - low) / b.close AS rng, b.close / lag(b.close, 7) OVER (PARTITION BY b.asset ORDER BY b.d) - 1 AS mom, CAST(lead(r.r) OVER (PARTITION BY b.asset ORDER BY b.d) > 0 AS INTEGER) AS y FROM bars b JOIN r ON b.asset = r.asset AND b.d = r.d),
g AS (SELECT * FROM f WHERE v IS NOT NULL AND mom IS NOT NULL AND y IS NOT NULL), u AS (SELECT asset, y, unnest(['mom', 'rng', 'v']) AS name, unnest([ntile(5) OVER (PARTITION BY asset ORDER BY mom, d), ntile(5) OVER (PARTITION BY asset ORDER BY rng, d), ntile(5) OVER (PARTITION BY asset ORDER BY v, d)]) AS b FROM g),
j AS (SELECT asset, name, b, y, count(*) AS c FROM u GROUP BY 1, 2, 3, 4), s AS (SELECT *, c / sum(c) OVER (PARTITION BY asset, name) AS p, sum(c) OVER (PARTITION BY asset, name, b) / sum(c) OVER (PARTITION BY asset, name) AS pa, sum(c) OVER (PARTITION BY asset, name, y) / sum(c) OVER (PARTITION BY asset, name) AS pb FROM j),
m AS (SELECT asset, name, round(sum(p * ln(p / (pa * pb))), 9) AS mi FROM s GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY mi DESC, name) AS place FROM m) SELECT asset, name, mi, place FROM k WHERE place <= 2""")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two features of each series that tell most about the sign of the next return (a top-k report)."""
    w = S.over("asset", "d")
    r = _returns(spark, sf_dir).select("asset", "d", "r", "v")
    b = bars(spark, sf_dir).select("asset", "d", "high", "low", "close").join(r, ["asset", "d"])
    g = b.select("asset", "d", "v", ((F.col("high") - F.col("low")) / F.col("close")).alias("rng"), (F.col("close") / F.lag("close", 7).over(w) - 1).alias("mom"), (F.lead("r").over(w) > 0).cast("int").alias("y")).dropna()
    tiled = g.select("asset", "y", *[F.ntile(5).over(Window.partitionBy("asset").orderBy(c, "d")).alias(c) for c in _FEATURES])
    u = tiled.select(F.struct("asset", F.lit(0)).alias("_"), "asset", "y", F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("b")) for c in sorted(_FEATURES)])))
    j = u.groupBy(F.struct("asset", "name").alias("key"), "b", "y").agg(F.count("*").alias("c"))
    m = ST.mutual_information(j, "key", "b", "y", "c").select("key.asset", "key.name", F.round("mi", 9).alias("mi"))
    best = Window.partitionBy("asset").orderBy(F.desc("mi"), "name")
    return m.withColumn("place", F.row_number().over(best)).where("place <= 2")


@query(f"""WITH {RET_SQL}, f AS (SELECT asset, d, r, lag(r) {W} AS a, avg(r) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, volume > 30 AS busy FROM r), g AS (SELECT *, r - b AS e FROM f WHERE r IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL), h AS (SELECT *, lag(e) {W} AS e1, lag(busy) {W} AS was FROM g)
SELECT asset, busy, count(*) AS n, round(avg(CAST(sign(b) = sign(r) AS INTEGER)), 6) AS accuracy, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias, round(corr(e, e1), 6) AS autocorr, round(avg(CAST(sign(a) <> sign(b) AS INTEGER)), 6) AS disagree, count(*) FILTER (was <> busy) AS turns FROM h GROUP BY 1, 2""")
def forecast_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast by regime: accuracy of sign, size and bias of errors, whether errors follow each other, how often two forecasts
    disagree, and how often the regime turns."""
    w = S.over("asset", "d")
    f = _returns(spark, sf_dir).select("asset", "d", "r", F.lag("r").over(w).alias("a"), F.avg("r").over(w.rowsBetween(-5, -1)).alias("b"), (F.col("volume") > 30).alias("busy")).dropna()
    h = f.withColumn("e", F.col("r") - F.col("b")).withColumns({"e1": F.lag("e").over(w), "was": F.lag("busy").over(w)})
    share = lambda hit: F.avg(hit.cast("int"))
    out = h.groupBy("asset", "busy").agg(
        F.count("*").alias("n"), share(F.signum("b") == F.signum("r")).alias("accuracy"), F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"), F.avg("e").alias("bias"),
        corr("e", "e1").alias("autocorr"), share(F.signum("a") != F.signum("b")).alias("disagree"), F.count_if(F.col("was") != F.col("busy")).alias("turns"),
    )
    return rounded(out)
