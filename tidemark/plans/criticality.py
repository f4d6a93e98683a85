"""Signs that a series nears a turn: entropy that flows between direction and size, drift of densities, non-linear measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import finite, rounded
from ..operators import criticality as C  # noqa: N812
from .registry import query
from .stats import RET_SQL, _returns

D = ("d",)
_N, _S = C.WINDOW, C.STRIDE
FRAMES_SQL = f"""{RET_SQL}, g AS (SELECT asset, d, r, row_number() OVER (PARTITION BY asset ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n
  FROM r WHERE r IS NOT NULL),
k AS (SELECT asset, unnest(range(0, (n - {_N}) // {_S} + 1)) AS frame FROM (SELECT DISTINCT asset, n FROM g WHERE n >= {_N})),
w AS (SELECT g.asset, frame, d, r, i - frame * {_S} AS pos FROM g JOIN k ON g.asset = k.asset AND i BETWEEN frame * {_S} AND frame * {_S} + {_N - 1})"""


def _frames(spark, sf_dir) -> DataFrame:
    r = _returns(spark, sf_dir).where("r IS NOT NULL")
    return C.frames(r, "asset", "d", ["r"])


def _flow_sql(name: str, source: str, target: str) -> str:
    """Transfer entropy of each frame by plain sums, not by grouping sets."""
    cut = lambda x: " + ".join(f"CASE WHEN quantile_cont({x}, {k / 3!r}) OVER (PARTITION BY asset, frame) <= {x} THEN 1 ELSE 0 END" for k in (1, 2))
    h = lambda cols: f"""SELECT asset, frame, -sum(c / n * log2(c / n)) AS h, count(*) AS cells, any_value(n) AS n FROM (SELECT asset, frame, {cols},
      count(*) AS c, sum(count(*)) OVER (PARTITION BY asset, frame) AS n FROM {name}_t GROUP BY asset, frame, {cols}) GROUP BY 1, 2"""  # noqa: E731
    return f"""{name}_s AS (SELECT asset, frame, pos, {cut(source)} AS x, {cut(target)} AS y FROM q),
{name}_t AS (SELECT * FROM (SELECT asset, frame, lead(y) OVER (PARTITION BY asset, frame ORDER BY pos) AS f, y, x FROM {name}_s) WHERE f IS NOT NULL),
{name} AS (SELECT a.asset, a.frame, a.h + b.h - c.h - e.h
  + ((c.cells - 1) - (a.cells - 1) - (b.cells - 1) + (e.cells - 1)) / (2 * ln(2) * a.n) AS te
  FROM ({h('f, y')}) a JOIN ({h('y, x')}) b USING (asset, frame) JOIN ({h('f, y, x')}) c USING (asset, frame) JOIN ({h('y')}) e USING (asset, frame))"""


@query(f"""WITH {FRAMES_SQL}, q AS (SELECT *, CAST(sign(r) AS DOUBLE) AS s, abs(r) AS a FROM w),
{_flow_sql('one', 's', 'a')}, {_flow_sql('two', 'a', 's')}, e AS (SELECT asset, frame, max(d) AS d FROM w GROUP BY 1, 2)
SELECT e.asset, e.d, round(one.te, 7) AS te_sign_to_size, round(two.te, 7) AS te_size_to_sign, round(one.te - two.te, 7) AS asymmetry
FROM e JOIN one USING (asset, frame) JOIN two USING (asset, frame)""", text=D)
def entropy_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfer entropy between the direction and the size of returns, both ways, in strided frames of 250 rows."""
    f = _frames(spark, sf_dir).withColumns({"s": F.signum("r"), "a": F.abs("r")})
    by = ["asset", "frame"]
    one, two = (C.transfer_entropy(f, by, "pos", *pair).select(*by, F.col("te").alias(n)) for n, pair in (("t1", ("s", "a")), ("t2", ("a", "s"))))
    e = f.groupBy(*by).agg(F.max("d").alias("d")).join(one, by).join(two, by)
    return rounded(e.select("asset", "d", F.col("t1").alias("te_sign_to_size"), F.col("t2").alias("te_size_to_sign"), (F.col("t1") - F.col("t2")).alias("asymmetry")), 7)


_STEP = (C.HIGH - C.LOW) / (C.POINTS - 1)


@query(f"""WITH {RET_SQL}, g AS (SELECT asset, r, (row_number() OVER (PARTITION BY asset ORDER BY d) - 1) // {_N} AS period FROM r WHERE r IS NOT NULL),
m AS (SELECT asset, r, period AS pair, 1 AS side FROM g UNION ALL SELECT asset, r, period + 1, 0 FROM g),
z AS (SELECT asset, pair, side, (r - avg(r) OVER b) / nullif(stddev_samp(r) OVER b, 0) AS z FROM m WINDOW b AS (PARTITION BY asset, pair)),
h AS (SELECT asset, pair, side, count(*) AS n, stddev_samp(z) AS sd, quantile_cont(z, 0.75) - quantile_cont(z, 0.25) AS iqr FROM z WHERE z IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT *, 1.06 * CASE WHEN iqr > 0 THEN least(sd, iqr / 1.349) ELSE sd END * pow(n, -0.2) AS bw FROM h WHERE n >= 20),
p AS (SELECT z.asset, z.pair, z.side, i, sum(exp(-pow(({C.LOW} + i * {_STEP!r} - z) / bw, 2) / 2)) / (any_value(n) * any_value(bw) * sqrt(2 * pi())) AS p
  FROM z JOIN b ON z.asset = b.asset AND z.pair = b.pair AND z.side = b.side, (SELECT unnest(range(0, {C.POINTS})) AS i) GROUP BY 1, 2, 3, 4),
s AS (SELECT x.asset, x.pair, sum(sqrt(x.p * y.p) * CASE WHEN x.i IN (0, {C.POINTS - 1}) THEN 0.5 ELSE 1 END) * {_STEP!r} AS bc
  FROM p x JOIN p y ON x.asset = y.asset AND x.pair = y.pair AND x.i = y.i AND x.side = 0 AND y.side = 1 GROUP BY 1, 2)
SELECT asset, pair AS period, round(acos(greatest(0, least(1, bc))), 6) AS distance FROM s""")
def density_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Fisher-Rao distance between the returns of each 250 rows and the 250 before."""
    r = _returns(spark, sf_dir).where("r IS NOT NULL")
    i = F.row_number().over(C.Window.partitionBy("asset").orderBy("d")) - 1
    return rounded(C.fisher_rao(r.select("asset", "r", F.floor(i / _N).alias("period")), "asset", "period", "r"))


@query()
def nonlinear_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fisher information over the normal law's, the delay of least information and the largest Lyapunov exponent of strided frames."""
    f = _frames(spark, sf_dir).groupBy("asset", "frame").agg(F.max("d").alias("d"), F.sort_array(F.collect_list(F.struct("pos", "r"))).alias("rows"))
    m = f.select("asset", F.col("d").cast("string").alias("d"), C.nonlinear(F.col("rows.r")).alias("m"))
    return rounded(m.select("asset", "d", finite("m.fisher_excess").alias("fisher_excess"), "m.lag", finite("m.lyapunov").alias("lyapunov")))

