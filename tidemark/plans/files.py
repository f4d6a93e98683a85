"""Sources and sinks as queries: what is written to the shared folder and read back equals what SQL makes of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage as I  # noqa: N812
from ..sources.archives import ZippedCsv, write_archives
from ..sources.tables import BARS_SQL, bars, table
from .registry import query


@query("""SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n, round(sum(l_quantity), 6) AS qty, count(*) FILTER (l_linestatus = 'O') AS n_sell FROM lineitem GROUP BY 1""", text=("d",))
def csv_trades_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headerless trade files read by a declared schema (four of eight columns), and counted by day."""
    t = table(spark, sf_dir, "lineitem")
    ms = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * 1000
    rows = t.select(F.col("l_orderkey").alias("agg_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"), F.lit(1).alias("first_id"), F.lit(2).alias("last_id"), F.when(F.col("l_linenumber") % 2 == 0, ms).otherwise(ms * 1000).alias("ts"), (F.col("l_linestatus") == "O").alias("is_buyer_maker"), F.lit(True).alias("is_best"))
    path = I.shared_folder(spark, "csv-trades")
    rows.write.csv(path)
    got = I.read_trades(spark, path)
    return got.groupBy("d").agg(F.count("*").alias("n"), F.round(F.sum("qty"), 6).alias("qty"), F.count_if("is_buyer_maker").alias("n_sell"))


@query("""SELECT CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1""", text=("date",))
def json_date_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects of date -> value, one for each year, to rows."""
    daily = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    years = daily.groupBy(F.year("d").alias("y")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("d").cast("string"), "v"))).alias("m"))
    path = I.shared_folder(spark, "date-map")
    years.select(F.to_json("m").alias("value")).write.text(path)
    return I.read_date_map(spark, path)


@query("""WITH k AS (SELECT event_type, ts, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS i FROM events) SELECT event_type, event_id, round(value, 6) AS value FROM k WHERE i <= 5""")
def series_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest values of each series (a limit that is the feature); it applies before the shuffle."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    return I.latest(e, ["event_type"], ["ts", "event_id"], 5).select("event_type", "event_id", F.round("value", 6).alias("value"))


@query(f"""WITH {BARS_SQL} SELECT asset, d, round(close * CASE WHEN d >= DATE '1998-01-01' THEN 2 ELSE 1 END, 6) AS close FROM bars""", text=("d",))
def published_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table published, then published again with its later rows replaced; readers see whole versions only."""
    b = bars(spark, sf_dir).select("asset", "d", "close")
    path = I.shared_folder(spark, "published")
    I.publish(b, path, 1)
    old = I.published(spark, path)
    I.upsert(old, old.where("d >= DATE '1998-01-01'").withColumn("close", 2 * F.col("close")), ["asset", "d"], path, 2)
    return I.published(spark, path).select("asset", "d", F.round("close", 6).alias("close"))


@query(f"""WITH {BARS_SQL} SELECT asset, count(*) AS n, round(avg(close), 6) AS mean FROM bars WHERE asset = 'R' GROUP BY asset""")
def partition_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written by asset; a read of one asset opens that folder only."""
    path = I.shared_folder(spark, "bars")
    I.write_bars(bars(spark, sf_dir).drop("k"), path)
    one = spark.read.parquet(path).where("asset = 'R'")
    return one.groupBy("asset").agg(F.count("*").alias("n"), F.round(F.avg("close"), 6).alias("mean"))


@query("""SELECT l_returnflag || '-' || strftime(l_shipdate, '%Y') AS archive, count(*) AS n, round(sum(l_quantity), 4) AS qty,
round(max(l_extendedprice), 2) AS high FROM lineitem GROUP BY 1""")
def zipped_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape as zipped CSV files with checksums, one for each series and year, read back by the data source: two of five
    columns are parsed."""
    t = table(spark, sf_dir, "lineitem")
    name = F.concat_ws("-", "l_returnflag", F.date_format("l_shipdate", "yyyy")).alias("archive")
    path = I.shared_folder(spark, "archives")
    write_archives(t.select(name, "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"), path, "archive")
    spark.dataSource.register(ZippedCsv)
    reader = spark.read.format("zipped_csv").schema("l_quantity double, l_extendedprice double, _archive string, _error string")
    got = reader.option("names", "l_orderkey,l_linenumber,l_quantity,l_extendedprice,l_discount").option("mode", "FAILFAST").load(path)
    each = got.groupBy(F.regexp_replace("_archive", r"\.zip$", "").alias("archive"))
    return each.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"), F.round(F.max("l_extendedprice"), 2).alias("high"))


@query(f"""WITH {BARS_SQL} SELECT b.asset, strftime(b.d, '%Y-%m') AS month, count(*) AS n, round(max(b.close - m.mean), 6) AS gap
FROM bars b JOIN (SELECT asset, strftime(d, '%Y-%m') AS month, avg(close) AS mean FROM bars GROUP BY 1, 2) m ON b.asset = m.asset AND strftime(b.d, '%Y-%m') = m.month
WHERE b.d >= DATE '1996-01-01' AND b.d < DATE '1997-01-01' GROUP BY 1, 2""")
def pruned_bucketed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year of two tables partitioned by year and bucketed by series: only that year's files are opened, and the join and the
    aggregation before it need no shuffle."""
    names = series_tables(spark, bars(spark, sf_dir))
    return year_join(spark, *names, 1996)


def series_tables(spark: SparkSession, b: DataFrame, buckets: int = 4) -> tuple[str, str]:
    """Closes, and their monthly means, as tables of the catalogue by year and series."""
    rows = b.select("asset", "d", "close", F.date_format("d", "yyyy-MM").alias("month"), F.year("d").alias("year"))
    means = rows.groupBy("asset", "month", "year").agg(F.avg("close").alias("mean"))
    names = tuple(f"tidemark_{kind}_{uuid.uuid4().hex[:12]}" for kind in ("closes", "means"))
    for name, df in zip(names, (rows, means), strict=True):
        I.write_bucketed(df, name, ["asset", "month"], buckets, ["year"], I.shared_folder(spark, name))
    return names


def year_join(spark: SparkSession, closes: str, means: str, year: int) -> DataFrame:
    one, two = (spark.table(n).where(F.col("year") == year).drop("year") for n in (closes, means))
    both = one.join(two.hint("merge"), ["asset", "month"])
    return both.groupBy("asset", "month").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.col("close") - F.col("mean")), 6).alias("gap"))
