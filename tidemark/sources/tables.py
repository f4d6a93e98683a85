"""Loaders: the provided tables, and the market data model on top of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The order of trades within a day, which decides first and last ones.
TRADE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade tape: asset, d, price, qty, notional, buy (taker bought), k (order of trades)."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_returnflag").alias("asset"),
        F.to_date("l_shipdate").alias("d"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("notional"),
        (F.col("l_linestatus") == "O").alias("buy"),
        F.struct(*TRADE_ORDER).alias("k"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each asset: open, high, low, close, volume, quote, n. One aggregation with map-side partials."""
    return (
        trades(spark, sf_dir)
        .groupBy("asset", "d")
        .agg(
            F.min_by("price", "k").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "k").alias("close"),
            F.sum("qty").alias("volume"),
            F.sum("notional").alias("quote"),
            F.count("*").alias("n"),
        )
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# The same frames as SQL, for the twins.
TRADES_SQL = """trades AS (SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS d, l_extendedprice / l_quantity AS price, l_quantity AS qty,
  l_extendedprice AS notional, l_linestatus = 'O' AS buy, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)"""
BARS_SQL = TRADES_SQL + """, bars AS (SELECT asset, d, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close,
  sum(qty) AS volume, sum(notional) AS quote, count(*) AS n FROM trades GROUP BY asset, d)"""
