"""The order-level book of a message stream, and objects out of prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..operators import book as B  # noqa: N812
from ..sources.tables import events
from .registry import query

DEPTH = 3
_MESSAGES_SQL = """m AS (SELECT user_id % 5 AS book, row_number() OVER (ORDER BY ts, event_id) AS seq, CAST(ts AS DATE) AS day, user_id AS order_id,
  CASE WHEN (user_id // 5) % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
  CASE WHEN event_type = 'purchase' THEN NULL WHEN (user_id // 5) % 2 = 0 THEN 100 - round(value, 0) / 10 ELSE 100 + round(value, 0) / 10 END AS price,
  CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 END AS volume,
  CASE WHEN event_id % 997 = 5 THEN 'F' WHEN event_type = 'click' THEN 'A' WHEN event_type = 'error' THEN 'D' WHEN event_type = 'view' THEN 'Y' ELSE 'M' END AS action
  FROM events)"""


def _messages(spark, sf_dir) -> DataFrame:
    """Events as messages: books and orders by user; purchases change the volume only, sign-ups the price only."""
    e, kind = events(spark, sf_dir), F.col("event_type")
    buys = F.floor(F.col("user_id") / 5) % 2 == 0
    tick = F.round("value", 0) / 10
    action = F.when(F.col("event_id") % 997 == 5, "F").when(kind == "click", "A").when(kind == "error", "D").when(kind == "view", "Y").otherwise("M")
    return e.select(
        (F.col("user_id") % 5).alias("book"), F.struct("ts", "event_id").alias("seq"), F.to_date("ts").alias("day"), F.col("user_id").alias("order_id"),
        F.when(buys, "buy").otherwise("sell").alias("side"), F.when(kind == "purchase", None).when(buys, 100 - tick).otherwise(100 + tick).alias("price"),
        F.when(kind == "signup", None).otherwise(F.from_json("props", "k long")["k"] + 1).alias("volume"), action.alias("action"),
    )


# The twin takes the messages up to each day's end and looks back from there: the last clearing, the last deletion, the last start.
_LEVELS_SQL = f"""{_MESSAGES_SQL}, days AS (SELECT DISTINCT day AS eod FROM m),
s AS (SELECT eod, m.* FROM days JOIN m ON m.day <= eod), f AS (SELECT eod, book, max(seq) FILTER (action = 'F') AS cleared FROM s GROUP BY 1, 2),
o AS (SELECT s.* FROM s JOIN f ON s.eod = f.eod AND s.book = f.book WHERE action <> 'F' AND (cleared IS NULL OR seq > cleared)),
g AS (SELECT eod, order_id, max(seq) FILTER (action = 'D') AS gone FROM o GROUP BY 1, 2),
p AS (SELECT o.* FROM o JOIN g ON o.eod = g.eod AND o.order_id = g.order_id WHERE gone IS NULL OR seq > gone),
q AS (SELECT eod, order_id, coalesce(max(seq) FILTER (action = 'A'), min(seq) FILTER (action = 'Y')) AS start FROM p GROUP BY 1, 2),
v AS (SELECT p.eod, p.book, p.order_id, p.side, any_value(start) AS since, arg_max(price, seq) FILTER (price IS NOT NULL) AS price,
  arg_max(volume, seq) FILTER (volume IS NOT NULL) AS volume FROM p JOIN q ON p.eod = q.eod AND p.order_id = q.order_id WHERE seq >= start GROUP BY 1, 2, 3, 4),
e AS (SELECT book, eod, side, price, sum(volume)::BIGINT AS volume, count(*) AS orders, arg_min(order_id, since) AS first_order FROM v WHERE volume > 0 GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY book, eod, side ORDER BY CASE WHEN side = 'buy' THEN -price ELSE price END) AS level FROM e),
l AS (SELECT * FROM r WHERE level <= {DEPTH})"""


def _ladder(spark, sf_dir) -> DataFrame:
    m = _messages(spark, sf_dir)
    last = m.agg(F.max("day")).first()[0]
    return B.levels(B.at_day_ends(B.versions(m), F.lit(last).cast("date")), DEPTH)


@query(f"WITH {_LEVELS_SQL} SELECT book, eod, side, level, round(price, 6) AS price, volume, orders, first_order FROM l", text=("eod",))
def order_book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best levels of each side of each book at each day's end: volume, orders, and who is first in the queue."""
    return rounded(_ladder(spark, sf_dir).withColumnRenamed("at", "eod").select("book", "eod", "side", "level", "price", "volume", "orders", "first_order"))


@query(f"""WITH {_LEVELS_SQL}, k AS (SELECT b.book, b.eod, b.level, b.price AS bp, s.price AS sp, b.volume AS bv, s.volume AS sv
  FROM l b JOIN l s ON b.book = s.book AND b.eod = s.eod AND b.level = s.level AND b.side = 'buy' AND s.side = 'sell')
SELECT book, eod, round(max(bp) FILTER (level = 1), 6) AS bid, round(max(sp) FILTER (level = 1), 6) AS ask, count(*) AS levels,
  round((max(bp) FILTER (level = 1) + max(sp) FILTER (level = 1)) / 2, 6) AS mid, round(max(sp) FILTER (level = 1) - max(bp) FILTER (level = 1), 6) AS spread,
  round(max((bp * sv + sp * bv) / (bv + sv)) FILTER (level = 1), 6) AS weighted, round(sum(bp * sv + sp * bv) / sum(bv + sv), 6) AS weighted_deep
FROM k GROUP BY 1, 2""", text=("eod",))
def order_book_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid, spread and weighted prices of each book at each day's end."""
    return rounded(B.measures(_ladder(spark, sf_dir)).withColumnRenamed("at", "eod"))


def object_in(text) -> Column:
    """The JSON object of a text, which may stand alone, in a fenced block, or between its first and last brace in prose; else null.
    Of several objects the first counts. As a variant: fields are taken with try_variant_get."""
    found = [text, F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(text, r"(?s)\{.*\}", 0)]
    parsed = [F.try_parse_json(F.when(F.rlike(t, F.lit(r"(?s)^\s*\{.*\}\s*$")), t)) for t in found]
    return F.coalesce(*parsed)


@query("""SELECT event_id, CASE WHEN event_id % 5 < 4 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
CASE WHEN event_id % 5 < 4 THEN event_type END AS kind FROM events""")
def json_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of objects that stand alone, in fences, or inside prose; of broken ones, nothing. The replies are made from events."""
    body = F.to_json(F.struct(F.from_json("props", "k long")["k"].alias("k"), F.col("event_type").alias("kind"), F.struct(F.lit("x}{").alias("deep")).alias("more")))
    way = F.col("event_id") % 5
    text = (
        F.when(way == 0, body)
        .when(way == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(way == 2, F.concat(F.lit("I think "), body, F.lit(" says it.")))
        .when(way == 3, F.concat(F.lit("  \n"), body, F.lit("\n")))
        .otherwise(F.concat(F.lit("no "), F.substring(body, 1, 9)))
    )
    v = events(spark, sf_dir).select("event_id", object_in(text).alias("v"))
    return v.select("event_id", F.try_variant_get("v", "$.k", "long").alias("k"), F.try_variant_get("v", "$.kind", "string").alias("kind"))
