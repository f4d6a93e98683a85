"""Tables inside pages as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.html_tables import number, table_cells, table_rows
from ..sources.tables import table
from .registry import query

BLOCK = 100  # customers of a page
_TWIN = "SELECT c_nationkey::BIGINT AS nation, c_custkey::BIGINT AS customer, c_mktsegment AS segment, round(c_acctbal, 2) AS balance FROM customer"


def _money(c) -> F.Column:
    """A figure as such pages write it: thousands by commas, negative ones in brackets."""
    shown = F.format_number(F.abs(c), 2)
    return F.when(c < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)


def _blocks(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").alias("nation"), F.floor(F.col("c_custkey") / BLOCK).alias("block"), "c_custkey", "c_mktsegment", _money(F.col("c_acctbal")).alias("money"))


def _read(pages: DataFrame, wanted: list[str]) -> DataFrame:
    """nation, customer, segment and balance of the wanted columns (segment, key, balance)."""
    rows = table_rows(table_cells(pages, "page", "html"), "page", wanted)
    nation = F.split_part("page", F.lit("/"), F.lit(1)).cast("long")
    return rows.select(nation.alias("nation"), F.col(wanted[1]).cast("long").alias("customer"), F.col(wanted[0]).alias("segment"), F.round(number(F.col(wanted[2])), 2).alias("balance"))


@query(_TWIN)
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers out of pages that show them in a table: two header lines, a segment that spans its rows, a note that is a table
    of its own inside a cell. The pages are made from the customers, a page for each nation and hundred keys."""
    cell = lambda x, i, n: F.concat(
        F.lit("<tr>"),
        F.when(i == 0, F.concat(F.lit('<td rowspan="'), n.cast("string"), F.lit('">'), F.col("c_mktsegment"), F.lit("</td>"))).otherwise(F.lit("")),
        F.lit("<td>"), x["c_custkey"].cast("string"), F.lit("<td>"), x["money"], F.lit("<table><tr><td>note</table></tr>"),
    )
    some = _blocks(spark, sf_dir).groupBy("nation", "block", "c_mktsegment").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "money"))).alias("r"))
    some = some.withColumn("n", F.size("r")).withColumn("rows", F.array_join(F.transform("r", lambda x, i: cell(x, i, F.col("n"))), ""))
    body = F.array_join(F.sort_array(F.collect_list("rows")), "")
    head = '<table><thead><tr><th rowspan="2">Segment<th colspan="2">Customer</tr><tr><th>key</th><th>balance</th></tr></thead><tbody>'
    html = F.concat(F.lit(f"<html><body>{head}"), body, F.lit("</tbody></table></body></html>"))
    pages = some.groupBy("nation", "block").agg(html.alias("html")).select(F.concat_ws("/", "nation", "block").alias("page"), "html")
    return _read(pages, ["Segment", "Customer key", "Customer balance"])


@query(_TWIN)
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same customers out of pages that hold markdown, the form such pages take when their markup is not to be had."""
    line = F.concat(F.lit("| "), F.col("c_mktsegment"), F.lit(" | "), F.col("c_custkey").cast("string"), F.lit(" | "), F.col("money"), F.lit(" |"))
    some = _blocks(spark, sf_dir).groupBy("nation", "block").agg(F.array_join(F.collect_list(line), "\n").alias("rows"))
    html = F.concat(F.lit("Customers\n\n| segment | key | balance |\n|:--|--:|--:|\n"), "rows", F.lit("\n\nend"))
    return _read(some.select(F.concat_ws("/", "nation", "block").alias("page"), html.alias("html")), ["segment", "key", "balance"])
