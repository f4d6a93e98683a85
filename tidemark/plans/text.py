"""News-like text scoring over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..sources.tables import table
from .registry import query

# Lexicons are parameters: these words occur in the provided texts.
TOPICS = [("policy", ("that", "with")), ("flows", ("from", "für", "pour")), ("other", ("the",))]
BULL, BEAR = ["with", "from", "und", "les"], ["that", "this", "nicht", "que"]

_words = "list_filter(regexp_split_to_array(lower(text), '[^\\w\\x{80}-\\x{10FFFF}]+'), lambda w: w <> '')"


def _lower_words(c: str = "text"):
    return F.filter(F.split(F.lower(c), r"[^\w\x{80}-\x{10FFFF}]+"), lambda w: w != "")


def _first_words(c):
    """The first four words of a text in lower case, without reading on."""
    word, gap = r"[\w\x{80}-\x{10FFFF}]+", r"[^\w\x{80}-\x{10FFFF}]+"
    start = F.regexp_extract(c, f"^(?:{gap})?((?:{word}{gap}){{0,3}}(?:{word})?)", 1)
    return F.filter(F.split(F.lower(start), gap), lambda w: w != "")


@query("""WITH t AS (SELECT doc_id, source, CASE WHEN contains(text, 'that') OR contains(text, 'with') THEN 'policy' WHEN contains(text, 'from') OR contains(text, 'für') OR contains(text, 'pour') THEN 'flows' WHEN contains(text, 'the') THEN 'other' ELSE 'none' END AS topic, n_chars FROM documents)
SELECT topic, count(*) AS n, count(DISTINCT source) AS sources, sum(n_chars) AS chars FROM t GROUP BY topic""")
def news_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first topic of which any keyword occurs."""
    topic = None
    for name, words in TOPICS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains("text", F.lit(w))
        topic = F.when(hit, name) if topic is None else topic.when(hit, name)
    t = table(spark, sf_dir, "documents").select("source", "n_chars", topic.otherwise("none").alias("topic"))
    return t.groupBy("topic").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"))


@query(f"""WITH w AS (SELECT doc_id, source, {_words} AS w FROM documents), s AS (SELECT doc_id, source, len(list_filter(w, lambda x: x IN ('with', 'from', 'und', 'les'))) AS bull, len(list_filter(w, lambda x: x IN ('that', 'this', 'nicht', 'que'))) AS bear FROM w),
t AS (SELECT *, CASE WHEN bear > bull THEN least(0.5 * (bear - bull), 2) ELSE -least(0.3 * (bull - bear), 1) END AS stress FROM s) SELECT source, count(*) AS n, round(least(sum(stress), 30), 6) AS total, sum(bull) AS bull, sum(bear) AS bear FROM t GROUP BY source""")
def lexicon_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-word lexicon counts to a stress score of each source."""
    d = table(spark, sf_dir, "documents").select("source", _lower_words().alias("w"))
    hits = lambda words: F.size(F.filter("w", lambda x: x.isin(words)))
    s = d.select("source", hits(BULL).alias("bull"), hits(BEAR).alias("bear"))
    net = F.col("bear") - F.col("bull")
    s = s.withColumn("stress", F.when(net > 0, F.least(0.5 * net, F.lit(2.0))).otherwise(-F.least(-0.3 * net, F.lit(1.0))))
    return rounded(s.groupBy("source").agg(F.count("*").alias("n"), F.least(F.sum("stress"), F.lit(30.0)).alias("total"), F.sum("bull").alias("bull"), F.sum("bear").alias("bear")))


@query("""WITH k AS (SELECT doc_id, md5(lower(substr(text, 1, 60))) AS k FROM documents), r AS (SELECT k, min(doc_id) AS doc_id, count(*) AS copies FROM k GROUP BY k) SELECT k, doc_id, copies FROM r""")
def dedup_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with the same lower-cased beginning are one; the first wins. The key defines the feature."""
    k = F.md5(F.lower(F.substring("text", 1, 60)))
    return table(spark, sf_dir, "documents").select("doc_id", k.alias("k")).groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(f"""WITH w AS (SELECT doc_id, {_words} AS w FROM documents), k AS (SELECT doc_id, array_to_string(list_concat(w[1:4], w[greatest(len(w) - 3, 1):]), ' ') AS k FROM w)
SELECT doc_id, least(1, count(*) OVER (PARTITION BY k) / 2) AS confirmed FROM k""")
def confirm_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far other articles confirm one: half its key's count, at most 1. The key is the first four and last four words, which
    anchored patterns find at either end; counts are pre-aggregated and joined back."""
    ends = F.concat(_first_words("text"), F.transform(F.reverse(_first_words(F.reverse("text"))), F.reverse))
    k = table(spark, sf_dir, "documents").select("doc_id", F.array_join(ends, " ").alias("k"))
    c = k.groupBy("k").agg(F.count("*").alias("c"))
    return k.join(c, "k").select("doc_id", F.least(F.lit(1.0), F.col("c") / 2).alias("confirmed"))


@query("""WITH i AS (SELECT source, doc_id, n_chars / 1000.0 AS impact FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY impact DESC, doc_id) AS k FROM i)
SELECT source, round(least(10, sum(least(5, 5 * impact)) FILTER (k <= 5) + 0.1 * sum(least(5, 5 * impact))), 6) AS total FROM r GROUP BY source""")
def news_top5_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five strongest articles of each source, plus a tenth of all, capped. The top five are kept by partial aggregation."""
    i = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") / 1000.0).alias("impact"))
    stress = F.least(F.lit(5.0), 5 * F.col("impact"))
    w = Window.partitionBy("source").orderBy(F.desc("impact"), "doc_id")
    top = i.withColumn("k", F.row_number().over(w)).where("k <= 5").groupBy("source").agg(F.sum(stress).alias("top"))
    all_ = i.groupBy("source").agg(F.sum(stress).alias("all"))
    return all_.join(top, "source").select("source", F.round(F.least(F.lit(10.0), F.col("top") + 0.1 * F.col("all")), 6).alias("total"))


@query(r"""SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS n, max(length(regexp_extract(html, '<title>([^<]*)</title>', 1))) AS longest_title FROM pages GROUP BY 1""")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host, and their titles."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.length(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("t"))
    return p.groupBy("host").agg(F.count("*").alias("n"), F.max("t").alias("longest_title"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages""")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup removed by patterns."""
    t = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"\s+", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(t).alias("plain"))


@query(r"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value * CAST(json_extract_string(props, '$.k') AS BIGINT) AS weighted FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON read with a declared schema."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), (F.col("value") * k).alias("weighted"))


@query("""WITH x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '(' || format('{:,.1f}', n_chars * 13.5) || ')' WHEN 1 THEN '-' WHEN 2 THEN format('{:,.1f}', n_chars * 13.5) ELSE '$' || format('{:,.1f}', n_chars * 13.5) END AS s FROM documents)
SELECT doc_id, CASE WHEN s LIKE '(%' THEN -1 ELSE 1 END * TRY_CAST(regexp_replace(s, '[(),$]', '', 'g') AS DOUBLE) AS v FROM x""")
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed negatives, currency signs, thousands separators and dashes (missing) to numbers."""
    n = F.format_number(F.col("n_chars") * 13.5, 1)
    kind = F.col("doc_id") % 4
    s = F.when(kind == 0, F.concat(F.lit("("), n, F.lit(")"))).when(kind == 1, "-").when(kind == 2, n).otherwise(F.concat(F.lit("$"), n))
    x = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    sign = F.when(F.startswith("s", F.lit("(")), -1).otherwise(1)
    return x.select("doc_id", (sign * F.expr("try_cast(regexp_replace(s, '[(),$]', '') AS double)")).alias("v"))


# Named and numbered character references of a news feed.
REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&rsquo;", "’"), ("&hellip;", "…"), ("&amp;", "&")]
_replaced = "t"
for _a, _b in REFERENCES:
    _replaced = "replace({}, '{}', '{}')".format(_replaced, _a, _b.replace("'", "''"))


@query(f"""WITH x AS (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS t FROM pages) SELECT page_id, length({_replaced}) AS n, md5({_replaced}) AS digest FROM x""")
def html_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup dropped and character references decoded, the ampersand last."""
    t = F.regexp_replace("html", "<[^>]+>", " ")
    for a, b in REFERENCES:
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query(r"""SELECT page_id, i::INTEGER AS i, trim(regexp_replace(c, '<[^>]+>', '', 'g')) AS item FROM (SELECT page_id, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS c FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) AS c FROM pages))""")
def html_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a repeated element, in their order, as rows."""
    c = F.regexp_extract_all("html", F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1))
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(c).alias("i", "c"))
    return p.select("page_id", (F.col("i") + 1).alias("i"), F.trim(F.regexp_replace("c", "<[^>]+>", "")).alias("item"))


@query("""WITH x AS (SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS s FROM orders) SELECT o_orderkey, s, CAST(strptime(s, '%d %b %Y') AS DATE) AS day FROM x""", text=("day",))
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates like '11 Jan 2024'."""
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd MMM yyyy").alias("s"))
    return x.select("o_orderkey", "s", F.to_date("s", "dd MMM yyyy").alias("day"))


@query("""WITH a AS (SELECT doc_id, source, n_chars / 1000.0 AS stress, doc_id % 50 AS age, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 ELSE 99 END AS prio FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY stress DESC, doc_id) AS k FROM a), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k > 5, CASE WHEN k <= 5 THEN k END, prio, age DESC, stress DESC, doc_id) AS place FROM f)
SELECT source, doc_id, place FROM o WHERE place <= 20""")
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty headlines of each source: the five strongest, then by priority, age and strength (a top-k report)."""
    lang = F.col("lang")
    prio = F.when(lang == "en", 0).when(lang == "de", 1).when(lang == "fr", 2).when(lang == "es", 3).otherwise(99)
    a = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") / 1000.0).alias("stress"), (F.col("doc_id") % 50).alias("age"), prio.alias("prio"))
    by = ("prio", F.desc("age"), F.desc("stress"), "doc_id")
    strongest = Window.partitionBy("source").orderBy(F.desc("stress"), "doc_id")
    rest = Window.partitionBy("source").orderBy(*by)
    # The five, and of the others no more than can be shown: both limits apply before the shuffle.
    top = a.withColumn("k", F.row_number().over(strongest)).where("k <= 5").select("source", "doc_id", F.col("k").alias("place"))
    others = a.withColumn("n", F.row_number().over(rest)).where("n <= 20").join(top.select("source", "doc_id"), ["source", "doc_id"], "left_anti")
    others = others.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("n")) + 5).select("source", "doc_id", "place")
    return top.union(others).where("place <= 20")
