"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every measure is a column expression over the text alone, so the whole operator is one scan without a shuffle, and rules can
be added by adding rows to the table.

Cases: null or empty text has no words and fails the base; very long texts are measured whole; repeated rows give repeated
results; other columns are ignored by the query; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8

# Frequent function words of the languages that the rules know.
STOP_WORDS = (
    "the of and to in is that it for was with as be on this are by from or an at not have has "
    "le la les de des du et un une que qui pour dans est par sur pas au avec "
    "der die das und ist nicht ein eine den von zu mit sich auf für als dem des "
    "el los las y en por con para no se su una del al"
).split()

#: measure, least and most value that passes (None: no bound), words from which the rule applies.
RULES = [
    ("n_words", 20, None, 0),
    ("mean_word_chars", 2.0, 14.0, 0),
    ("symbol_ratio", None, 0.10, 0),
    ("exclamations_per_word", None, 0.50, 0),
    ("n_stop_words", 2, None, 50),
    ("dup_line_ratio", None, 0.50, 0),
    ("bullet_line_ratio", None, 0.90, 0),
    ("ellipsis_line_ratio", None, 0.30, 0),
]


def _paired(h: Column, gap: int) -> Column:
    """Fingerprints of each element with the one gap places on; null past the end."""
    return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + gap)))


def repeated_words(df: DataFrame, words: str, out: str, window: int = WINDOW) -> DataFrame:
    """df with the number of words that lie in a window of that many words found twice or more in the same text.

    Window fingerprints come from doubling: a fingerprint of 2k words is made from two of k words. Positions of repeated
    windows are looked for, by sorting, only where the distinct windows are fewer than the windows.
    """
    steps = window.bit_length() - 1
    if 1 << steps != window:
        raise ValueError("window must be a power of two")
    df = df.withColumn("_h0", F.transform(words, lambda w: F.xxhash64(w)))
    for s in range(steps):
        df = df.withColumn(f"_h{s + 1}", _paired(F.col(f"_h{s}"), 1 << s)).drop(f"_h{s}")
    whole = F.slice(F.col(f"_h{steps}"), F.lit(1), F.greatest(F.size(words) - (window - 1), F.lit(0)))
    df = df.withColumn("_w", whole).drop(f"_h{steps}")
    some = F.size(F.array_distinct("_w")) < F.size("_w")
    df = df.withColumn("_s", F.when(some, F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("_s")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    df = df.withColumn("_t", F.transform(s, lambda x, k: F.when(same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), x["i"])))
    df = df.withColumn("_p", F.sort_array(F.filter("_t", lambda i: i.isNotNull())))
    p = F.col("_p")
    reach = F.transform(p, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - i, F.lit(window))))
    total = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn(out, F.coalesce(total, F.lit(0)).cast("long")).drop("_w", "_s", "_t", "_p")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures that the base and the rules use."""
    full = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_words", F.filter(F.split(full, SPACES), lambda w: w != ""))
    df = df.withColumn("_lines", F.filter(F.split(full, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    lines = F.greatest(F.size("_lines"), F.lit(1))
    count = lambda chars: F.length(full) - F.length(F.translate(full, chars, ""))
    stops = sorted({v for w in STOP_WORDS for v in (w, w.capitalize())})
    share = lambda pattern: F.size(F.filter("_lines", lambda x: F.rlike(x, F.lit(pattern)))) / lines
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": count("#*$%&|<>").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_exclamations": count("!").cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(stops))).cast("long"),
            "bullet_line_ratio": share(r"^\s*[-*•]"),
            "ellipsis_line_ratio": share(r"(\.\.\.|…)\s*$"),
            "dup_line_ratio": (F.size("_lines") - F.size(F.array_distinct("_lines"))) / lines,
        }
    ).drop("_lines")
    df = repeated_words(df, "_words", "n_repeat_words").drop("_words")
    words = F.greatest("n_words", F.lit(1))
    return df.withColumns({"mean_word_chars": F.col("word_chars") / words, "symbol_ratio": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)), "exclamations_per_word": F.col("n_exclamations") / words})


def verdict(rules=RULES) -> Column:
    """Whether all rules pass, as one expression."""
    passes = F.lit(True)
    for name, least, most, from_words in rules:
        x, ok = F.col(name), F.lit(True)
        ok = ok & (x >= least) if least is not None else ok
        ok = ok & (x <= most) if most is not None else ok
        passes = passes & ((F.col("n_words") < from_words) | ok if from_words else ok)
    return passes


def judge(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """docs with all measures, base_failed and kept."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measures(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures and the verdict for every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_IN = ", ".join(f"'{w}'" for w in sorted({v for w in STOP_WORDS for v in (w, w.capitalize())}))
ORACLE = {
    "op7_quality": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM b WHERE len(w) >= 8),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM win),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM h) WHERE n >= 2),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id),
m AS (SELECT b.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             (length(text) - length(replace(text, '!', '')))::BIGINT AS ex, len(list_filter(w, lambda x: x IN ({_IN}))) AS st,
             len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS bu, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS el,
             greatest(len(l), 1) AS nl
      FROM b LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words >= 20 AND word_chars / n_words >= 2.0 AND word_chars / n_words <= 14.0
       AND n_symbols / word_chars <= 0.10 AND ex / n_words <= 0.50 AND (n_words < 50 OR st >= 2)
       AND n_dup_lines / nl <= 0.50 AND bu / nl <= 0.90 AND el / nl <= 0.30 AS kept
FROM f""",
}
