"""Fill-in-middle transformation by escaped marker injection. Built-in functions only, one projection, no shuffle.

A delimiter is escaped in the text, regexp_replace appends it after every unit (a code point, or what another pattern
matches), their number is how much longer the text became, substring_index takes the parts before the two cuts, and the parts
are unescaped and put together. The cuts and the form come from a digest of the row's id, so reruns agree.

Cases: null texts count as empty, and empty texts are plain; a text that holds one of the markers stays plain, so that every
other output can be taken apart again; a text that holds the delimiter or the escape sign itself is restored exactly; a null
id has the digest of an empty id; very long texts are cut whole; repeated rows give repeated results; extra columns are kept
by transform() (those named like its own are replaced) and ignored by the query; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ESCAPE, DELIMITER = "\x1e", "\x1f"
#: Units: a code point; a word with the white space before it. An escaped sign is one unit of the first kind.
CODE_POINTS, WORDS = rf"(?s){ESCAPE}[01]|.", r"\s*\S+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are cut, and of these that put the suffix first.
CUT_PERCENT, SPM_PERCENT = 90, 20


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escaped(text: Column) -> Column:
    return _replace(_replace(text, ESCAPE, ESCAPE + "0"), DELIMITER, ESCAPE + "1")


def unescaped(part: Column) -> Column:
    """A part of a marked text without the delimiters that were put in, and with the text's own signs."""
    return _replace(_replace(_replace(part, DELIMITER, ""), ESCAPE + "1", DELIMITER), ESCAPE + "0", ESCAPE)


def _number(digest: str, k: int) -> Column:
    """The k-th group of eight hexadecimal digits."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", unit: str = CODE_POINTS, seed: int = 1) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output."""
    own = ["n", "form", "prefix", "middle", "suffix", "output"]
    kept = [c for c in docs.columns if c not in own]
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    df = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_full"), F.sha2(name, 256).alias("_digest"))
    df = df.withColumn("_escaped", escaped(F.col("_full")))
    df = df.withColumn("_marked", F.regexp_replace("_escaped", unit, "$0" + DELIMITER))
    df = df.withColumn("n", (F.length("_marked") - F.length("_escaped")).cast("long")).drop("_escaped")
    one, two = (_number("_digest", k) % (F.col("n") + 1) for k in (0, 1))
    held = F.contains("_full", F.lit(PREFIX)) | F.contains("_full", F.lit(SUFFIX)) | F.contains("_full", F.lit(MIDDLE))
    plain = (F.col("_full") == "") | held | (_number("_digest", 2) % 100 >= CUT_PERCENT)
    form = F.when(plain, "plain").when(_number("_digest", 3) % 100 < SPM_PERCENT, "spm").otherwise("psm")
    df = df.withColumns({"_a": F.least(one, two).cast("int"), "_b": F.greatest(one, two).cast("int"), "form": form}).drop("_digest")
    cut = F.col("form") != "plain"
    df = df.withColumn("_head", F.when(cut, F.expr(f"substring_index(_marked, '{DELIMITER}', _b)")))
    df = df.withColumn("_first", F.when(cut, F.expr(f"substring_index(_head, '{DELIMITER}', _a)")))
    after = lambda whole, part, k: F.expr(f"substr({whole}, length({part}) + if({k} > 0, 2, 1))")
    df = df.withColumns({"_middle": F.when(cut, after("_head", "_first", "_a")), "_rest": F.when(cut, after("_marked", "_head", "_b"))}).drop("_marked", "_head")
    df = df.withColumns({"prefix": unescaped(F.col("_first")), "middle": unescaped(F.col("_middle")), "suffix": unescaped(F.col("_rest"))})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    df = df.withColumn("output", F.when(~cut, F.col("_full")).when(F.col("form") == "psm", psm).otherwise(spm))
    return df.select(*kept, *own)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, taken from the output and its form alone: as parts hold no markers, each marker's
    first place is where it was put."""
    order = [(PREFIX, SUFFIX), (SUFFIX, PREFIX)]
    first, second = (f"substring_index(substring_index({output}, '{y}', 1), '{x}', -1)" for x, y in order)
    # psm: <P>prefix<S>suffix<M>middle; spm: <S>suffix<P>prefix<M>middle
    last = f"substring_index({output}, '{MIDDLE}', -1)"
    between = lambda mark: f"substring_index(substring_index({output}, '{MIDDLE}', 1), '{mark}', -1)"
    return F.expr(f"CASE {form} WHEN 'plain' THEN {output} WHEN 'psm' THEN concat({first}, {last}, {between(SUFFIX)}) ELSE concat({between(PREFIX)}, {last}, {second}) END")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of the transformed text of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    df = transform(docs).withColumn("restored", restored())
    return df.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


ORACLE = {
    "op13_fill_middle": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT doc_id, x, length(x)::BIGINT AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
             ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT doc_id, x, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(x, 1, a) AS pre, substring(x, a + 1, b - a) AS mid, substring(x, b + 1) AS suf FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                     ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(output) AS output_sha256, sha256(x) AS restored_sha256 FROM o""",
}
