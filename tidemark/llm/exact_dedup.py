"""Exact deduplication by content-defined chunk recipes. Built-in functions only.

1. Texts (A-Z lower-cased, nothing else) are cut into chunks where the text itself says so: after a white space between
   letters of given sets, at least MIN_CHARS and at most MAX_CHARS from the last cut. An edit moves only the cuts near it, so
   copies and texts with much in common share their chunks.
2. A document's recipe is the ordered list of its chunks' 64-bit fingerprints. Chunks are deduplicated by fingerprint and
   content (combined in the task that reads them first), so that each distinct chunk moves at most once per reading task;
   a fingerprint that stands for one content is verified as that chunk's identifier. Where one stands for several, the
   contents are numbered and the recipes are written anew with these numbers.
3. From there on texts stay where they are: recipes are grouped (combined before the shuffle, so a third of all rows in one
   group is one row per task), and only recipes that occur twice or more are joined back to their rows.

Cases: null texts count as empty, and empty texts are equal to each other; a text without any cut (another script, one very
long word) is cut every MAX_CHARS; very long texts have long recipes and are cut, moved and compared like others; rows that
repeat text and doc_id are rows of one group, of which one stays; null ids come before all others, so they stay only among
themselves (keep_id is then null); extra columns are ignored by the query and kept by drop_copies(), whatever their names
(those named like its own are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MAX_CHARS = 64, 8_192
#: What stands before a cut: one place in some hundreds of prose, so that cuts soon meet again after an edit.
CUT = r"[aeiou][nrs]\s[b-m][a-m]"
_LOWEST = -(1 << 63)


def normalised(text: str = "text") -> Column:
    """Text with A-Z lower-cased and nothing else changed; null is empty."""
    full = F.coalesce(F.col(text), F.lit(""))
    ascii_only = F.octet_length(full) == F.length(full)
    return F.when(ascii_only, F.lower(full)).otherwise(F.translate(full, UPPER, LOWER))


def chunks(text: str, least: int = MIN_CHARS, most: int = MAX_CHARS, cut: str = CUT) -> Column:
    """The content-defined chunks of a text column, in order; joined they are the text."""
    pattern = rf"(?s).{{{least},{most}}}?(?:(?<={cut})|\z)|.{{1,{most}}}"
    return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))


def fingerprint(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(docs: DataFrame, text: str = "text", name=fingerprint) -> DataFrame:
    """docs with _norm (normalised text), _chunks and _recipe (their fingerprints)."""
    return docs.withColumn("_norm", normalised(text)).withColumn("_chunks", chunks("_norm")).withColumn("_recipe", F.transform("_chunks", name))


def chunk_store(docs: DataFrame, text: str = "text", name=fingerprint) -> DataFrame:
    """The distinct chunks of all texts: h (fingerprint) and chunk."""
    found = docs.select(normalised(text).alias("_norm")).select(F.explode(chunks("_norm")).alias("chunk"))
    return found.select(name(F.col("chunk")).alias("h"), "chunk").distinct()


def _numbered(docs: DataFrame, clash: DataFrame, name) -> DataFrame:
    """Recipes where fingerprints of several contents are told apart: _fix holds, for each chunk, the content's number."""
    rows = materialize(recipes(docs.withColumn("_rid", F.monotonically_increasing_id()), name=name), "recipe-rows")
    places = rows.select("_rid", F.posexplode("_chunks").alias("pos", "chunk")).withColumn("h", name(F.col("chunk")))
    store = places.select("h", "chunk").distinct().join(clash.select("h"), "h", "left_semi")
    numbers = materialize(store.withColumn("no", F.row_number().over(Window.partitionBy("h").orderBy("chunk"))), "chunk-numbers")
    found = places.join(numbers, ["h", "chunk"], "left").select("_rid", "pos", F.coalesce("no", F.lit(0)).alias("no"))
    fixes = found.groupBy("_rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "no"))), lambda x: x["no"]).alias("_fix"))
    thin = rows.select("_rid", "doc_id", "_recipe", F.sha2("_norm", 256).alias("text_sha256"))
    return thin.join(fixes, "_rid", "left").withColumn("_fix", F.coalesce("_fix", F.array().cast("array<int>")))


def groups_of_copies(docs: DataFrame, name=fingerprint) -> DataFrame:
    """For every row of docs (doc_id long, text): doc_id, keep_id, group_size, kept and text_sha256."""
    with scratch() as own:
        thin = recipes(docs.select("doc_id", "text"), name=name).withColumn("_rid", F.monotonically_increasing_id())
        thin = thin.select("_rid", "doc_id", "_recipe", F.sha2("_norm", 256).alias("text_sha256"), F.array().cast("array<int>").alias("_fix"))
        clash = chunk_store(docs, name=name).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        clash = materialize(clash, "chunk-clashes")
        if not clash.isEmpty():
            thin = _numbered(docs.select("doc_id", "text"), clash, name).select(*thin.columns)
        thin = materialize(thin.withColumn("_key", F.xxhash64("_recipe", "_fix")), "recipes")
        own.keep(thin)
        key = ["_key", "_recipe", "_fix"]
        best = F.max_by("_rid", F.coalesce("doc_id", F.lit(_LOWEST)))
        same = thin.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"), best.alias("_best"))
        # Written, so that both sides of the join are plain shuffles, of which AQE splits the hot partitions.
        same = materialize(same.where("group_size > 1"), "recipes-shared")
        own.keep(same)
    out = thin.join(same.hint("merge"), key, "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_rid") == F.col("_best"))).alias("kept"),
        "text_sha256",
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document, and which one stays."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return groups_of_copies(docs)


ORACLE = {
    "op12_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)""",
}
