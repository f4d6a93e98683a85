"""A training-corpus pipeline over documents: toxicity, line dedup, n-gram Jaccard join, mixing, BPE.

Each stage takes (spark, docs, folder of tables) and returns a frame; the next one reads it back from Parquet. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from tidemark.llm.common import WORD, crc_bucket, materialize, release, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates here: shingles of five words, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_bucket("doc_id", 5) != 0)
    scored = toxicity.score(docs.select(*COLUMNS), model)
    return scored.where(F.col("toxicity") < 0.5).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those of which nothing is left go."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    left = (F.col("_n_removed") == 0) | F.rlike(F.col("text"), F.lit(WORD))
    changed = F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(left).withColumn("n_chars", changed).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: the one with the least id (rows without id come last, then by text)."""
    found = ngram_join.similar(docs, SHINGLE, PERCENT).where(F.col("component").isNotNull())
    found = materialize(found.select("doc_id", "text_hash", "component"), "stage-components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = found.groupBy("component").agg(F.min(order).alias("first")).hint("merge")
    gone = found.join(first, "component").where(order != F.col("first")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    docs = docs.select(*COLUMNS)
    same = docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"])
    kept = docs.join(gone, same, "left_anti")
    # Rows that repeat both id and text are copies too; they are rare, so only then are texts grouped.
    if not found.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        words = F.rlike(F.col("text"), F.lit(WORD))
        kept = kept.where(words).dropDuplicates(["doc_id", "text"]).union(kept.where(~F.coalesce(words, F.lit(False))))
    return kept


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights; documents taken twice come twice."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of what is left."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: Toxicity is learned here, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch() as own:  # what the stage wrote on its way goes, and so does the stage before
            done = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            own.keep(done)
        release(docs)
        docs = done
    return docs
