"""Deletion of repeated line runs by prefix doubling over line-ID sequences.

A line's ID is a fingerprint of the line without outer blanks; lines without a word are not part of the sequence. A run of
whole lines counts if it holds at least min_words words. A later copy of such a run is deleted whole; its first occurrence,
in the order of (doc_id, place), stays. Overlapping copies are all judged on the original texts.

How: the suffixes of all documents' sequences are named by their first 1, 2, 4, ... lines. Round k joins the names of two
halves into one and groups all suffixes by it (counting and the earliest place are pre-aggregated, so a line that a third of
all documents share is one row after the map side); only suffixes in groups of two or more can have a longer common prefix,
so only these go on. A group is an interval of the suffix array whose longest common prefix reaches that depth. As every line
has a word, min_words lines are deep enough: every counting run is the union of its shortest counting windows (from each line
on, and up to each line), a window's interval follows from two overlapping names, and the windows that are not first of
their interval cover exactly what is to go, i.e. the later copies of all maximal repeated runs.

Cases: null and empty texts have no lines and stay as they are; rows with equal doc_id and text count as one document and get
equal results; a null doc_id sorts first; very long texts are handled whole; ties cannot occur since places differ; other
columns are kept as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialize, mix64, scratch, table

MIN_WORDS = 5
NAMES = pa.schema([("name", pa.int64()), ("_d", pa.int64()), ("_h", pa.int64()), ("i", pa.int32())])
WINDOWS = NAMES.append(pa.field("n", pa.int32()))
GONE = pa.schema([("_d", pa.int64()), ("_h", pa.int64()), ("_drop", pa.list_(pa.bool_())), ("_n_removed", pa.int64())])


def _records(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[list[dict]]:
    """Rows as dicts, some at a time: a batch's lists of places need not all be Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows).to_pylist()


def _sequences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document: its key, and place, ID and words of each line that has a word."""
    lines = F.split(F.col(text), "\n")
    each = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.xxhash64(F.btrim(x, F.lit(" \t\r\f\v"))).alias("id"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    kept = docs.select(*_key(doc_id, text), F.filter(each, lambda x: x["n"] > 0).alias("l")).where(F.size("l") > 0)
    return kept.select("_d", "_h", F.col("l.at").alias("at"), F.col("l.id").alias("ids"), F.col("l.n").alias("words"))


def _key(doc_id: str, text: str):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("_d"), F.xxhash64(F.col(text)).alias("_h")


def _join_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * np.uint64(3) + mix64(b))


def _names(ids: np.ndarray, levels: int) -> list[np.ndarray]:
    """Names of the runs of 1, 2, 4, ... lines from each place on; shorter at the end, where runs do not fit."""
    out = [ids.astype(np.int64).view(np.uint64)]
    for k in range(levels):
        half = 1 << k
        prior = out[-1]
        out.append(_join_names(prior[:-half], prior[half:]) if len(prior) > half else np.empty(0, np.uint64))
    return out


def _windows(words: np.ndarray, least: int) -> set[tuple[int, int]]:
    """(start, lines) of the shortest windows of at least so many words, from each line on and up to each line; single
    lines that hold enough are left out."""
    ends = np.concatenate([[0], np.cumsum(words)])
    found = set()
    for i in range(len(words)):
        j = int(np.searchsorted(ends, ends[i] + least))
        if j <= len(words) and j - i > 1:
            found.add((i, j - i))
        j = int(np.searchsorted(ends, ends[i + 1] - least, side="right")) - 1
        if ends[i + 1] >= least and i + 1 - j > 1:
            found.add((j, i + 1 - j))
    return found


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows (name, _d, _h, i) that share their name with another place, with whether an earlier one has it."""
    place = F.struct("_d", "_h", "i")
    groups = rows.groupBy("name").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("name", "first")
    groups = materialize(groups, "lines-groups")  # a written table on one side lets the join split a hot name on the other
    return rows.join(groups, "name").select("_d", "_h", "i", (place != F.col("first")).alias("later"))


def _by_document(hits: DataFrame, name: str) -> DataFrame:
    return hits.groupBy("_d", "_h").agg(F.collect_set(F.struct("i", "later")).alias(name))


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(_d, _h, _drop, _n_removed): of each document with something to delete, which lines go (up to the last one that does)."""
    base = materialize(_sequences(docs, doc_id, text), "lines")
    first = base.select("_d", "_h", F.posexplode("ids").alias("i", "name"))
    state = materialize(base.join(_by_document(_grouped(first), "hits"), ["_d", "_h"]), "lines-0")
    # Only documents with a repeated line shorter than min_words next to another repeated one need longer runs.
    levels = max(0, min_words.bit_length() - 1)
    for k in range(1, levels + 1):
        rows = materialize(state.mapInArrow(_level(k, min_words), "name long, _d long, _h long, i int"), f"lines-names-{k}")
        if rows.isEmpty():
            break
        state = materialize(state.join(_by_document(_grouped(rows), f"hits{k}"), ["_d", "_h"], "left"), f"lines-{k}")
    reached = [c for c in state.columns if c.startswith("hits")]
    rows = state.mapInArrow(_final(len(reached) - 1, min_words), "name long, _d long, _h long, i int, n int")
    rows = materialize(rows, "lines-windows")
    found = _grouped_windows(rows)
    state = state.join(found, ["_d", "_h"], "left")
    return state.mapInArrow(_collect(min_words), "_d long, _h long, _drop array<boolean>, _n_removed long").dropDuplicates(["_d", "_h"])


def _grouped_windows(rows: DataFrame) -> DataFrame:
    """Of each document the windows (start, lines) whose content occurred before."""
    place = F.struct("_d", "_h", "i")
    groups = rows.groupBy("name", "n").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("name", "n", "first")
    hits = rows.join(groups, ["name", "n"]).where(place != F.col("first"))
    return hits.groupBy("_d", "_h").agg(F.collect_set(F.struct("i", "n")).alias("copies"))


def _repeated(row: dict, k: int) -> np.ndarray:
    """Which places start a run of 2**k lines that occurs elsewhere too."""
    out = np.zeros(len(row["ids"]), dtype=bool)
    hits = row.get("hits" if k == 0 else f"hits{k}")
    if hits is not None and len(hits):
        out[[h["i"] for h in hits]] = True
    return out


def _level(k: int, min_words: int):
    """Names of runs of 2**k lines, where both halves are repeated and some window needs a run that long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in _records(batches):
            parts = []
            for row in records:
                half, n = 1 << (k - 1), len(row["ids"])
                if n < 2 * half:
                    continue
                wanted = np.zeros(n, dtype=bool)
                for i, size in _windows(np.asarray(row["words"]), min_words):
                    if size >= 2 * half:
                        top = 1 << (size.bit_length() - 1)
                        for s in {i, i + size - top}:
                            wanted[s : s + top - 2 * half + 1] = True
                prior = _repeated(row, k - 1)
                go = wanted[: n - 2 * half + 1] & prior[: n - 2 * half + 1] & prior[half : n - half + 1]
                at = np.flatnonzero(go)
                if len(at):
                    names = _names(np.asarray(row["ids"]), k)[k][at].view(np.int64)
                    parts.append(pd.DataFrame({"name": names, "_d": row["_d"], "_h": row["_h"], "i": at.astype(np.int32)}))
            if parts:
                yield pa.RecordBatch.from_pandas(pd.concat(parts), NAMES, preserve_index=False)

    return run


def _final(levels: int, min_words: int):
    """Names of the windows of more than one line whose two overlapping halves are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in _records(batches):
            rows = []
            for row in records:
                repeated = [_repeated(row, k) for k in range(levels + 1)]
                names = None
                for i, size in sorted(_windows(np.asarray(row["words"]), min_words)):
                    k = size.bit_length() - 1
                    j = i + size - (1 << k)
                    if k <= levels and repeated[k][i] and repeated[k][j]:
                        names = names or _names(np.asarray(row["ids"]), levels)
                        name = int(_join_names(names[k][i : i + 1], names[k][j : j + 1]).view(np.int64)[0])
                        rows.append((name, row["_d"], row["_h"], i, size))
            if rows:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["name", "_d", "_h", "i", "n"]), WINDOWS, preserve_index=False)

    return run


def _collect(min_words: int):
    """The lines that later copies cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in _records(batches):
            out = []
            for row in records:
                words, gone = np.asarray(row["words"]), np.zeros(len(row["ids"]), dtype=bool)
                for h in row["hits"]:
                    if h["later"] and words[h["i"]] >= min_words:
                        gone[h["i"]] = True
                for c in row["copies"] if row["copies"] is not None else ():
                    gone[c["i"] : c["i"] + c["n"]] = True
                if gone.any():
                    at = np.asarray(row["at"])[gone]
                    mask = np.zeros(int(at[-1]) + 1, dtype=bool)
                    mask[at] = True
                    out.append((row["_d"], row["_h"], mask, len(at)))
            if out:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["_d", "_h", "_drop", "_n_removed"]), GONE, preserve_index=False)

    return run


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text cleaned and two columns more (replacing those of these names): _n_lines (with a word) and _n_removed."""
    at = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    docs, doc_id, text = docs.toDF(*at.values()), at[doc_id], at[text]
    with scratch() as own:
        gone = materialize(removals(docs, doc_id, text, min_words), "lines-gone")
        own.keep(gone)
    d, h = _key(doc_id, text)
    joined = docs.withColumns({"_d": d, "_h": h}).join(gone, ["_d", "_h"], "left")
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda x, i: ~F.coalesce(F.get("_drop", i), F.lit(False)))
    cleaned = F.array_join(kept, "\n")
    cleaned = F.when(F.col("_drop").isNull(), F.col(text)).when(F.rlike(cleaned, F.lit(WORD)), cleaned).otherwise("")
    n_lines = F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(WORD))))
    counts = {"_n_lines": F.coalesce(F.when(F.col(text).isNotNull(), n_lines), F.lit(0)).cast("long"), "_n_removed": F.coalesce("_n_removed", F.lit(0).cast("long"))}
    joined = joined.withColumns(counts).withColumn(text, cleaned)
    return joined.select(*[F.col(n).alias(c) for c, n in at.items() if c not in counts], *counts)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup does to every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


_WIN = " UNION ALL ".join(f"SELECT doc_id, i, {n} AS n, array_to_string(t[i:i + {n - 1}], chr(10)) AS g FROM s, unnest(range(1, len(t) - {n - 2})) AS r(i) WHERE list_sum(w[i:i + {n - 1}]) >= 5" for n in range(1, 6))
ORACLE = {
    "op2_line_dedup": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pl FROM documents),
p AS (SELECT doc_id, pl, x, trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS c, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS k FROM l),
s AS (SELECT doc_id, list(c ORDER BY pl) AS t, list(k ORDER BY pl) AS w, list(pl ORDER BY pl) AS a FROM p WHERE k > 0 GROUP BY doc_id),
win AS ({_WIN}),
later AS (SELECT doc_id, i, n FROM (SELECT *, row_number() OVER (PARTITION BY n, g ORDER BY doc_id, i) AS o FROM win) WHERE o > 1),
cut AS (SELECT DISTINCT later.doc_id, a[j] AS pl FROM later JOIN s USING (doc_id), unnest(range(i, i + n)) AS r(j)),
k AS (SELECT p.doc_id, string_agg(x, chr(10) ORDER BY p.pl) FILTER (cut.pl IS NULL) AS t, count(*) FILTER (p.k > 0) AS n_lines,
             count(cut.pl) AS n_removed, coalesce(sum(p.k) FILTER (cut.pl IS NULL), 0) AS left_words
      FROM p LEFT JOIN cut ON p.doc_id = cut.doc_id AND p.pl = cut.pl GROUP BY p.doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       length(coalesce(CASE WHEN n_removed > 0 AND left_words = 0 THEN '' ELSE t END, ''))::BIGINT AS kept_chars,
       sha256(coalesce(CASE WHEN n_removed > 0 AND left_words = 0 THEN '' ELSE t END, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)""",
}
