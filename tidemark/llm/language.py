"""Language identification in two steps: the language family first, then one-versus-one linear SVMs inside the family.

Features are hashed counts of one, two and three letters in a row (words set apart by one blank, case folded), of the whole
text. All machines are linear without a threshold, so a text's verdict is a sum of weights over its letter runs, and long
texts are summed in pieces. Learning takes at most sample_rows rows (two of each language at least), spread evenly over the
languages (those with the least hash of id and text), of at most max_languages languages. Families are a table of the genus of common languages; a language outside it is a family of its own.

Cases: null texts and texts without a letter get "und" and score 0; without any labelled row every text gets "und"; one
language only is predicted with score 1; null labels are not learned from; rows that repeat id, text and label are learned
from once, and null ids and different texts under one id are rows of their own; repeated rows give repeated results; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_bucket, materialize, table

BUCKETS = 1 << 15
SAMPLE_ROWS = 6_000
#: Languages to learn, the most frequent ones; a bound on the model, 128 kB for each.
MAX_LANGUAGES = 1_000
PARTS = 256
SEED = 113
PIECE = 1_000_000

# Families of common languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "baltic": "lt lv".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "celtic": "ga cy gd br".split(),
    "indic": "hi mr ne bn gu pa ur".split(),
    "semitic": "ar he mt am".split(),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_apart = re.compile(r"[\W\d_]+")


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], f"own:{lang}")


def runs(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the letter runs of a text, piece after piece; nothing if it has no letter."""
    for at in range(0, len(text), PIECE):
        plain = _apart.sub(" ", text[max(0, at - 2) : at + PIECE].lower()).strip()
        if not plain:
            continue
        c = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        two = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:]
        three = two[:-1] * np.uint32(0x85EBCA6B) ^ c[2:]
        for h in (c * np.uint32(0x27D4EB2F), two * np.uint32(0xC2B2AE35), three * np.uint32(0x165667B1)):
            yield (h >> np.uint32(17)).astype(np.int32)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts scaled to length one."""
    total = np.zeros(BUCKETS)
    for b in runs(text):
        total += np.bincount(b, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / max(1e-12, np.sqrt((total**2).sum()))).astype(np.float32)


def machine(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, c: float = 5.0) -> np.ndarray:
    """A linear support vector machine (hinge loss, L2) by dual coordinate descent; y is -1 or 1."""
    w, alpha = np.zeros(BUCKETS), np.zeros(len(y))
    rng = np.random.default_rng(SEED)
    norm = np.array([float((v * v).sum()) for _, v in x]) + 1e-9
    share = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}  # rarer sides may err less
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at, v = x[i]
            slope = y[i] * float(w[at] @ v) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), c * share[int(y[i])])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
    return w


def learn(docs: DataFrame, keep: Column, sample_rows: int = SAMPLE_ROWS, max_languages: int = MAX_LANGUAGES) -> dict:
    """A model from docs (doc_id, text, lang) among rows for which keep holds."""
    rows = docs.where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    order = F.xxhash64(F.lit(SEED), "doc_id", "text")
    thin = materialize(rows.select("lang", order.alias("o")), "language-rows")
    counts = thin.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not counts:
        return {"langs": []}
    each = max(2, sample_rows // len(counts))
    # Equal rows share their order and are learned from once. The least of each language: first of some hundred parts of the
    # order, which no hot language leaves in one task, then of what these leave; only what lies under that cut is read again.
    known = thin.join(F.broadcast(thin.sparkSession.createDataFrame([(r["lang"],) for r in counts], "lang string")), "lang").distinct()
    part = known.withColumn("part", F.pmod("o", F.lit(PARTS)))
    some = part.withColumn("n", F.row_number().over(Window.partitionBy("lang", "part").orderBy("o"))).where(F.col("n") <= each)
    least = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("o"))).where(F.col("n") <= each)
    cuts = F.broadcast(least.groupBy("lang").agg(F.max("o").alias("_cut")).withColumnRenamed("lang", "_lang"))
    sample = rows.withColumn("_o", order).join(cuts, F.col("lang") == F.col("_lang")).where(F.col("_o") <= F.col("_cut"))
    # One of each order: rows that repeat id and text are one, however many there are, before anything comes to the driver.
    sample = sample.select("text", "lang", "_o").dropDuplicates(["lang", "_o"])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [counted(t) for t in f["text"]]
            yield pd.DataFrame({"o": f["_o"], "lang": f["lang"], "at": [g[0] for g in got], "v": [g[1] for g in got]})

    got = sample.mapInPandas(count, "o long, lang string, at array<int>, v array<float>").toPandas().sort_values(["o", "lang"])
    x = [(np.asarray(a, np.int32), np.asarray(v, np.float32)) for a, v in zip(got["at"], got["v"], strict=True)]
    named = got["lang"].to_numpy()
    full = np.array([len(a) > 0 for a, _ in x])
    x, named = [p for p, ok in zip(x, full, strict=True) if ok], named[full]
    langs = sorted(set(named))
    families = sorted({family_of(k) for k in langs})
    fam = np.array([family_of(k) for k in named])
    tasks = [("family", f, None, np.arange(len(x)), np.where(fam == f, 1, -1)) for f in (families if len(families) > 2 else families[:1] if len(families) == 2 else [])]
    for f in families:
        for a, b in combinations([k for k in langs if family_of(k) == f], 2):
            rows_ = np.flatnonzero((named == a) | (named == b))
            tasks.append(("pair", a, b, rows_, np.where(named[rows_] == a, 1, -1)))
    weights, scales = np.zeros((BUCKETS, max(1, len(tasks))), np.float32), []
    for k, (_, _, _, rows_, y) in enumerate(tasks):
        own = [x[i] for i in rows_]
        w = machine(own, y)
        weights[:, k] = w
        # Margins here are sums over counts; what is compared is the sum over the number of runs.
        margins = [abs(float(w[at] @ v)) / max(1e-9, float(v.sum())) for at, v in own]
        scales.append(3.0 / max(1e-9, float(np.median(margins))))
    return {"langs": langs, "families": families, "tasks": [t[:3] for t in tasks], "weights": weights, "scales": np.array(scales)}


def decide(model: dict, text: str | None) -> tuple[str, float]:
    """The language of one text and how sure that is."""
    if not text or not model["langs"]:
        return "und", 0.0
    total, n = np.zeros(model["weights"].shape[1]), 0
    for b in runs(text):
        total += model["weights"].take(b, axis=0).sum(axis=0, dtype=np.float64)
        n += len(b)
    if not n:
        return "und", 0.0
    margin = total[: len(model["scales"])] / n * model["scales"]
    sure = lambda m: float(1 / (1 + np.exp(-np.clip(m, -30, 30))))
    families, tasks = model["families"], model["tasks"]
    p, family = 1.0, families[0]
    if len(families) == 2:
        family, p = (families[0], sure(margin[0])) if margin[0] >= 0 else (families[1], sure(-margin[0]))
    elif len(families) > 2:
        k = int(np.argmax(margin[: len(families)]))
        family, p = families[k], sure(margin[k])
    inside = [k for k in model["langs"] if family_of(k) == family]
    if len(inside) == 1:
        return inside[0], p
    wins, lead, worst = dict.fromkeys(inside, 0), dict.fromkeys(inside, 0.0), dict.fromkeys(inside, np.inf)
    for (kind, a, b), m in zip(tasks, margin, strict=True):
        if kind == "pair" and a in wins and b in wins:
            for lang, own in ((a, m), (b, -m)):
                wins[lang] += own > 0
                lead[lang] += own
                worst[lang] = min(worst[lang], own)
    best = max(inside, key=lambda k: (wins[k], lead[k], k))
    return best, p * sure(worst[best])


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs, from the text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS weights for each machine

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for f in frames:
            got = [decide(m, t if isinstance(t, str) else None) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = learn(docs, F.coalesce(crc_bucket("doc_id", 3), F.lit(0)) != 1)
    held = F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return predict(docs, model).select("doc_id", held, "lang_pred", "score")
