"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Learning looks only at labelled rows, at most sample_rows of them (those with the least hash of their id, so the choice is
repeatable and does not depend on partitions). Three parts of the sample have three uses: the lexicon is counted on one, the
trees grow on the next, and the calibration is fitted on the last; so no feature has seen the label it is trained on. For
scoring, the lexicon is counted anew on the whole sample.

The lexicon holds words, word beginnings (inflected forms share them) and a list of common insults, each with the log odds
of being in a toxic document. Words are compared with case, repeated letters, inner punctuation and digits or signs in place
of letters undone. Features: densities and peaks of the lexicon, the share of lexicon hits near a second-person word, capitals,
punctuation, and rates of obfuscated words. Scoring is one scan without a shuffle.

Cases: null and empty texts get the features of a text without words, hence a score; labels that are null are not learned
from, and an id with both labels counts as toxic; with no labelled rows, or one class only, every score is that class's share
(0 without any); very long texts are scored whole; repeated rows give repeated results; other columns are ignored by the query; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_bucket, table

#: Labelled documents to learn from at most.
SAMPLE_ROWS = 24_000
#: Entries that the lexicon holds at most.
LEXICON = 5_000
#: Least log likelihood ratio, against the class shares, of an entry: four toxic documents without a clean one, or more.
SURPRISE = 7.0
SEED = 71
#: Terms that a task counts before it hands them on.
COUNTED_TERMS = 500_000
#: Words whose worth a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 100_000
PREFIXES = (4, 5, 6)

# Common insults, and second-person words, of English, German, French and Spanish.
INSULTS = set(
    "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns dumb fool imbecile jerk filth vermin bastard "
    "dummkopf trottel abschaum blödmann arschloch depp dumm wertlos erbärmlich crétin connard imbécile ordure minable débile raclure "
    "idiota imbécil estúpido basura escoria payaso inútil asqueroso patético".split()
)
SECOND_PERSON = set("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti contigo usted ustedes vosotros os vuestro".split())
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"})

_word = re.compile(r"[^\x20\x09-\x0D]+")
_edges = ".,;:!?\"'()[]{}<>#%&*$…«»“”‘’-–—_/\\+=~^|`"
_inner = re.compile(r"[\W_]+")
_thrice = re.compile(r"(.)\1{2,}")
_spaced = re.compile(r"(?<!\S)(?:\w[ .\-_*]){3,}\w(?!\S)")
N_FEATURES = 14


def plain(word: str) -> tuple[str, bool]:
    """A word as the lexicon has it, and whether something had to be undone for it."""
    w = word.strip(_edges).lower()
    if w.isalpha():
        short = _thrice.sub(r"\1", w)
        return short, short != w
    letters = sum(c.isalpha() for c in w)
    if 3 * letters < len(w) or letters < 2:
        return w, False
    undone = _thrice.sub(r"\1", _inner.sub("", w.translate(SIGNS)))
    return undone, undone.isalpha()


class Lexicon:
    """Log odds of words and word beginnings; words() caches what a word is worth."""

    def __init__(self, odds: dict[str, float]) -> None:
        self.odds = odds
        self.seen: dict[str, tuple[float, float, bool, bool]] = {}

    def worth(self, raw: str) -> tuple[float, float, bool, bool]:
        """Of a raw word: its own and its beginning's log odds, whether it is second person, whether it is disguised."""
        got = self.seen.get(raw)
        if got is None:
            if len(self.seen) > CACHE_WORDS:
                self.seen.clear()
            w, disguised = plain(raw)
            own = max(self.odds.get(w, 0.0), 4.0 if w in INSULTS else 0.0)
            start = max([self.odds.get(f"{w[:k]}*", 0.0) for k in PREFIXES if len(w) >= k], default=0.0)
            got = self.seen[raw] = (own, start, w in SECOND_PERSON, disguised)
        return got

    def features(self, text: str | None) -> np.ndarray:
        text = text or ""
        words = _word.findall(text)
        out = np.zeros(N_FEATURES)
        n = max(1, len(words))
        worth = [self.worth(w) for w in words]
        own = np.array([x[0] for x in worth])
        start = np.array([x[1] for x in worth])
        you = np.array([x[2] for x in worth], dtype=bool)
        disguised = np.array([x[3] for x in worth], dtype=bool)
        letters = sum(map(str.isalpha, text)) or 1
        if len(words):
            hit = np.maximum(own, start) >= 2.0
            out[0] = own.max()
            out[1] = start.max()
            out[2] = (own >= 2.0).sum()
            out[3] = (start >= 2.0).sum()
            out[4] = 100 * (own >= 2.0).sum() / n
            out[5] = 100 * (start >= 2.0).sum() / n
            out[6] = np.sort(np.maximum(own, start))[-3:].sum()
            if hit.any() and you.any():
                gap = np.abs(np.flatnonzero(hit)[:, None] - _nearest(np.flatnonzero(you), np.flatnonzero(hit)))
                out[7] = (1.0 / (1.0 + gap)).max()
            out[8] = 100 * you.sum() / n
            out[9] = 100 * disguised.sum() / n
            out[10] = (disguised & hit).sum()
        out[11] = sum(map(str.isupper, text)) / letters
        out[12] = (text.count("!") + text.count("?")) / n
        joined = [re.sub(r"[^\w]", "", m) for m in _spaced.findall(text)]
        out[13] = max([self.worth(j)[0] for j in joined], default=0.0)
        return out


def _nearest(spots: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = np.searchsorted(spots, of)
    left, right = spots[np.maximum(at - 1, 0)], spots[np.minimum(at, len(spots) - 1)]
    return np.where(np.abs(of - left) <= np.abs(of - right), left, right)[:, None]


def terms(text: str | None) -> set[str]:
    """What the lexicon counts of a document."""
    found = set()
    for raw in set(_word.findall(text or "")):
        w, _ = plain(raw)
        if len(w) > 1:
            found.add(w)
            found.update(f"{w[:k]}*" for k in PREFIXES if len(w) >= k)
    return found


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32) -> dict:
    """Gradient-boosted trees for the logistic loss with histogram splits and Newton leaves."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    f, model = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node, tree = np.zeros(len(y), np.int64), []
        for level in range(depth):
            splits = []
            for k in range(1 << level):
                rows = np.flatnonzero(node == k)
                best = (1e-9, 0, np.inf)
                if len(rows) >= 10:
                    whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        gs = np.bincount(binned[rows, j], g[rows], len(c) + 1).cumsum()
                        hs = np.bincount(binned[rows, j], h[rows], len(c) + 1).cumsum()
                        gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - whole
                        at = int(gain.argmax())
                        if gain[at] > best[0] + 1e-12:
                            best = (float(gain[at]), j, float(c[at]))
                splits.append(best[1:])
            j = np.array([s[0] for s in splits])[node]
            cut = np.array([s[1] for s in splits])[node]
            node = 2 * node + (x[np.arange(len(y)), j] > cut)
            tree.append(splits)
        gs, hs = np.bincount(node, g, 1 << depth), np.bincount(node, h, 1 << depth)
        leaves = rate * gs / (hs + 1)
        f += leaves[node]
        model.append((tree, leaves))
    return {"base": base, "trees": model}


def raw_score(model: dict, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for tree, leaves in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for splits in tree:
            table_ = np.array(splits)[node]
            node = 2 * node + (x[rows, table_[:, 0].astype(np.int64)] > table_[:, 1])
        f += leaves[node]
    return f


def isotonic(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing knots (raw score, probability), with half a case of doubt at each step."""
    order = np.argsort(f, kind="stable")
    blocks: list[list[float]] = []  # sum of f, positives, rows
    for v, t in zip(f[order], y[order], strict=True):
        blocks.append([v, t, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.maximum.accumulate([(b[1] + 0.25) / (b[2] + 0.5) for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, keep: Column, sample_rows: int = SAMPLE_ROWS, lexicon: int = LEXICON) -> dict:
    """A model from docs (doc_id, text) and labels (doc_id, toxic) among labels for which keep holds."""
    chosen = labels.where(keep & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_y"))
    chosen = chosen.groupBy("_id").agg(F.max("_y").alias("_y")).withColumn("_o", F.xxhash64(F.lit(SEED), "_id")).orderBy("_o", "_id").limit(sample_rows)
    picked = chosen.select("_id", "_y", F.pmod("_o", F.lit(10)).alias("_part")).persist()
    try:
        # One row of an id is learned from: the one whose text has the least hash. Only hashes are read to find it.
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
        one = rows.select("doc_id", "_h").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).groupBy("_id", "_y", "_part")
        one = one.agg(F.min("_h").alias("_least"), F.count("*").alias("_rows")).persist()
        repeated = not one.where("_rows > 1").isEmpty()
        sample = rows.join(F.broadcast(one), (F.col("doc_id") == F.col("_id")) & (F.col("_h") == F.col("_least"))).drop("_h", "_least", "_rows")
        sample = sample.dropDuplicates(["_id"]) if repeated else sample
        counts = picked.groupBy("_part", "_y").count().collect()
        class_rows = {y: sum(r["count"] for r in counts if r["_y"] == y and r["_part"] < 4) for y in (0, 1)}
        total = {y: sum(r["count"] for r in counts if r["_y"] == y) for y in (0, 1)}
        if not total[0] or not total[1]:
            return {"constant": float(total[1] > 0)}

        def count_terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # n0, n1: documents of each class in the lexicon's part; a0, a1: in the whole sample.
            held: dict[str, list[int]] = {}
            for f in frames:
                for text, y, part in zip(f["text"], f["_y"], f["_part"], strict=True):
                    for t in terms(text):
                        row = held.setdefault(t, [0, 0, 0, 0])
                        row[2 + int(y)] += 1
                        row[int(y)] += part < 4
                    if len(held) > COUNTED_TERMS:
                        yield pd.DataFrame([(t, *n) for t, n in held.items()], columns=["term", "n0", "n1", "a0", "a1"])
                        held = {}
            yield pd.DataFrame([(t, *n) for t, n in held.items()], columns=["term", "n0", "n1", "a0", "a1"])

        counted = sample.select("text", "_y", "_part").mapInPandas(count_terms, "term string, n0 long, n1 long, a0 long, a1 long")
        counted = counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "a0", "a1")]).where("a1 >= 2").persist()

        def best(zero: str, one: str, rows: dict[int, int]) -> dict[str, float]:
            odds = F.ln((F.col(one) + 0.25) / (rows[1] + 0.5)) - F.ln((F.col(zero) + 0.25) / (rows[0] + 0.5))
            n, p = F.col(zero) + F.col(one), rows[1] / (rows[0] + rows[1])
            share = lambda k, q: F.col(k) * F.ln((F.col(k) + 1e-9) / (n * q))
            surprise = share(one, p) + share(zero, 1 - p)
            top = counted.where(F.col(one) >= 2).withColumns({"odds": odds, "g": surprise}).where((F.col("odds") >= 1) & (F.col("g") >= SURPRISE)).orderBy(F.desc("g"), "term").limit(lexicon)
            return {r["term"]: float(r["odds"]) for r in top.collect()}

        found, final = best("n0", "n1", class_rows), best("a0", "a1", total)
        counted.unpersist()

        def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lex = Lexicon(found)
            for f in frames:
                yield pd.DataFrame({"x": [lex.features(t).tolist() for t in f["text"]], "y": f["_y"], "part": f["_part"], "id": f["doc_id"]})

        rows = sample.where("_part >= 4").select("text", "_y", "_part", "doc_id").mapInPandas(measure, "x array<double>, y int, part long, id long").toPandas().sort_values("id")
        one.unpersist()
    finally:
        picked.unpersist()
    if not len(rows) or rows["y"].nunique() < 2:
        return {"constant": total[1] / (total[0] + total[1])}
    x, y, part = np.stack(rows["x"]), rows["y"].to_numpy(float), rows["part"].to_numpy()
    grown = part < 8 if len(np.unique(y[part < 8])) == 2 else part >= 0
    held = part >= 8 if len(np.unique(y[part >= 8])) == 2 else part >= 0
    model = grow(x[grown], y[grown])
    return {"lexicon": final, "model": model, "knots": isotonic(raw_score(model, x[held]), y[held])}


def calibrated(model: dict, f: np.ndarray) -> np.ndarray:
    """Between knots linear; a little of the raw score ranks what the knots tie, and moves nothing over the half."""
    kx, ky = model["knots"]
    p = np.interp(f, kx, ky)
    q = np.clip(p + 1e-4 * np.tanh(f / 4), 0.0, 1.0)
    return np.where(p >= 0.5, np.maximum(q, 0.5), np.minimum(q, np.nextafter(0.5, 0.0)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with toxicity added, from the text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: at most LEXICON entries and the trees

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        lex = None if "constant" in m else Lexicon(m["lexicon"])
        for f in (g.iloc[at : at + 1_000] for g in frames for at in range(0, len(g), 1_000)):
            if lex is None:
                yield f.assign(toxicity=np.full(len(f), m.get("constant", 0.0)))
                continue
            x = np.stack([lex.features(t if isinstance(t, str) else "") for t in f["text"]])
            yield f.assign(toxicity=calibrated(m, raw_score(m["model"], x)))

    return docs.drop("toxicity").mapInPandas(run, T.StructType([*(f for f in docs.schema.fields if f.name != "toxicity"), T.StructField("toxicity", T.DoubleType())]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents from a model of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_bucket("doc_id", 5) != 0)
    out = score(docs, model).withColumn("held_out", crc_bucket("doc_id", 5) == 0)
    return out.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
