"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own codebook (k-means on at most sample_rows vectors), so a vector
lies in the cell of a pair of centroids. A query walks the cells in order of the summed inner products with the two
centroids, by a heap over the two sorted lists, until the cells seen hold a given share of all entries. That share is
measured, not guessed: on a bounded sample it is what finds 97 % of the true neighbours, so clustered data need little and
structureless data much. All entries of the cells seen are then scored exactly on the original vectors.

Entries lie in SPLITS stretches of cells (cells of like first centroid together, hot ones dealt over several), however many
there are, and queries go to the stretches that hold a cell they see, in parts of bounded size. A task holds one part of the
queries with the best k of each so far, and lets a stretch's entries pass by, so it gives k rows a query at most and a query has
SPLITS * k candidates at most: what is gathered grows with the queries only. A stretch is read once for each part; those nobody
aims at are not moved. Products by blocks find what may be among the best, and only that is scored exactly. Codebooks grow with
the root of the table, up to MAX_CENTROIDS.

Cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor
do rows without id; rows with the query's id are its own; ties go to the smaller id; repeated rows are separate candidates
but ask once, and rows of one id with different vectors are each answered;
fewer than k candidates are all returned; no valid vectors give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 256
TARGET_RECALL = 0.97
#: Stretches of entries; a query has k candidates from each at most.
SPLITS = 16
#: Numbers that a task holds for its queries (vectors and best so far), and rows of queries and entries that are multiplied at once.
PART_VALUES = 1 << 23
TILE, CHUNK = 256, 4_096
MAX_CENTROIDS = 512
SEED = 5


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    return v


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centroids, begun at distinct vectors far from each other."""
    rng = np.random.default_rng(SEED)
    centres = x[[int(rng.integers(len(x)))]]
    nearest = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and nearest.max() > 0:
        pick = int(rng.choice(len(x), p=nearest / nearest.sum()))
        centres = np.vstack([centres, x[pick]])
        nearest = np.minimum(nearest, ((x - x[pick]) ** 2).sum(axis=1))
    for _ in range(rounds):
        at = assign(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def walk(s1: np.ndarray, s2: np.ndarray, held: np.ndarray, enough: float) -> float:
    """The summed score of the last cell that a walk sees: cells by falling s1 + s2 until they hold enough entries."""
    o1, o2 = np.argsort(-s1, kind="stable"), np.argsort(-s2, kind="stable")
    t1, t2, n = s1[o1].tolist(), s2[o2].tolist(), held[o1][:, o2].tolist()
    heap = [(-(t1[0] + t2[0]), 0, 0)]
    seen, last = 0, -np.inf
    while heap:
        score, i, j = heapq.heappop(heap)
        last = -score
        seen += n[i][j]
        if seen >= enough:
            return last
        if j + 1 < len(t2):
            heapq.heappush(heap, (-(t1[i] + t2[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(t1):
            heapq.heappush(heap, (-(t1[i + 1] + t2[0]), i + 1, 0))
    return -np.inf


class Best:
    """The k best entries so far of a part's queries; entries pass by in any order, and ties go to the smaller id."""

    def __init__(self, f: pd.DataFrame, k: int) -> None:
        self.k, self.own, self.ask, self.least = k, f["vec_id"].to_numpy(), f["ask"].to_numpy(), f["least"].to_numpy()
        self.q = np.stack(f["v"])
        self.norm = np.sqrt((self.q**2).sum(axis=1))
        self.score, self.id = np.full((len(f), k), -np.inf), np.full((len(f), k), np.iinfo(np.int64).max)

    def see(self, x: np.ndarray, ids: np.ndarray, e1: np.ndarray, e2: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> None:
        half = c1.shape[1]
        error = 4 * x.shape[1] * np.finfo(float).eps * np.sqrt((x**2).sum(axis=1).max())
        here = np.unique(e1)
        for at in range(0, len(self.q), TILE):
            rows = np.arange(at, min(at + TILE, len(self.q)))
            s1, s2 = self.q[rows, :half] @ c1.T, self.q[rows, half:] @ c2.T
            live = s1[:, here].max(axis=1) + s2.max(axis=1) >= self.least[rows]
            if not live.any():
                continue
            rows, s1, s2 = rows[live], s1[live], s2[live]
            s = self.q[rows] @ x.T
            s[(s1[:, e1] + s2[:, e2] < self.least[rows, None]) | (self.own[rows, None] == ids)] = -np.inf
            slack = error * self.norm[rows]
            bar = self.score[rows, -1] - slack
            if len(ids) > self.k:
                bar = np.maximum(bar, np.partition(s, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - 2 * slack)
            i, j = np.nonzero((s >= bar[:, None]) & (s > -np.inf))
            if len(i):
                # Summed row by row in one order, so equal vectors tie exactly.
                exact = np.concatenate([(self.q[rows[i[n : n + CHUNK]]] * x[j[n : n + CHUNK]]).sum(axis=1) for n in range(0, len(i), CHUNK)])
                self._merge(rows, i, exact, ids[j])

    def _merge(self, rows: np.ndarray, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        i = np.concatenate([np.repeat(np.arange(len(rows)), self.k), i])
        score, ids = np.concatenate([self.score[rows].ravel(), score]), np.concatenate([self.id[rows].ravel(), ids])
        order = np.lexsort((ids, -score, i))
        i, score, ids = i[order], score[order], ids[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        best = place < self.k
        self.score[rows[i[best]], place[best]], self.id[rows[i[best]], place[best]] = score[best], ids[best]

    def found(self) -> pd.DataFrame:
        i, j = np.nonzero(self.score > -np.inf)
        return pd.DataFrame({"query_id": self.own[i], "ask": self.ask[i], "vec_id": self.id[i, j], "score": self.score[i, j]})


def fit(sample: np.ndarray, rows: int, k: int) -> dict:
    """Codebooks, and the share of entries to see, from a sample of the vectors."""
    half = (sample.shape[1] + 1) // 2
    size = int(min(MAX_CENTROIDS, max(2, np.sqrt(rows) / 2)))
    c1, c2 = codebook(sample[:, :half], size), codebook(sample[:, half:], size) if sample.shape[1] > half else np.zeros((1, 0))
    a1, a2 = assign(sample[:, :half], c1), assign(sample[:, half:], c2)
    queries = np.random.default_rng(SEED).permutation(len(sample))[:SAMPLE_QUERIES]
    ranks = []
    for q in queries:
        s = sample @ sample[q]
        s[q] = -np.inf
        top = np.argsort(-s, kind="stable")[: min(k, len(sample) - 1)]
        cell = (c1 @ sample[q, :half])[a1] + (c2 @ sample[q, half:])[a2]
        ranks += [float((cell >= cell[t]).mean()) for t in top]
    share = float(np.quantile(ranks, TARGET_RECALL)) if ranks else 1.0
    return {"c1": c1, "c2": c2, "half": half, "share": min(1.0, share)}


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by inner product of every row for which is_query holds."""
    best = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    ranked = candidates(vectors, is_query, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def candidates(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, ask (a number of the query's vector), vec_id, score: the k best in each stretch of entries that a query sees."""
    base = valid(vectors)
    lengths = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, ask long, vec_id long, score double"
    if lengths is None:
        return base.sparkSession.createDataFrame([], schema)
    base = base.where(F.size("v") == lengths["n"])
    order = F.xxhash64(F.lit(SEED), "vec_id")
    sample = np.array([r["v"] for r in base.orderBy(order, "vec_id").limit(SAMPLE_ROWS).select("v").collect()])
    model = fit(sample, lengths["count"], k)
    c1, c2, half = model["c1"], model["c2"], model["half"]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.stack(f["v"]) if len(f) else np.empty((0, c1.shape[1] + c2.shape[1]))
            yield f.assign(c1=assign(x[:, :half], c1).astype(np.int32), c2=assign(x[:, half:], c2).astype(np.int32))

    entries = materialize(base.mapInPandas(place, "vec_id long, v array<double>, c1 int, c2 int"), "ann-entries")
    held = np.zeros((len(c1), len(c2)), np.int64)  # one number for each pair of centroids
    for r in entries.groupBy("c1", "c2").count().collect():
        held[r["c1"], r["c2"]] = r["count"]
    enough = model["share"] * held.sum()
    # Stretches: as the entries lie by first centroid, cut into SPLITS of like size; a centroid on a cut is dealt by a hash of the row.
    last = held.sum(axis=1).cumsum()
    start = np.minimum((last - held.sum(axis=1)) * SPLITS // last[-1], SPLITS - 1)
    where = np.stack([start, np.maximum((last - 1) * SPLITS // last[-1], start) - start + 1], axis=1)

    def aim(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query with its least score, once for every stretch that has a cell it sees."""
        for f in frames:
            out = []
            for q, a, v in zip(f["vec_id"], f["ask"], f["v"], strict=True):
                v = np.asarray(v)
                s1, s2 = c1 @ v[:half], c2 @ v[half:]
                least = walk(s1, s2, held, enough) - 1e-9
                best2 = np.where(held > 0, s2, -np.inf).max(axis=1)
                splits = {b for i in np.flatnonzero(s1 + best2 >= least) for b in range(where[i, 0], where[i, 0] + where[i, 1])}
                out += [(q, a, v, least, b) for b in sorted(splits)]
            if out:
                yield pd.DataFrame(out, columns=["vec_id", "ask", "v", "least", "split"])

    # Repeated rows of a query ask once; rows of one id with different vectors are numbered and ranked one by one.
    asked = entries.where(is_query).select("vec_id", "v").distinct()
    queries = asked.select("vec_id", "v", F.xxhash64("vec_id", "v").alias("ask")).repartition(entries.sparkSession.sparkContext.defaultParallelism * 2, "vec_id")
    aimed = materialize(queries.mapInPandas(aim, "vec_id long, ask long, v array<double>, least double, split int"), "ann-aimed")
    size = max(1, PART_VALUES // (lengths["n"] + 2 * k))
    parts = [0] * SPLITS
    for r in aimed.groupBy("split").count().collect():
        parts[r["split"]] = -(-r["count"] // size)
    if not any(parts):
        return base.sparkSession.createDataFrame([], schema)
    pick = lambda values, n: F.element_at(F.array(*[F.lit(int(x)) for x in values]), n + 1)
    order = ["split", "part", "c1", "vec_id"]  # queries, which have no cell, come before the entries
    asks = aimed.withColumn("part", F.pmod(F.xxhash64("vec_id", "ask"), pick(parts, F.col("split"))).cast("int"))
    asks = asks.select("split", "part", F.lit(-1).alias("c1"), F.lit(-1).alias("c2"), "vec_id", "v", "ask", "least")
    placed = entries.withColumn("split", pick(where[:, 0], F.col("c1")) + F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), pick(where[:, 1], F.col("c1"))).cast("int"))
    placed = placed.withColumn("_n", pick(parts, F.col("split"))).where("_n > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    placed = placed.select("split", "part", "c1", "c2", "vec_id", "v", F.lit(0).cast("long").alias("ask"), F.lit(0.0).alias("least"))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, asked, best = None, [], None
        for f in frames:
            at = f[["split", "part"]].to_numpy()
            kind = f["c1"].to_numpy() < 0
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1) | (kind[1:] != kind[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, len(f)], strict=True):
                if s == e:
                    continue
                g = f.iloc[s:e]
                if tuple(at[s]) != key:
                    if best is not None:
                        yield best.found()
                    key, asked, best = tuple(at[s]), [], None
                if kind[s]:
                    asked.append(g)
                    continue
                if best is None and asked:
                    best, asked = Best(pd.concat(asked), k), []
                for n in range(0, len(g) if best is not None else 0, CHUNK):
                    h = g.iloc[n : n + CHUNK]
                    best.see(np.stack(h["v"]), h["vec_id"].to_numpy(), h["c1"].to_numpy(), h["c2"].to_numpy(), c1, c2)
        if best is not None:
            yield best.found()

    dealt = asks.union(placed).repartition(4 * sum(parts), "split", "part").sortWithinPartitions(*order)
    return dealt.mapInPandas(score, schema)


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
