"""N-gram Jaccard join with a count-vector R-tree.

1. Each text becomes the set of its word shingles (64-bit fingerprints). Texts with equal sets are one node from here on.
2. Nodes meet by prefixes: of two linked sets, each holds most of the other, so their first shingles in one order of all
   shingles, as many as can be missing and one more, share one. Common shingles come last in that order. This loses no link.
   Large sets bring some keys more, and are to share as many more: long texts that have a phrase in common do not meet by it.
   Most keys are met by nobody, so keys travel packed (seven bytes: a part of the key, and whose it is), and a key that many
   documents share is one row for each worker's flush of some 100,000 keys.
3. Shingles are hashed into groups, and the group counts are points; the overlap of two points is at most the sum of the
   coordinate minima. Where few nodes share a key, pairs are kept only if that bound reaches the needed overlap; where many do,
   they are tied together. What hangs together so is a coarse component (all links lie inside one), and is searched: its
   points are packed into an R-tree, whose boxes have the same bound, and only surviving pairs are verified on the sets. A pair
   already connected by found links is not looked at again. Components too large for one task are first taken apart: linked
   sets differ in few shingles, so of one group of shingles more than that one is equal in both, and only sets that share
   such a group hang together. What is still too large is split by size class, and where that is not enough into chunks, each
   pair of which is searched; their links are joined by distributed components.

Cases: null and empty texts have the empty set and are linked with nothing; texts with fewer words than a shingle count as
one shingle; repeated rows and ids are linked like any equal texts (one row each is returned), and different texts under one
id, or without id, are texts of their own; null ids keep their row and never name a component unless all are null; very long
texts are read whole; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import lower_ascii, materialize, mix64, release, table, window_hashes, word_hashes
from .components import components

#: Coordinates of the count vectors that travel with the keys; the tree has more for larger sets.
GROUPS = 32
LEAF = 32
#: Shingles of a group that one task takes; larger ones are split.
TASK_SHINGLES = 4_000_000
#: Texts that share a key and are paired each with each at most; more are only tied together, and searched.
SMALL = 8
#: Of so many shingles of a set one more is a key than need be, and one more key is to be shared.
MORE = 50
#: Common shingles that are put last among keys at most (16 bytes each in every worker).
COMMON = 2_000_000
#: Keys that a worker gathers before it sends them off, and the flag of a place whose group is larger than SMALL.
FLUSH_KEYS = 400_000
FLAG = 1 << 15
#: Bytes of a packed key: five of the key, two of the place in the flush.
PACKED = 7
_ODD = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted set of k-word shingle fingerprints; the whole sequence if it is shorter; empty without words."""
    words = word_hashes(lower_ascii(text)) if text else np.empty(0, np.uint64)
    return np.unique(window_hashes(words, min(k, len(words)))) if len(words) else words


def keys(shingles: np.ndarray, percent: int, common: tuple[np.ndarray, np.ndarray], bits: int) -> np.ndarray:
    """The keys of a set for links with 100 * intersection >= percent * union: its first shingles in one order of all shingles.

    Linked sets share percent of each at least, so among the first n - percent * n / 100 + m of each there are m shared ones,
    whatever the order is, if it is the same for all; m is shared_keys. Here those counted and found rare come first, those not
    counted next, and the common ones last, the most common at the end: stock phrases bring nobody together who has enough of
    their own.
    """
    n = len(shingles)
    need = n + shared_keys(n, percent) - -(-percent * n // 100)
    mixed = mix64(shingles ^ _ODD)
    if need >= n:
        return mixed
    counted = _counted(mixed, percent)
    if not len(common[0]):
        often, at = np.zeros(n, dtype=bool), np.zeros(n, np.int64)
    else:
        short = mixed >> np.uint64(24 - bits)
        at = np.minimum(np.searchsorted(common[0], short), len(common[0]) - 1)
        often = counted & (common[0][at] == short)
    out = []
    for part in (mixed[counted & ~often], mixed[~counted]):
        if len(part) > need:
            part = np.partition(part, need - 1)[:need]
        out.append(part)
        need -= len(part)
    if need:
        out.append(mixed[often][np.lexsort((mixed[often], common[1][at[often]]))][:need])
    return np.concatenate(out)


def shared_keys(n: int, percent: int) -> int:
    """How many keys a set of n shingles shares with each set linked to it, that has as many to share or more: large sets that
    meet by chance share few."""
    return min(1 + n // MORE, -(-percent * n // 100))


def _counted(mixed: np.ndarray, percent: int) -> np.ndarray:
    """Which shingles are counted: half as many again as a set has keys, in every set; only the order of keys hangs on it."""
    return (mixed & np.uint64(0xFFFF)) < np.uint64(min(65536, (100 - percent) * 983 + 655))


def _cut(key: np.ndarray, bits: int, extra: np.ndarray) -> list[tuple[int, bytes]]:
    """Sorted keys as (bucket, packed rows): the first bits of a key are its bucket, the next 40 are packed, then the extra bytes."""
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
    packed = np.concatenate([(key >> np.uint64(24 - bits)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5], extra], axis=1)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    return [(int(bucket[s]), packed[s:e].tobytes()) for s, e in zip(starts, [*starts[1:], len(key)], strict=True)]


def _open(bucket: np.ndarray, data: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packed rows: bucket and key in one number, the row each came from, and the extra bytes."""
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(-1, width)
    row = np.repeat(np.arange(len(data)), np.fromiter(map(len, data), np.int64, len(data)) // width)
    low = np.zeros((len(raw), 8), np.uint8)
    low[:, :5] = raw[:, :5]
    return bucket.astype(np.uint64)[row] << np.uint64(40) | low.view("<u8").ravel(), row, raw[:, 5:]


def _by_bucket(work):
    """A function over frames sorted by bucket that hands work whole buckets, many at once, across batch borders."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in (g.iloc[at : at + 1_000] for g in frames for at in range(0, len(g), 1_000)):
            bucket = f["bucket"].to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if cut:
                yield work(pd.concat([*held, f.iloc[:cut]]))
                held = []
            held.append(f.iloc[cut:])
        if held:
            yield work(pd.concat(held))

    return run


def common_shingles(docs: DataFrame, k: int, percent: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counted shingles that more than SMALL texts hold (shortened), in order, with their counts; the COMMON most common at most.
    Only the order of keys hangs on them, no result."""

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def flushed() -> pd.DataFrame:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame(_cut(key, bits, np.minimum(n, 255).astype(np.uint8)[:, None]), columns=["bucket", "keys"])

        for f in frames:
            for text in f["text"]:
                s = shingle_set(text, k)
                if len(s) and (own := _node(s)) not in seen:
                    seen.add(own)
                    mixed = mix64(s ^ _ODD)
                    held.append(mixed[_counted(mixed, percent)])
                    size += len(held[-1])
                if size > FLUSH_KEYS:
                    yield flushed()
                    held, size, seen = [], 0, set()
        if size:
            yield flushed()

    def count(f: pd.DataFrame) -> pd.DataFrame:
        key, _, n = _open(f["bucket"].to_numpy(np.int64), f["keys"].tolist(), 6)
        value, at = np.unique(key, return_inverse=True)
        total = np.bincount(at, n.ravel(), len(value)).astype(np.int64)
        return pd.DataFrame({"s": value[total > SMALL].view(np.int64), "n": total[total > SMALL]})

    packed = docs.select("text").mapInPandas(gather, "bucket int, keys binary")
    found = packed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_by_bucket(count), "s long, n long")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"s": [f["s"].to_numpy(np.int64).tobytes()], "n": [f["n"].to_numpy(np.int64).tobytes()]})

    # As packed bytes, 16 for each: as rows they would be large objects in the driver.
    got = found.orderBy(F.desc("n"), "s").limit(COMMON).mapInPandas(pack, "s binary, n binary").collect()
    value, n = (np.frombuffer(b"".join(r[c] for r in got), np.int64) for c in ("s", "n"))
    order = np.argsort(value)
    return value[order].view(np.uint64), n[order]


MARKS = "doc_id long, text_hash long, n_shingles long, node long, place long, vector binary, other long, bucket int, keys binary"


def marks(docs: DataFrame, k: int, percent: int, bits: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """From docs (doc_id, text, text_hash) in one scan: a row for each document (its set's size and fingerprint, and for the
    first of a node in the worker's flush its place there and count vector), ties (node, other) of large groups of nodes that
    share a key in one flush, and packed keys by bucket. A key comes with the places of all its nodes in the flush, or where
    they are more than SMALL with one of them and a flag."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # bounded by COMMON
    schema = T._parse_datatype_string(MARKS)
    arrow = to_arrow_schema(schema)

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: dict[int, int] = {}
        task = TaskContext.get()
        flush = (task.partitionId() if task else 0) << 24

        def flushed() -> Iterator[pa.RecordBatch]:
            key = np.concatenate(held)
            spot = np.repeat(np.arange(len(held), dtype=np.int64), [len(x) for x in held])
            order = np.argsort(key, kind="stable")
            key, spot = key[order], spot[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            centre, large = np.repeat(spot[starts], sizes), np.repeat(sizes > SMALL, sizes)
            ties = np.unique((centre << 16 | spot)[large & (centre != spot)])
            if len(ties):
                node = np.array(list(seen), np.int64)
                yield batch(len(ties), node=node[ties >> 16], other=node[ties & 0xFFFF])
            kept = ~large
            kept[starts] = True
            spot = np.where(large, spot | FLAG, spot)[kept]
            rows = _cut(key[kept], bits, spot.astype("<u2").view(np.uint8).reshape(-1, 2))
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                yield batch(len(part), bucket=[r[0] for r in part], place=[flush] * len(part), keys=[r[1] for r in part])

        size = 0
        for got in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            n, node, place, vector = [], [], [], []
            for text in got.column("text").to_pylist():
                s = shingle_set(text, k)
                own = _node(s)
                first = bool(len(s)) and own not in seen
                if first:
                    if size > FLUSH_KEYS or len(seen) >= FLAG:
                        yield from flushed()
                        held, seen, size, flush = [], {}, 0, flush + 1
                    seen[own] = len(seen)
                    held.append(keys(s, percent, shared.value, bits))
                    size += len(held[-1])
                n.append(len(s))
                node.append(own)
                place.append(flush << 16 | seen[own] if first else None)
                vector.append(count_vector(s).tobytes() if first else None)
            yield batch(len(n), doc_id=got.column("doc_id"), text_hash=got.column("text_hash"), n_shingles=n, node=node, place=place, vector=vector)
        if size:
            yield from flushed()

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, schema)


def meetings(packed: DataFrame) -> DataFrame:
    """Edges (a, b, loose, shared) between places that share a key, from packed keys (bucket, place, keys): each with each where
    they are few (SMALL at most), and else each with the first, which is loose: it says only that they may be linked with each
    other. shared is how many keys make the edge; linked places with no loose tie have all they share among these."""

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        key, row, extra = _open(f["bucket"].to_numpy(np.int64), f["keys"].tolist(), PACKED)
        spot = np.ascontiguousarray(extra).view("<u2").ravel().astype(np.int64)
        place = (f["place"].to_numpy(np.int64) << 16)[row] | spot & (FLAG - 1)
        order = np.argsort(key, kind="stable")
        key, place, flagged = key[order], place[order], spot[order] >= FLAG
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        large = np.repeat((sizes > SMALL) | np.logical_or.reduceat(flagged, starts), sizes)
        centre = np.repeat(place[starts], sizes)
        star = large & (centre != place)
        found = [pd.DataFrame({"a": centre[star], "b": place[star], "loose": True})]
        for d in range(1, SMALL):
            both = np.flatnonzero((key[d:] == key[:-d]) & ~large[d:])
            x, y = place[both], place[both + d]
            found.append(pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "loose": False})[x != y])
        return pd.concat(found).groupby(["a", "b", "loose"], as_index=False).size()

    met = packed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_by_bucket(meet), "a long, b long, loose boolean, size long")
    return met.groupBy("a", "b", "loose").agg(F.sum("size").alias("shared"))


def _plausible(percent: int):
    """Edges between nodes that are loose, or whose count vectors leave room for a link."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x, y = (np.frombuffer(b"".join(f[c]), np.int32).reshape(-1, GROUPS) for c in ("a_vector", "b_vector"))
                room = np.minimum(x, y).sum(axis=1, dtype=np.int64) * (100 + percent) >= percent * (x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64))
                yield f.loc[f["loose"].to_numpy(bool) | room, ["a_node", "b_node"]].rename(columns={"a_node": "a", "b_node": "b"}).drop_duplicates()

    return run


class Tree:
    """A packed R-tree over count vectors: leaves of LEAF points, nodes of LEAF leaves, each with coordinate maxima and least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.concatenate(self._pack(points, np.arange(len(points)))) if len(points) else np.empty(0, np.int64)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        top, least = self.points, self.sizes
        while len(top) > LEAF:
            starts = np.arange(0, len(top), LEAF)
            top, least = np.maximum.reduceat(top, starts, axis=0), np.minimum.reduceat(least, starts)
            self.levels.append((top, least))

    def _pack(self, points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """Rows in an order in which neighbours are close: halves along the widest coordinate, at multiples of LEAF."""
        if len(rows) <= LEAF:
            return [rows]
        axis = int(points[rows].astype(np.float32).var(axis=0).argmax())
        rows = rows[np.argsort(points[rows, axis], kind="stable")]
        half = (len(rows) // 2 + LEAF - 1) // LEAF * LEAF
        return [*self._pack(points, rows[:half]), *self._pack(points, rows[half:])]

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows whose overlap bound (summed coordinate minima) reaches what a link needs."""
        spots = None
        for top, least in [*reversed(self.levels), (self.points, self.sizes)]:
            if spots is not None:
                spots = (spots[:, None] * LEAF + np.arange(LEAF)).ravel()
                spots = spots[spots < len(top)]
                top, least = top[spots], least[spots]
            bound = np.minimum(top, point).sum(axis=1, dtype=np.int64)
            fits = bound * (100 + percent) >= percent * (least.astype(np.int64) + size)
            spots = np.flatnonzero(fits) if spots is None else spots[fits]
        return self.order[spots]


def count_vector(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """How many shingles fall into each group (a power of two)."""
    shift = np.uint64(65 - groups.bit_length())
    return np.bincount((mix64(shingles * _ODD) >> shift).astype(np.int64), minlength=groups).astype(np.int32)


def _fine(sizes: np.ndarray) -> int:
    """Groups for sets of these sizes: some four shingles each, so that the bound tells large sets apart, too, and 64 MB at most."""
    groups = GROUPS
    while groups < 4096 and 4 * groups < sizes.mean() and 2 * groups * len(sizes) <= 1 << 24:
        groups *= 2
    return groups


def links(sets: list[np.ndarray], percent: int, chunk: np.ndarray | None = None, above: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the link graph of these sets. chunk: only pairs of different chunks are looked for; above: no pair of
    two of these is."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    found = []
    groups = _fine(sizes)
    points = np.stack([count_vector(s, groups) for s in sets]) if n > 2 else None
    tree = Tree(points, sizes) if n > 2 else None
    for q in range(n):
        near = tree.near(points[q], int(sizes[q]), percent) if tree else np.arange(n)
        near = near[near > q]
        if chunk is not None:
            near = near[chunk[near] != chunk[q]]
        if above is not None and above[q]:
            near = near[~above[near]]
        if not len(near):
            continue
        own = find(q)
        near = near[[find(int(i)) != own for i in near]]
        if not len(near):
            continue
        joined = np.concatenate([sets[i] for i in near])
        at = np.minimum(np.searchsorted(sets[q], joined), sizes[q] - 1)
        both = np.add.reduceat((sets[q][at] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
        for i, common in zip(near.tolist(), both.tolist(), strict=True):
            if 100 * common >= percent * (int(sizes[q]) + int(sizes[i]) - common) and (a := find(q)) != (b := find(i)):
                root[max(a, b)] = min(a, b)
                found.append((q, i))
    return found


def _node(s: np.ndarray) -> int:
    """A fingerprint of a set."""
    if not len(s):
        return 0
    total = np.array([np.add.reduce(mix64(s * _ODD))], np.uint64) + mix64(np.array([len(s)], np.uint64))
    return int(mix64(total).view(np.int64)[0])


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(coarse, node, n, shingles as bytes) of the wanted (_id, _hash, node, coarse) rows; texts are read again for these only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for f in frames:
            rows = []
            for text, node, coarse in zip(f["text"], f["node"], f["coarse"], strict=True):
                if node == last:  # repeated rows lie side by side after the merge join
                    continue
                last = node
                s = shingle_set(text, k)
                if _node(s) == node:
                    rows.append((coarse, node, len(s), s.tobytes()))
            yield pd.DataFrame(rows, columns=["coarse", "node", "n", "bytes"])

    same = docs["doc_id"].eqNullSafe(wanted["_id"]) & (docs["text_hash"] == wanted["_hash"])
    joined = docs.join(wanted.hint("merge"), same).select("text", "node", "coarse")
    return joined.mapInPandas(run, "coarse long, node long, n long, bytes binary")


def _search(percent: int):
    """Links of one group of rows, as edges between nodes."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates("node").sort_values("node")
        sets = [np.frombuffer(b, np.uint64) for b in f["bytes"]]
        chunk = f["chunk"].to_numpy() if f["chunk"].nunique() > 1 else None
        nodes = f["node"].to_numpy()
        return pd.DataFrame([(nodes[a], nodes[b]) for a, b in links(sets, percent, chunk, f["above"].to_numpy(bool))], columns=["a", "b"]).astype(np.int64)

    return run


def _found(sets: DataFrame, wanted: DataFrame, percent: int, task_shingles: int) -> DataFrame:
    """Links inside the coarse components, as edges.

    A component that a task can hold is one group. Of larger ones, each size class is a group, with the class above it (linked
    sets are of one class or of neighbouring ones). A class that is still too large is cut into chunks, and each pair of chunks
    is a group.
    """
    same = {"chunk": F.lit(0), "above": F.lit(False)}
    weights = wanted.groupBy("coarse").agg(F.sum("n").alias("total"))
    sized = sets.join(weights, "coarse")
    small = sized.where(F.col("total") <= task_shingles).withColumns(same).groupBy("coarse").applyInPandas(_search(percent), "a long, b long")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(max(100 / percent, 1.001))) + 1e-9).cast("int")
    classes = F.explode(F.array(F.struct(band.alias("band"), F.lit(False).alias("above")), F.struct((band - 1).alias("band"), F.lit(True).alias("above"))))
    split = lambda df: df.join(weights, "coarse").where(F.col("total") > task_shingles).withColumn("_b", classes).select(*df.columns, "_b.band", "_b.above")
    heavy = split(wanted.select("coarse", "n")).groupBy("coarse", "band").agg(F.sum("n").alias("held"))
    banded = split(sets).join(heavy, ["coarse", "band"])
    middle = banded.where(F.col("held") <= task_shingles).withColumn("chunk", F.lit(0)).groupBy("coarse", "band").applyInPandas(_search(percent), "a long, b long")
    chunks = F.ceil(F.col("held") / F.lit(max(1, task_shingles // 2))).cast("int")
    large = banded.where(F.col("held") > task_shingles).withColumn("_c", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), "_c").cast("int"))
    large = large.select("coarse", "band", "above", "node", "bytes", "chunk", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)).alias("o"))
    large = large.withColumn("pair", F.struct(F.least("chunk", "o").alias("x"), F.greatest("chunk", "o").alias("y")))
    large = large.groupBy("coarse", "band", "pair").applyInPandas(_search(percent), "a long, b long")
    return small.union(middle).union(large)


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Fingerprints of which linked sets share one. Sets of one size class, or of it and the class above, differ in so many shingles
    at most; of some groups more than that, dealt by a hash, as many at least are equal in both. Empty groups, equal in sets of
    any content, are left out where they are fewer than these, as then one with shingles is equal in both."""
    n, step = len(shingles), max(100 / percent, 1.001)
    own = int(np.floor(np.log(n) / np.log(step) + 1e-9))
    mixed = mix64(shingles * _ODD)
    out = []
    for band in (own, own - 1):
        most = (100 - percent) / (100 + percent) * (step ** (band + 1) + step ** (band + 2)) * (1 + 1e-6)
        more = 1 + int(most) // 8
        groups = int(most) + more
        sums = np.zeros(groups, np.uint64)
        group = ((mixed >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
        np.add.at(sums, group, mix64(mixed))
        found = mix64(mix64(sums) + np.arange(groups, dtype=np.uint64) * _ODD + np.uint64((band + 1) * 0x9E3779B1))
        full = np.bincount(group, minlength=groups) > 0
        out.append(found[full] if np.count_nonzero(~full) < more else found)
    return np.concatenate(out)


def _parted(sets: DataFrame, percent: int, task_shingles: int) -> DataFrame:
    """sets with finer coarse components in place of those that are too large for a task: what shares a signature hangs together,
    and sets that share none have no links and are left out."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (g.iloc[at : at + 500] for g in frames for at in range(0, len(g), 500)):
            found = [signatures(np.frombuffer(b, np.uint64), percent) for b in f["bytes"]]
            yield pd.DataFrame({"sign": np.concatenate(found).view(np.int64), "node": np.repeat(f["node"].to_numpy(np.int64), [len(x) for x in found])})

    heavy = sets.groupBy("coarse").agg(F.sum("n").alias("_total")).where(F.col("_total") > task_shingles)
    heavy = materialize(heavy.select("coarse"), "ngram-heavy")
    if heavy.isEmpty():
        return sets
    signed = materialize(sets.join(heavy, "coarse", "left_semi").mapInPandas(sign, "sign long, node long"), "ngram-signatures")
    met = signed.groupBy("sign").agg(F.min("node").alias("b"), F.max("node").alias("_most")).where("b != _most").select("sign", "b")
    finer = components(signed.join(met.hint("merge"), "sign").select(F.col("node").alias("a"), "b").where("a != b"), "ngram-finer")
    release(signed)
    tied = sets.join(heavy, "coarse", "left_semi").drop("coarse").join(finer.select("node", F.col("root").alias("coarse")), "node")
    return materialize(sets.join(heavy, "coarse", "left_anti").unionByName(tied), "ngram-parted")


def similar(docs: DataFrame, k: int = 3, percent: int = 90, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (least doc_id reachable by links) and component (a number of the component,
    of every row with a word) for docs (doc_id, text). percent is the least similarity of a link, 1 to 100."""
    if not 1 <= percent <= 100 or k < 1:
        raise ValueError("similarity must be 1 to 100 percent, and shingles of a word or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_hash", F.xxhash64("text"))
    bits = max(6, min(18, (docs.count() >> 6).bit_length()))
    found = materialize(marks(docs, k, percent, bits, common_shingles(docs, k, percent, bits)), "ngram-marks")
    documents = found.where("n_shingles IS NOT NULL")
    slim = materialize(documents.select("doc_id", "text_hash", "n_shingles", "node"), "ngram-documents")
    # Joins whose small side grows with the corpus are merge joins at every size, so that plans and costs do not jump.
    places = documents.where("place IS NOT NULL")
    at = lambda side: places.select(F.col("place").alias(side), F.col("node").alias(f"{side}_node"), F.col("n_shingles").alias(f"{side}_n"), F.col("vector").alias(f"{side}_vector")).hint("merge")
    met = meetings(found.where("keys IS NOT NULL").select("bucket", "place", "keys"))
    alike = f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"
    enough = f"shared >= least(1 + least(a_n, b_n) div {MORE}, ({percent} * least(a_n, b_n) + 99) div 100)"  # as shared_keys
    met = met.join(at("a"), "a").join(at("b"), "b").where(f"loose OR {alike} AND {enough}")
    met = met.select("a_node", "b_node", "loose", "a_vector", "b_vector").mapInPandas(_plausible(percent), "a long, b long")
    ties = found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    coarse = components(met.union(ties), "ngram-coarse").select("node", F.col("root").alias("coarse"))
    release(found)
    # One row of each node has its set read; copies have none.
    some = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("_first")
    owners = slim.where("n_shingles > 0").groupBy("node").agg(some, F.first("n_shingles").alias("n"))
    owners = materialize(owners.select("node", F.col("_first.doc_id").alias("_id"), F.col("_first.text_hash").alias("_hash"), "n"), "ngram-nodes")
    wanted = materialize(owners.join(coarse, "node"), "ngram-wanted")
    sets = materialize(_sets(docs, wanted.select("_id", "_hash", "node", "coarse"), k), "ngram-sets")
    parted = _parted(sets, percent, task_shingles)
    sizes = wanted if parted is sets else parted.select("coarse", "n")
    fine = components(_found(parted, sizes, percent, task_shingles), "ngram-links")
    release(sets, parted, wanted)
    names = owners.join(fine, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = names.groupBy("root").agg(F.min("_id").alias("component_id"))
    named = materialize(names.join(least, "root").select("node", "component_id", F.col("root").alias("component")), "ngram-names")
    release(owners)
    out = slim.withColumn("node", F.when(F.col("n_shingles") > 0, F.col("node"))).join(named, "node", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "component")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by 3-word shingles at 0.9."""
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
