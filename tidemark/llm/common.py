"""What the operators of this subpackage share: shared scratch tables, table loading and word fingerprints."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the ASCII controls TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_ours: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where that is unset (as in tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _ours.setdefault(app, f"file:///tmp/tidemark-scratch-{os.getpid()}-{uuid.uuid4().hex[:8]}")
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet to the shared folder and read it back: this cuts the lineage, and lost executors do not lose it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    if (own := _scope.get()) is not None:
        own.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


_written: dict[str, SparkSession] = {}


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended: its scratch folder is then the cluster's to clear
            return


def release(*frames: DataFrame) -> None:
    """Delete the scratch tables of frames from materialize() that nothing will read any more."""
    for df in frames:
        if path := getattr(df, "_scratch_path", None):
            _delete(path)


class Scope:
    """The scratch tables that were written inside a scratch() block, and those of them that outlive it."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.kept: set[str] = set()

    def keep(self, *frames: DataFrame) -> None:
        self.kept |= {df._scratch_path for df in frames}


_scope: ContextVar[Scope | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[Scope]:
    """Delete at the end what materialize() wrote inside the block, in this thread, but for what was kept; frames that read the
    deleted tables are no longer usable."""
    outer, own = _scope.get(), Scope()
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)
        for path in own.paths:
            if path not in own.kept:
                _delete(path)
            elif outer is not None:
                outer.paths.append(path)


def _drop_all() -> None:
    for path in list(_written):
        _delete(path)


atexit.register(_drop_all)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = [np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> np.ndarray:
    """_BASE to the powers 0..n-1 modulo 2**64; the table grows by doubling."""
    table_ = _POWERS[0]
    while len(table_) < n:
        step = np.uint64(pow(_BASE, len(table_), 1 << 64))
        table_ = np.concatenate([table_, table_ * step])
    _POWERS[0] = table_
    return table_[:n]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit fingerprint of each white-space separated word of UTF-8 bytes, in order; vectorised over the bytes."""
    return _word_hashes(data)[0]


def word_hashes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of the words of many texts, one after the other, and how many each has."""
    h, starts = _word_hashes(b"\n".join(texts))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return h, np.diff(np.searchsorted(starts, ends), prepend=0)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of words, and the bytes where they begin."""
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = ~_IS_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    spots = np.flatnonzero(inside)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    offset = np.arange(len(spots)) - np.repeat(first, lengths)
    coded = mix64(b[spots].astype(np.uint64) * _MIX + np.uint64(1)) * _powers(int(lengths.max()))[offset]
    return mix64(np.add.reduceat(coded, first) + lengths.astype(np.uint64) * _MIX), starts


def lower_ascii(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed (bytes.lower is ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower()


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A fingerprint of every run of k consecutive word fingerprints."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(3) + words[i : i + n] + np.uint64(i * int(_MIX) % (1 << 64)))
    return out


def crc_bucket(column: str, modulus: int):
    """crc32 of a number's decimal text, modulo modulus."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)
