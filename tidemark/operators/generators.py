"""Row generators as Python table functions over partitioned tables: each partition is one series, in order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

_FOLD = T.StructType([T.StructField("asset", T.StringType()), T.StructField("d", T.DateType()), T.StructField("fold", T.IntegerType()), T.StructField("role", T.StringType())])
_REPLICATE = T.StructType([T.StructField("asset", T.StringType()), T.StructField("replicate", T.IntegerType()), T.StructField("mean", T.DoubleType())])


@udtf(returnType=_FOLD)
class PurgedFolds:
    """Each row (asset, d) once for every fold it tests or trains in; rows within the horizon of a test block do not train."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.folds, self.horizon = 1, 0

    def eval(self, row: Row, folds: int, horizon: int) -> None:
        self.rows.append((row["asset"], row["d"]))
        self.folds, self.horizon = folds, horizon

    def terminate(self) -> Iterator[tuple]:
        n = len(self.rows)
        for fold in range(self.folds):
            low, high = fold * n // self.folds, (fold + 1) * n // self.folds
            for i, (asset, d) in enumerate(self.rows):
                if low <= i < high:
                    yield asset, d, fold, "test"
                elif i < low - self.horizon or i >= high + self.horizon:
                    yield asset, d, fold, "train"


@udtf(returnType=_REPLICATE)
class BlockReplicates:
    """Means of so many resamples of a series (asset, x), each put together from blocks of consecutive rows."""

    def __init__(self) -> None:
        self.x: list[float] = []
        self.asset, self.count, self.block = None, 0, 1

    def eval(self, row: Row, count: int, block: int) -> None:
        self.asset, self.count, self.block = row["asset"], count, block
        if row["x"] is not None:
            self.x.append(row["x"])

    def terminate(self) -> Iterator[tuple]:
        x = np.array(self.x)
        if not len(x):
            return
        rng, block = np.random.default_rng(zlib.crc32(str(self.asset).encode())), min(self.block, len(x))
        # The sum of a block from the running sum; the last block of a resample is cut to its length.
        total, pieces = np.concatenate([[0.0], np.cumsum(x)]), -(-len(x) // block)
        last = len(x) - (pieces - 1) * block
        for r in range(self.count):
            at = rng.integers(0, len(x) - block + 1, pieces)
            sums = total[at + block] - total[at]
            sums[-1] = total[at[-1] + last] - total[at[-1]]
            yield self.asset, r, float(sums.sum() / len(x))


def _over(df: DataFrame, name: str, f, *scalars: int) -> DataFrame:
    """f over df partitioned by asset and ordered by d: a table function with a table argument, in SQL's words."""
    df.sparkSession.udtf.register(name, f)
    numbers = ", ".join(map(str, scalars))
    return df.sparkSession.sql(f"SELECT * FROM {name}(TABLE(SELECT * FROM {{rows}}) PARTITION BY asset ORDER BY (d), {numbers})", rows=df)


def purged_folds(df: DataFrame, folds: int, horizon: int) -> DataFrame:
    """fold and role of each row (asset, d) of df."""
    return _over(df.select("asset", "d"), "tidemark_purged_folds", PurgedFolds, folds, horizon)


def block_replicates(df: DataFrame, count: int, block: int) -> DataFrame:
    """asset, replicate and mean of the resamples of x in df (asset, d, x)."""
    return _over(df.select("asset", "d", "x"), "tidemark_block_replicates", BlockReplicates, count, block)
