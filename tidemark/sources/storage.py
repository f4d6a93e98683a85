"""Readers and writers around Spark's formats, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Headerless trade files: eight columns, of which four are read.
TRADE_FILE = T.StructType([T.StructField(n, t) for n, t in (("agg_id", T.LongType()), ("price", T.DoubleType()), ("qty", T.DoubleType()), ("first_id", T.LongType()), ("last_id", T.LongType()), ("ts", T.LongType()), ("is_buyer_maker", T.BooleanType()), ("is_best", T.BooleanType()))])
#: Epochs above this are microseconds, else milliseconds.
MICROS_FROM = 100_000_000_000_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; under /tmp only where that is unset and Spark runs on one machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file:///tmp/tidemark-shared"
    path = f"{root}/tidemark-{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


_made: dict[str, SparkSession] = {}


def _clear() -> None:
    """At the end of the driver: what queries wrote to the shared folder goes."""
    for path, spark in _made.items():
        try:
            delete(spark, path)
        except Exception:  # the session may have ended: its folder is then the cluster's to clear
            return


atexit.register(_clear)


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """Trade CSV files: declared schema (no pass to infer one), pruned columns, epochs to timestamps."""
    t = spark.read.schema(TRADE_FILE).csv(path).select("price", "qty", "ts", "is_buyer_maker")
    ms = F.when(F.col("ts") > MICROS_FROM, F.floor(F.col("ts") / 1000)).otherwise(F.col("ts"))
    return t.withColumn("at", F.timestamp_millis(ms)).withColumn("d", F.to_date("at"))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Long series files (series_id, date, value as text): '.' stands for a missing value."""
    raw = spark.read.schema("series_id string, date date, value string").json(path)
    return raw.select("series_id", "date", F.expr("try_cast(nullif(value, '.') AS double)").alias("value"))


def read_date_map(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects of date -> value, one object a line, to rows."""
    raw = spark.read.text(path)
    return raw.select(F.explode(F.from_json("value", "map<string,double>")).alias("date", "value")).withColumn("date", F.to_date("date"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def latest(df: DataFrame, key: list[str], order: list[str], keep: int = 1) -> DataFrame:
    """The newest rows of each key: an upsert as a query. The limit applies before the shuffle too."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of whatever file system Spark reads."""
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def _markers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Version and data folder of every published version, oldest first: only names and one line each are read."""
    p, fs = _hadoop(spark, f"{path}/_versions")
    if not fs.exists(p):
        return []
    found = []
    for f in fs.listStatus(p):
        stream = fs.open(f.getPath())
        found.append((int(f.getPath().getName()), spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        stream.close()
    return sorted(found)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions of a table, oldest first."""
    return [v for v, _ in _markers(spark, path)]


def publish(df: DataFrame, path: str, version: int) -> None:
    """Write a version of a table beside the earlier ones. It shows only when the whole write is committed (a marker names its
    folder), and a lost job leaves the earlier versions as they are. Of two writers of one version the second fails."""
    spark, folder = df.sparkSession, f"data-{version}-{uuid.uuid4().hex}"
    if version in versions(spark, path):
        raise ValueError(f"version {version} of {path} is published already")
    df.write.parquet(f"{path}/{folder}")
    p, fs = _hadoop(spark, f"{path}/_versions/{version}")
    try:
        out = fs.create(p, False)
    except Exception as e:
        delete(spark, f"{path}/{folder}")
        raise ValueError(f"version {version} of {path} was published by another writer") from e
    out.writeBytes(folder)
    out.close()


def published(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a published table; others are not read."""
    known = _markers(spark, path)
    if not known:
        raise ValueError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/{known[-1][1]}")


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all but the newest versions. Two at least should stay, so that readers of the last but one can end."""
    for version, folder in _markers(spark, path)[: -max(keep, 1)]:
        delete(spark, f"{path}/_versions/{version}")
        delete(spark, f"{path}/{folder}")


def upsert(old: DataFrame, new: DataFrame, key: list[str], path: str, version: int) -> None:
    """Old rows without those that new replaces, and new, published as a version."""
    publish(old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True), path, version)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON document without NaN and infinities (they become null; nulls are written)."""
    safe = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars partitioned by asset, so that reads of one asset skip the others."""
    bars.write.mode("overwrite").partitionBy("asset").parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int = 64, partitions: list[str] = (), path: str | None = None) -> None:
    """A table of the catalogue, partitioned by period and bucketed and sorted by its join keys: reads of a period skip the other
    periods' files, and joins and aggregations by the keys need no shuffle. Rows are laid by bucket before the write, so that each
    period has one file a bucket."""
    laid = df.repartition(buckets, *keys)
    w = laid.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    w = w.partitionBy(*partitions) if partitions else w
    (w.option("path", path) if path else w).saveAsTable(name)
