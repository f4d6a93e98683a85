"""Zipped CSV files with checksums, as a Spark data source: one partition for each member of each archive.

    spark.dataSource.register(ZippedCsv)
    spark.read.format("zipped_csv").schema("price double, qty double").option("names", "id,price,qty").load(path)

path is an archive or a folder of them, on any file system that Arrow opens by its address (file, s3, gs, hdfs). Beside
`x.zip` a file `x.zip.CHECKSUM` may hold its SHA-256 (the first word). Only the columns of the schema are parsed; `names` gives
the columns of files without a header line. Two more columns may be asked for: _archive (its name) and _error.

A damaged archive (wrong checksum, broken zip, broken member) gives one row whose data are null, with its name and what is
wrong, and the others are read; with mode=FAILFAST it raises. Lines with too few fields give nulls, as do values that do not
parse. Empty members give no rows.
"""

from __future__ import annotations

import csv
import hashlib
import io
import itertools
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from datetime import date, datetime

import pyarrow as pa
from pyarrow import csv as pa_csv
from pyarrow import fs as afs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 10_000
_TRUE = {"true": True, "1": True, "false": False, "0": False}
_PARSE = {
    T.DoubleType: float,
    T.FloatType: float,
    T.LongType: int,
    T.IntegerType: int,
    T.BooleanType: lambda v: _TRUE[v.lower()],
    T.DateType: date.fromisoformat,
    T.TimestampType: datetime.fromisoformat,
    T.StringType: str,
}


def _system(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (afs.LocalFileSystem(), path)


class Member(InputPartition):
    def __init__(self, archive: str, member: str | None, error: str | None = None) -> None:
        self.archive, self.member, self.error = archive, member, error


class ZippedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> str:
        names = [n for n in self.options.get("names", "").split(",") if n]
        if not names:
            raise ValueError("give a schema, or the option names")
        return ", ".join(f"`{n}` string" for n in names)

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(schema, dict(self.options))


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.schema, self.path = schema, options["path"]
        self.names = [n for n in options.get("names", "").split(",") if n]
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"

    def partitions(self) -> list[Member]:
        """The members of all archives. Of an archive only its directory, at its end, is read here."""
        fs, path = _system(self.path)
        info = fs.get_file_info(path)
        files = [info] if info.is_file else fs.get_file_info(afs.FileSelector(path, recursive=True))
        out = []
        for f in sorted((f for f in files if f.is_file and f.path.endswith(".zip")), key=lambda f: f.path):
            try:
                with fs.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:
                    out += [Member(f.path, n) for n in z.namelist() if not n.endswith("/")]
            except (zipfile.BadZipFile, OSError, ValueError) as e:
                out.append(Member(f.path, None, f"not an archive: {e}"))
        return out or [Member("", None)]

    def _checked(self, fs: afs.FileSystem, path: str) -> None:
        """Compare the archive with its checksum file, if there is one; read in pieces."""
        if not fs.get_file_info(path + ".CHECKSUM").is_file:
            return
        with fs.open_input_stream(path + ".CHECKSUM") as f:
            want = f.read().decode().split()[0].lower()
        digest = hashlib.sha256()
        with fs.open_input_stream(path) as f:
            while piece := f.read(1 << 20):
                digest.update(piece)
        if digest.hexdigest() != want:
            raise ValueError("checksum differs")

    def _rows(self, text: io.TextIOBase) -> Iterator[list]:
        lines = csv.reader(text)
        names = self.names or next(lines, [])
        place = {n: i for i, n in enumerate(names)}
        own = [(place.get(f.name), _PARSE[type(f.dataType)], f.name) for f in self.schema]
        for line in lines:
            row = []
            for i, parse, _ in own:
                try:
                    row.append(parse(line[i]) if i is not None and i < len(line) and line[i] != "" else None)
                except (ValueError, KeyError):
                    row.append(None)
            yield row

    def _batch(self, rows: list[list], archive: str, error: str | None) -> pa.RecordBatch:
        fixed = {"_archive": archive, "_error": error}
        schema = _arrow(self.schema)
        columns = [[fixed[f.name]] * len(rows) if f.name in fixed else [r[i] for r in rows] for i, f in enumerate(self.schema)]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        name = partition.archive.rsplit("/", 1)[-1]
        try:
            if partition.error:
                raise ValueError(partition.error)
            fs, _ = _system(self.path)
            self._checked(fs, partition.archive)
            with fs.open_input_file(partition.archive) as raw, zipfile.ZipFile(raw) as z:
                # The first pass finds damage (the member's own check sum) before any row is given.
                with z.open(partition.member) as f:
                    while f.read(1 << 20):
                        pass
                with z.open(partition.member) as f:
                    rows = []
                    for row in self._rows(io.TextIOWrapper(f, "utf-8", errors="replace", newline="")):
                        rows.append(row)
                        if len(rows) == BATCH:
                            yield self._batch(rows, name, None)
                            rows = []
                    if rows:
                        yield self._batch(rows, name, None)
        except (zipfile.BadZipFile, zlib.error, ValueError, OSError, EOFError) as e:
            if self.strict:
                raise ValueError(f"{name}: {e}") from e
            yield self._batch([[None] * len(self.schema)], name, str(e))


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.BooleanType: pa.bool_()}
    kinds |= {T.DateType: pa.date32(), T.TimestampType: pa.timestamp("us", "UTC"), T.StringType: pa.string()}
    return pa.schema([pa.field(f.name, kinds[type(f.dataType)]) for f in schema])


class _Summed:
    """A stream that is only written to, and the SHA-256 of what went through."""

    def __init__(self, out: pa.NativeFile) -> None:
        self.out, self.digest = out, hashlib.sha256()

    def write(self, data: bytes) -> int:
        self.digest.update(data)
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


def write_archives(df: DataFrame, path: str, name: str) -> None:
    """Rows as zipped CSV without a header: an archive and its checksum file for each value of column `name`, which is left out.
    The rows of one archive are put together in one task, batch by batch, so that no archive is held; it takes its name when whole."""
    columns = [c for c in df.columns if c != name]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _system(path)
        fs.create_dir(base)
        first, plain = next(batches), pa_csv.WriteOptions(include_header=False)
        key, begun = str(first.column(name)[0].as_py()), f"{base}/{uuid.uuid4().hex}.part"
        try:
            with fs.open_output_stream(begun) as raw:
                held = _Summed(raw)
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z, z.open(f"{key}.csv", "w", force_zip64=True) as member:
                    for batch in itertools.chain([first], batches):
                        lines = pa.BufferOutputStream()
                        pa_csv.write_csv(batch.select(columns), lines, plain)
                        member.write(lines.getvalue())
            fs.move(begun, f"{base}/{key}.zip")
        except BaseException:
            if fs.get_file_info(begun).is_file:
                fs.delete_file(begun)
            raise
        with fs.open_output_stream(f"{base}/{key}.zip.CHECKSUM") as f:
            f.write(f"{held.digest.hexdigest()}  {key}.zip\n".encode())
        yield first.select([name]).slice(0, 1)

    df.groupBy(name).applyInArrow(put, T.StructType([df.schema[name]])).agg(F.count(F.lit(1))).collect()
