"""NumPy archives as a data source: ``spark.read.format("npz")`` and ``write.format("npz")``.

An archive holds arrays whose first axis are the rows; a folder of archives is one
table. Reading has a partition for every range of rows, of which only its bytes are
read where the archive is stored without compression. Writing makes archives of a
bounded number of rows; a folder counts as written when all tasks are done and the
list of its files is there, so what a task left that was lost is never read.
"""

from __future__ import annotations

import json
import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Rows of a partition that is read, and of an archive that is written.
READ_ROWS, FILE_ROWS = 1 << 15, 1 << 16
MANIFEST = "_files.json"
_TYPES = {"b": T.BooleanType(), "U": T.StringType(), "f4": T.FloatType(), "f8": T.DoubleType(), "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType()}


def local_path(path: str) -> str:
    """A path that Python can open on every machine: archives are read by seeking, which needs a mounted folder."""
    scheme, _, rest = path.partition("://")
    if rest and scheme != "file":
        raise ValueError(f"npz needs a folder that is mounted on all machines, not {path}")
    return (rest or path.removeprefix("file:")).rstrip("/")


def _files(path: str) -> list[str]:
    if os.path.isfile(path):
        return [path]
    listed = os.path.join(path, MANIFEST)
    if os.path.exists(listed):
        with open(listed) as f:
            return [os.path.join(path, name) for name in json.load(f)]
    return sorted(os.path.join(path, name) for name in os.listdir(path) if name.endswith(".npz"))


def _header(stream) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(stream)
    shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    if by_column and len(shape) > 1 or dtype.hasobject or not shape or len(shape) > 2:
        raise ValueError("arrays of one or two axes in row order, without objects")
    return shape, dtype


def _headers(path: str) -> dict[str, tuple[tuple[int, ...], np.dtype]]:
    with zipfile.ZipFile(path) as archive:
        found = {}
        for name in archive.namelist():
            with archive.open(name) as stream:
                found[name.removesuffix(".npy")] = _header(stream)
    if len({shape[0] for shape, _ in found.values()}) > 1:
        raise ValueError(f"arrays of different lengths in {path}")
    return found


def _kind(dtype: np.dtype) -> T.DataType:
    if (kind := _TYPES.get(dtype.kind) or _TYPES.get(dtype.str[1:])) is None:
        raise ValueError(f"no column type for {dtype}")
    return kind


@dataclass
class Rows(InputPartition):
    """Rows ``first`` to ``upto`` of an archive."""

    path: str
    first: int
    upto: int


class NpzReader(DataSourceReader):
    def __init__(self, path: str, rows: int, columns: list[str]):
        self.path, self.rows, self.columns = path, rows, columns

    def partitions(self) -> list[Rows]:
        made = []
        for path in _files(self.path):
            n = next((shape[0] for shape, _ in _headers(path).values()), 0)
            made += [Rows(path, lo, min(n, lo + self.rows)) for lo in range(0, n, self.rows)]
        return made or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.upto <= partition.first:
            return
        arrays = []
        with zipfile.ZipFile(partition.path) as archive:
            for name in self.columns:
                with archive.open(f"{name}.npy") as stream:
                    shape, dtype = _header(stream)
                    width = shape[1] if len(shape) > 1 else 1
                    stream.seek(partition.first * width * dtype.itemsize, os.SEEK_CUR)
                    flat = np.frombuffer(stream.read((partition.upto - partition.first) * width * dtype.itemsize), dtype=dtype)
                values = pa.array(flat.astype(dtype.newbyteorder("=")) if dtype.kind != "U" else flat.tolist())
                arrays.append(values if len(shape) == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(flat) // max(width, 1) + 1) * width, pa.int32()), values))
        yield pa.RecordBatch.from_arrays(arrays, names=self.columns)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class NpzWriter(DataSourceArrowWriter):
    def __init__(self, path: str, rows: int, overwrite: bool):
        self.path, self.rows, self.overwrite = path, rows, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        files, held, n = [], [], 0

        def flush() -> None:
            nonlocal held, n
            table = pa.Table.from_batches(held)
            columns = {}
            for name in table.column_names:
                column = table.column(name).combine_chunks()
                if column.null_count:
                    raise ValueError(f"{name} has nulls, which an archive cannot hold")
                if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
                    flat = column.flatten().to_numpy(zero_copy_only=False)
                    columns[name] = flat.reshape(len(column), -1)
                else:
                    columns[name] = np.array(column.to_pylist(), dtype=str) if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)
            name = f"part-{uuid.uuid4().hex}.npz"
            np.savez(os.path.join(self.path, name), **columns)
            files.append(name)
            held, n = [], 0

        for batch in iterator:
            while batch.num_rows:
                part, batch = batch.slice(0, self.rows - n), batch.slice(self.rows - n)
                held.append(part)
                n += part.num_rows
                if n == self.rows:
                    flush()
        if n:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        listed = os.path.join(self.path, MANIFEST)
        before = []
        os.makedirs(self.path, exist_ok=True)
        if os.path.exists(listed):
            with open(listed) as f:
                before = json.load(f)
        files = ([] if self.overwrite else before) + sorted(name for m in messages if m for name in m.files)
        with open(f"{listed}.new", "w") as f:
            json.dump(files, f)
        os.replace(f"{listed}.new", listed)
        for name in set(before) - set(files):
            os.remove(os.path.join(self.path, name))

    def abort(self, messages: list[Written | None]) -> None:
        for name in (name for m in messages if m for name in m.files):
            os.remove(os.path.join(self.path, name))


class NpzSource(DataSource):
    """Options: ``path``, and ``rows`` of a partition or an archive."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> T.StructType:
        files = _files(local_path(self.options["path"]))
        if not files:
            raise ValueError(f"no archive in {self.options['path']}: name the schema")
        return T.StructType([T.StructField(k, _kind(d) if len(s) == 1 else T.ArrayType(_kind(d))) for k, (s, d) in _headers(files[0]).items()])

    def reader(self, schema: T.StructType) -> NpzReader:
        return NpzReader(local_path(self.options["path"]), int(self.options.get("rows", READ_ROWS)), schema.fieldNames())

    def writer(self, schema: T.StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(local_path(self.options["path"]), int(self.options.get("rows", FILE_ROWS)), overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make ``npz`` known to a session."""
    spark.dataSource.register(NpzSource)
    return spark
