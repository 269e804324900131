"""The binary columnar format: rows and columns as 64-bit little-endian counts, then each column's values, unsigned.

Files lie in a folder that the driver and all executors see."""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of an input partition, and of a batch.
PARTITION_ROWS, BATCH_ROWS = 4 << 20, 1 << 16


def header(path: str) -> tuple[int, int]:
    if os.path.getsize(path) < 16:
        raise ValueError(f"{path} has no header")
    rows, columns = (int(x) for x in np.fromfile(path, "<u8", 2))
    if os.path.getsize(path) < 16 + 8 * rows * columns:
        raise ValueError(f"{path} is shorter than its header says: {rows} rows, {columns} columns")
    return rows, columns


def _files(path: str) -> list[str]:
    return sorted(glob.glob(f"{glob.escape(path)}/part-*.bin")) if os.path.isdir(path) else [path]


class _Rows(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


class _Reader(DataSourceReader):
    def __init__(self, path: str, unsigned: bool):
        self.path, self.unsigned = path, unsigned

    def partitions(self) -> list[InputPartition]:
        return [_Rows(f, lo, min(lo + PARTITION_ROWS, n)) for f in _files(self.path) for n in [header(f)[0]] for lo in range(0, n, PARTITION_ROWS)] or [_Rows("", 0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows, columns = header(partition.path)
        data = np.memmap(partition.path, "<u8", "r", 16, (columns, rows))
        for lo in range(partition.lo, partition.hi, BATCH_ROWS):
            part = data[:, lo : min(lo + BATCH_ROWS, partition.hi)]
            if self.unsigned:
                arrays = [pa.array(c.copy()).cast(pa.decimal128(20, 0)) for c in part]
            elif (part >> 63).any():
                raise OverflowError(f"{partition.path} has values above 2**63 - 1; read it with unsigned")
            else:
                arrays = [pa.array(c.astype(np.int64)) for c in part]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(columns)])


class _Part(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


def _unsigned(a: pa.Array) -> np.ndarray:
    if a.null_count:
        raise ValueError("relations hold no nulls")
    if pa.types.is_decimal(a.type):
        a = a.cast(pa.decimal128(20, 0)).cast(pa.uint64())
    return a.to_numpy().astype("<u8")


class _Writer(DataSourceArrowWriter):
    """Each task writes a part of its own in the same format; commit leaves parts of tasks that succeeded only. A task
    appends each batch to a file for each column, and then puts these together; it holds a batch at a time."""

    def __init__(self, path: str, columns: int):
        self.path, self.columns = path, columns

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        os.makedirs(self.path, exist_ok=True)
        name, rows = f"{self.path}/.{uuid.uuid4().hex}", 0
        columns = [open(f"{name}.{k}", "w+b") for k in range(self.columns)]
        try:
            for b in batches:
                rows += b.num_rows
                for f, c in zip(columns, b.columns, strict=True):
                    f.write(_unsigned(c).tobytes())
            with open(name, "wb") as out:
                np.array([rows, self.columns], "<u8").tofile(out)
                for f in columns:
                    f.seek(0)
                    shutil.copyfileobj(f, out, 1 << 24)
        finally:
            for f in columns:
                f.close()
                os.remove(f.name)
        return _Part(name)

    def commit(self, messages: list[_Part]) -> None:
        for k, m in enumerate(m for m in messages if m is not None):
            os.rename(m.path, f"{self.path}/part-{k:05d}.bin")

    def abort(self, messages: list[_Part]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class BinarySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "u64columns"

    def schema(self) -> str:
        kind = "decimal(20,0)" if self.options.get("unsigned", "false") == "true" else "bigint"
        files = _files(self.options["path"])
        return ", ".join(f"c{i} {kind}" for i in range(header(files[0])[1]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("unsigned", "false") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], len(schema.fields))


def read_binary(spark: SparkSession, path: str, unsigned: bool = False) -> DataFrame:
    """A file, or a folder of parts; longs, or decimal(20,0) if unsigned. Row ranges are read in parallel."""
    spark.dataSource.register(BinarySource)
    return spark.read.format("u64columns").option("unsigned", str(unsigned).lower()).load(path)


def write_parts(df: DataFrame, path: str) -> None:
    """A folder of binary parts, written in parallel."""
    df.sparkSession.dataSource.register(BinarySource)
    df.write.format("u64columns").mode("append").save(path)


#: Bytes of a relation that write_binary puts into one file; the driver copies them.
ONE_FILE = 8 << 30


def write_binary(df: DataFrame, path: str) -> None:
    """One binary file for a relation of up to ONE_FILE bytes: parts are written in parallel, then copied column by
    column by the driver. A larger relation stays a folder of parts, which is read alike."""
    parts = f"{path}.parts"
    write_parts(df, parts)
    if sum(os.path.getsize(f) for f in _files(parts)) > ONE_FILE:
        os.rename(parts, path)
        return
    files = [f for f in _files(parts)]
    heads = [header(f) for f in files]
    rows, columns = sum(n for n, _ in heads), len(df.columns)
    with open(path, "wb") as out:
        np.array([rows, columns], "<u8").tofile(out)
        for c in range(columns):
            for f, (n, _) in zip(files, heads, strict=True):
                if n:
                    np.memmap(f, "<u8", "r", 16 + 8 * n * c, (n,)).tofile(out)
    for f in files:
        os.remove(f)
    os.rmdir(parts)
