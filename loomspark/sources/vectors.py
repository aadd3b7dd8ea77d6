"""Binary vector and tensor files as data sources: files are read in ranges by many tasks, and written by many tasks with one commit.

Ranges start and end at record borders, or inside one tensor, so a file of any size is read in parallel and no task holds more than one range. A
write puts its files in place when all tasks are done; if one fails, none of them stays.
"""

from __future__ import annotations

import json
import math
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a range that one task reads, and of the batches it gives out.
RANGE, BATCH = 64 << 20, 4 << 20
#: Rows of a batch, at most.
ROWS = 4096
#: Bytes of tensors in a file that is written, about, and of its header: many small tensors make more files.
SHARD, HEAD = 1 << 30, 8 << 20
# Bytes of the dtypes that are read, the longest header, and the name of the index over several files.
_WIDTHS = {"F32": 4, "F16": 2, "BF16": 2}
_HEADER = 100 << 20
_INDEX = "model.safetensors.index.json"


# --- files -----------------------------------------------------------------------------------


def _store(path: str):
    """The file system of a path, as Arrow opens it, and the path there."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _open(path: str):
    store, name = _store(path)
    return store.open_input_file(name)


def _create(path: str):
    store, name = _store(path)
    store.create_dir(os.path.dirname(name), recursive=True)
    return store.open_output_stream(name)


def _move(a: str, b: str) -> None:
    store, name = _store(a)
    store.move(name, _store(b)[1])


def _delete(path: str) -> None:
    store, name = _store(path)
    if store.get_file_info(name).is_file:
        store.delete_file(name)


def _listed(spark: SparkSession, path: str) -> str:
    """Files of a path, a folder or a pattern with their sizes, as an option; other than data files (names with `_` or `.` first, JSON) are left out."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for s in files.globStatus(where) or []:
        found += list(files.listStatus(s.getPath())) if s.isDirectory() else [s]
    if not found:
        raise ValueError(f"no file at {path}")
    sizes = sorted((s.getPath().toString(), s.getLen()) for s in found if s.isFile() and s.getPath().getName()[0] not in "_." and not s.getPath().getName().endswith(".json"))
    return json.dumps(sizes)


@dataclass
class _Range(InputPartition):
    """`count` records, or entries of a tensor, of a file from `first` on, which stand at byte `start`."""

    path: str
    start: int
    first: int
    count: int
    width: int
    name: str = ""
    dtype: str = ""
    shape: tuple = ()


def _cut(r: _Range, size: int) -> Iterator[_Range]:
    step = max(1, size // r.width)
    for at in range(0, r.count, step):
        yield _Range(r.path, r.start + at * r.width, r.first + at, min(step, r.count - at), r.width, r.name, r.dtype, r.shape)


@dataclass
class _Written(WriterCommitMessage):
    """Drafts that a task has written, and whether they hold named tensors."""

    files: list


class _Writer(DataSourceArrowWriter):
    """Drafts by the tasks; names in order of the tasks when all are done."""

    def __init__(self, path: str, suffix: str, overwrite: bool):
        self._path, self._suffix, self._draft = path, suffix, f"{path}/_drafts-{uuid.uuid4().hex}"

    def commit(self, messages) -> None:
        drafts, index = [f for m in messages if m for f in m.files], None
        try:
            for i, (draft, named) in enumerate(drafts):
                name = f"part-{i + 1:05d}-of-{len(drafts):05d}-{uuid.uuid4().hex[:8]}{self._suffix}"
                _move(draft, f"{self._path}/{name}")
                if named:  # the index goes out file by file: the driver holds one header
                    store, at = _store(f"{self._path}/{name}")
                    head, _ = _header(f"{self._path}/{name}", store.get_file_info(at).size)
                    index = index or _create(f"{self._path}/{_INDEX}")
                    index.write((('{"metadata": {}, "weight_map": {' if i == 0 else ", ") + ", ".join(f"{json.dumps(t)}: {json.dumps(name)}" for t in head)).encode())
            if index:
                index.write(b"}}")
        finally:
            if index:
                index.close()
        self._clear()

    def abort(self, messages) -> None:
        for draft, _ in [f for m in messages if m for f in m.files]:
            _delete(draft)
        self._clear()

    def _clear(self) -> None:
        store, name = _store(self._draft)
        if store.get_file_info(name).type.name == "Directory":
            store.delete_dir(name)


# --- vectors ---------------------------------------------------------------------------------


class _VectorReader(DataSourceReader):
    def __init__(self, options, kind: str):
        self._files, self._kind = json.loads(options["files"]), kind
        self._limit, self._range = int(options.get("limit", 1 << 62)), int(options.get("range", RANGE))

    def partitions(self) -> list[_Range]:
        out = []
        for path, size in self._files:
            with _open(path) as data:
                head = data.read(4)
            if len(head) < 4:
                raise ValueError(f"{path}: empty vector file")
            dim = struct.unpack("<i", head)[0]
            if dim <= 0 or size % (4 + 4 * dim):
                raise ValueError(f"{path}: a vector file has records of one positive dimension")
            out += _cut(_Range(path, 0, 0, min(self._limit, size // (4 + 4 * dim)), 4 + 4 * dim), self._range)
        return out

    def read(self, r: _Range):
        dim, value = r.width // 4 - 1, pa.float32() if self._kind == "<f4" else pa.int32()
        with _open(r.path) as data:
            data.seek(r.start)
            for at in range(0, r.count, max(1, BATCH // r.width)):
                n = min(max(1, BATCH // r.width), r.count - at)
                rows = np.frombuffer(data.read(n * r.width), "<i4").reshape(n, dim + 1)
                if (rows[:, 0] != dim).any():
                    raise ValueError(f"{r.path}: the dimension changes inside the file")
                values = np.ascontiguousarray(rows[:, 1:]).view(self._kind).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(values, value))
                ids = r.first + at + np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array([r.path] * n), pa.array(ids), lists], ["path", "id", "values"])


class _VectorWriter(_Writer):
    def __init__(self, path: str, kind: str, overwrite: bool):
        super().__init__(path, ".fvecs" if kind == "<f4" else ".ivecs", overwrite)
        self._kind = kind

    def write(self, batches) -> _Written:
        draft, dim, out = f"{self._draft}/{uuid.uuid4().hex}", None, None
        try:
            for batch in batches:
                lists = batch.column(0)
                sizes = np.diff(lists.offsets.to_numpy())
                if lists.null_count or not len(sizes):
                    if lists.null_count:
                        raise ValueError("a vector is missing")
                    continue
                dim = sizes[0] if dim is None else dim
                if (sizes != dim).any() or dim <= 0:
                    raise ValueError("a vector file has records of one positive dimension")
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(self._kind).view("<i4").reshape(len(sizes), dim)
                out = out or _create(draft)
                out.write(np.column_stack([np.full(len(sizes), dim, "<i4"), values]).tobytes())
        finally:
            if out:
                out.close()
        return _Written([(draft, False)] if out else [])


class FloatVectors(DataSource):
    """Files of (dimension, 32-bit values) records: options `files` or `path`, `limit` (records a file), `range` (bytes a task)."""

    _kind, _schema = "<f4", "path string, id long, values array<float>"

    @classmethod
    def name(cls) -> str:
        return "fvecs"

    def schema(self) -> str:
        return self._schema

    def reader(self, schema: StructType) -> DataSourceReader:
        return _VectorReader(self.options, self._kind)

    def writer(self, schema: StructType, overwrite: bool):
        return _VectorWriter(self.options["path"], self._kind, overwrite)


class IntVectors(FloatVectors):
    _kind, _schema = "<i4", "path string, id long, values array<int>"

    @classmethod
    def name(cls) -> str:
        return "ivecs"


def _vectors(spark: SparkSession, source: type[DataSource], path: str, limit: int | None, size: int) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("files", _listed(spark, path)).option("range", str(size))
    return (reader if limit is None else reader.option("limit", str(limit))).load()


def fvecs(spark: SparkSession, path: str, limit: int | None = None, size: int = RANGE) -> DataFrame:
    """(path, id, embedding): float vectors of one or many files, numbered in each, the first `limit` of each; `size` bytes a task."""
    return _vectors(spark, FloatVectors, path, limit, size).withColumnRenamed("values", "embedding")


def ivecs(spark: SparkSession, path: str, limit: int | None = None, size: int = RANGE) -> DataFrame:
    """(path, id, neighbors)."""
    return _vectors(spark, IntVectors, path, limit, size).withColumnRenamed("values", "neighbors")


def write_fvecs(df: DataFrame, column: str, path: str) -> None:
    """A column of float vectors as files, one a task, in the order of the task's rows."""
    df.sparkSession.dataSource.register(FloatVectors)
    df.select(df[column].cast("array<float>").alias("values")).write.format("fvecs").mode("append").save(path)


# --- tensors ---------------------------------------------------------------------------------


def decoded(raw: bytes, dtype: str) -> np.ndarray:
    """Tensor bytes as 32-bit floats."""
    if dtype == "BF16":
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
    return np.frombuffer(raw, "<f2" if dtype == "F16" else "<f4").astype(np.float32)


def raw_of(values: np.ndarray, dtype: str) -> bytes:
    """32-bit floats as tensor bytes, rounded to the nearest, to even where two are as near."""
    if dtype == "BF16":
        bits = values.astype("<f4").view(np.uint32).astype(np.uint64)
        rounded = (bits + 0x7FFF + ((bits >> 16) & 1)) >> 16
        return np.where(np.isnan(values), (bits >> 16) | 64, rounded).astype("<u2").tobytes()
    return values.astype("<f2" if dtype == "F16" else "<f4").tobytes()


def _header(path: str, size: int) -> tuple[dict, int]:
    """The header of a file alone, and where its tensors start."""
    with _open(path) as data:
        head = data.read(8)
        n = struct.unpack("<Q", head)[0] if len(head) == 8 else _HEADER + 1
        if n > _HEADER or 8 + n > size:
            raise ValueError(f"{path}: header length out of range")
        return json.loads(data.read(n)), 8 + n


@dataclass
class _Share(InputPartition):
    """The tensors of a file, or runs of their entries, that start from byte `start` on and before `end`."""

    path: str
    size: int
    start: int
    end: int


class _TensorReader(DataSourceReader):
    """Files are cut into shares by their sizes alone; each task reads the header of its file, so a tensor is a task of its own only where it is as
    large as a share."""

    def __init__(self, options):
        self._files, self._range, self._values = json.loads(options["files"]), int(options.get("range", RANGE)), options.get("values") == "true"

    def partitions(self) -> list[_Share]:
        out = []
        for path, size in self._files:
            starts = range(0, max(1, size), self._range) if self._values else range(1)
            out += [_Share(path, size, at, at + self._range if at != starts[-1] else size + 1) for at in starts]
        return out

    def _ranges(self, share: _Share) -> list[_Range]:
        head, base = _header(share.path, share.size)
        out = []
        for name, t in head.items():
            if name == "__metadata__" or t["dtype"] not in _WIDTHS:
                continue
            (start, end), width = t["data_offsets"], _WIDTHS[t["dtype"]]
            n = math.prod(t["shape"])
            if end - start != width * n or base + end > share.size or start < 0:
                raise ValueError(f"{name}: wrong byte length")
            if base + end < share.start or base + start >= share.end:
                continue
            whole = _Range(share.path, base + start, 0, n, width, name, t["dtype"], tuple(t["shape"]))
            out += [r for r in (_cut(whole, self._range) if self._values and n else [whole]) if share.start <= r.start < share.end]
        return sorted(out, key=lambda r: r.start)

    def read(self, share: _Share):
        rows, held = [], 0
        with _open(share.path) as data:
            for r in self._ranges(share):
                step = max(1, BATCH // r.width) if self._values else max(1, r.count)
                data.seek(r.start)
                for at in range(0, max(1, r.count), step):
                    n = min(step, r.count - at)
                    values = decoded(data.read(n * r.width), r.dtype) if self._values else np.zeros(0, np.float32)
                    rows.append((r.path, r.name, r.dtype, r.shape, r.start + at * r.width, n * r.width, r.first + at, values))
                    held += values.nbytes
                    if held >= BATCH or len(rows) >= ROWS:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        lengths = [len(v) for v in columns[-1]]
        ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(columns[-1]))) if self._values else pa.nulls(len(rows), pa.list_(pa.float32()))
        types = {"path": pa.string(), "name": pa.string(), "dtype": pa.string(), "shape": pa.list_(pa.int64()), "offset": pa.int64(), "length": pa.int64(), "at": pa.int64()}
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types.values())), lists], [*types, "data"])


class _TensorWriter(_Writer):
    """A task's tensors in files of about `SHARD` bytes each; a tensor whose values don't fit its shape ends the write."""

    def __init__(self, path: str, overwrite: bool):
        super().__init__(path, ".safetensors", overwrite)

    def write(self, batches) -> _Written:
        done, held, size, head = [], [], 0, 0
        for batch in batches:
            for name, dtype, shape, data in zip(*(batch.column(c) for c in ("name", "dtype", "shape", "data"))):
                name, dtype, shape = name.as_py(), dtype.as_py(), shape.as_py()
                values = np.asarray(data.values.to_numpy(zero_copy_only=False), np.float32)
                if dtype not in _WIDTHS or len(values) != math.prod(shape):
                    raise ValueError(f"{name}: wrong dtype or byte length")
                held.append((name, dtype, shape, raw_of(values, dtype)))
                size += len(held[-1][3])
                head += len(json.dumps(name)) + 24 * len(shape) + 100
                if size > SHARD or head > HEAD:
                    done.append(self._file(held))
                    held, size, head = [], 0, 0
        return _Written(done + ([self._file(held)] if held else []))

    def _file(self, tensors: list) -> tuple[str, bool]:
        head, at = {}, 0
        for name, dtype, shape, raw in tensors:
            head[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(raw)]}
            at += len(raw)
        text = json.dumps(head).encode()
        text += b" " * (-len(text) % 8)
        draft = f"{self._draft}/{uuid.uuid4().hex}"
        with _create(draft) as out:
            out.write(struct.pack("<Q", len(text)) + text)
            for *_, raw in tensors:
                out.write(raw)
        return draft, True


class Tensors(DataSource):
    """Tensor files: options `files` or `path`, `values` (whether to read them), `range` (bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return "path string, name string, dtype string, shape array<long>, offset long, length long, at long, data array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TensorReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return _TensorWriter(self.options["path"], overwrite)


def tensors(spark: SparkSession, path: str, values: bool = False, size: int = RANGE) -> DataFrame:
    """Tensor files to (path, name, dtype, shape, offset, length), from their headers alone; with `values` to one row for each run of entries (at: the
    first one, data). Other than float tensors are left out; byte lengths are checked against shapes."""
    spark.dataSource.register(Tensors)
    rows = spark.read.format("tensors").option("files", _listed(spark, path)).option("values", str(values).lower()).option("range", str(size)).load()
    return rows if values else rows.drop("at", "data")


def write_tensors(df: DataFrame, path: str) -> None:
    """(name, dtype, shape, data) to tensor files, one or more a task, with an index of the file that holds each tensor. Nothing appears unless all is written."""
    df.sparkSession.dataSource.register(Tensors)
    cast = {"name": "string", "dtype": "string", "shape": "array<long>", "data": "array<float>"}
    df.select(*[df[c].cast(t).alias(c) for c, t in cast.items()]).write.format("tensors").mode("append").save(path)


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """(name, file) of a folder's index."""
    from pyspark.sql import functions as F

    rows = spark.read.text(f"{path}/{_INDEX}", wholetext=True).select(F.variant_get(F.parse_json("value"), "$.weight_map", "map<string,string>").alias("m"))
    return rows.select(F.explode("m").alias("name", "file"))
