"""A Spark data source of fixed-width records: its partitions are byte ranges of whole records, whatever the bytes are.

A range is read a few MiB at a time, and its columns are made of the bytes without a step for each record.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..workspace import send_package
from .layout import Field, parse_layout

#: Bytes read together.
READ_BYTES = 4 << 20


def ranges_of(files: list[tuple[str, int]], stride: int, skip: int, size: int) -> list[tuple[str, int, int, int]]:
    """(file, first byte, records, number of the first) of ranges of about ``size`` bytes, without the first ``skip`` records."""
    found, before, per = [], 0, max(1, size // stride)
    for file, n in files:
        for at in range(max(0, min(n, skip - before)), n, per):
            found.append((file, at * stride, min(per, n - at), before + at - skip + 1))
        before += n
    return found


class Range(InputPartition):
    def __init__(self, file: str, start: int, n: int, rec_no: int):
        self.file, self.start, self.n, self.rec_no = file, start, n, rec_no


def opened(path: str):
    """A file of any store that pyarrow knows."""
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _binary(data: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    n, width = data.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _utf8(data: bytes, encoding: str) -> bytes:
    """Bytes of another encoding as UTF-8; a byte that UTF-8 doesn't have if they are malformed."""
    try:
        return data.decode(encoding).encode()
    except UnicodeDecodeError:
        return b"\xff"


def decoded(data: bytes, first: int, stride: int, fields: list[Field], encoding: str | None) -> pa.RecordBatch:
    """``rec_no``, ``raw``, ``f0``, ``f1``, ...: numbers typed, text as bytes; numbers whose bytes are NULLIF are null."""
    bytes_ = np.frombuffer(data, np.uint8).reshape(-1, stride)
    columns = [pa.array(np.arange(first, first + len(bytes_))), _binary(bytes_)]
    for f in fields:
        own = bytes_[:, f.offset : f.offset + f.length]
        if not f.code:
            text = _binary(own)
            columns.append(pa.array([_utf8(x, encoding) for x in text.to_pylist()], pa.binary()) if encoding else text)
            continue
        null = (own == np.frombuffer(f.nullif, np.uint8)).all(axis=1) if f.nullif is not None else None
        values = np.ascontiguousarray(own).view("<" + f.code)[:, 0]
        columns.append(pa.array(values.astype({"u2": np.int32, "u4": np.int64}.get(f.code, values.dtype)), mask=null))
    return pa.RecordBatch.from_arrays(columns, ["rec_no", "raw", *(f"f{i}" for i in range(len(fields)))])


class FixedReader(DataSourceReader):
    def __init__(self, plan: dict):
        self.plan = plan
        self.fields = [Field(*f[:4], bytes.fromhex(f[4]) if f[4] is not None else None) for f in plan["fields"]]

    def partitions(self) -> list[InputPartition]:
        p = self.plan
        found = ranges_of([tuple(f) for f in p["files"]], p["stride"], p["skip"], p["size"])
        return [Range(*r) for r in found] or [Range("", 0, 0, 1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        stride, left, rec_no = self.plan["stride"], partition.n, partition.rec_no
        if not left:
            return
        per = max(1, READ_BYTES // stride)
        with opened(partition.file) as file:
            file.seek(partition.start)
            while left:
                n = min(per, left)
                data = file.read(n * stride)
                if len(data) < n * stride:
                    raise EOFError(f"{partition.file} has become shorter")
                yield decoded(data, rec_no, stride, self.fields, self.plan["encoding"])
                left, rec_no = left - n, rec_no + n


def texts_of(column: pa.Array, f: Field) -> pa.Array:
    """Text up to the first NUL; null if it equals NULLIF (which is empty if not given) or isn't UTF-8; CHAR loses blanks at its end."""

    def one(data: bytes) -> str | None:
        data = data.split(b"\0", 1)[0]
        if data == (f.nullif or b""):
            return None
        try:
            return (data.rstrip(b" ") if f.kind == "CHAR" else data).decode()
        except UnicodeDecodeError:
            return None

    return pa.array([one(x) for x in column.to_pylist()], pa.string())


class TypedReader(FixedReader):
    """Values only, under the names of the view."""

    def __init__(self, plan: dict, names: list[str]):
        super().__init__(plan)
        self.names = names

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for batch in super().read(partition):
            columns = [batch.column(2 + i) if f.code else texts_of(batch.column(2 + i), f) for i, f in enumerate(self.fields)]
            yield pa.RecordBatch.from_arrays(columns, self.names)


class FixedRecords(DataSource):
    """Options for SQL: ``input`` (a file or a folder), ``col`` (columns of the layout, separated by ``;``), ``names`` (by
    ``,``; c1, c2, ... otherwise), ``stride``, ``skip``. ``read`` gives its own ``plan``."""

    @classmethod
    def name(cls) -> str:
        return "sluice_fixed"

    def _layout(self) -> tuple[list[Field], int, list[str]]:
        fields, stride = parse_layout([x.strip() for x in self.options["col"].split(";")], int(self.options.get("stride", 0)))
        names = [x.strip() for x in self.options["names"].split(",")] if "names" in self.options else [f"c{i + 1}" for i in range(len(fields))]
        if len(names) != len(fields):
            raise ValueError(f"{len(names)} names for {len(fields)} columns")
        return fields, stride, names

    def schema(self) -> str:
        fields, _, names = self._layout()
        return ", ".join(f"`{x}` {f.spark_type}" for x, f in zip(names, fields, strict=True))

    def reader(self, schema: StructType) -> FixedReader:
        if "plan" in self.options:
            return FixedReader(json.loads(self.options["plan"]))
        fields, stride, names = self._layout()
        files = [(f, n // stride) for f, n in listed(self.options["input"])]
        return TypedReader(plan_of(files, stride, int(self.options.get("skip", 0)), fields, None, 128 << 20), names)


def listed(path: str) -> list[tuple[str, int]]:
    """Files and their bytes, as Python sees them: a file, or those of a folder by name."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    prefix = path[: len(path) - len(base)] if ":" in path else "file:"
    info = store.get_file_info(base)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(base))
    return sorted((prefix + x.path, x.size) for x in found if x.is_file and x.base_name[0] not in "._")


def plan_of(files: list[tuple[str, int]], stride: int, skip: int, fields: list[Field], encoding: str | None, size: int) -> dict:
    kinds = [[f.kind, f.offset, f.length, f.code, f.nullif.hex() if f.nullif is not None else None] for f in fields]
    return {"files": files, "stride": stride, "skip": skip, "encoding": encoding, "size": size, "fields": kinds}


def register(spark: SparkSession) -> None:
    """Make ``sluice_fixed`` known to the session."""
    send_package(spark)
    spark.dataSource.register(FixedRecords)


def _bytes(text: str) -> int:
    """A size of Spark's configuration."""
    number, unit = text.rstrip("bB"), 0
    if number and number[-1].lower() in "kmgt":
        unit = 10 * (1 + "kmgt".index(number[-1].lower()))
        number = number[:-1]
    return int(number) << unit


def read(spark: SparkSession, files: list[tuple[str, int]], stride: int, skip: int, fields: list[Field], encoding: str | None) -> DataFrame:
    """Records of files (path, whole records) in order, numbered from 1 after ``skip``."""
    register(spark)
    plan = plan_of(files, stride, skip, fields, encoding, _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    types = "".join(f", f{i} {f.spark_type if f.code else 'binary'}" for i, f in enumerate(fields))
    return spark.read.format("sluice_fixed").schema(f"rec_no long, raw binary{types}").option("plan", json.dumps(plan)).load()
