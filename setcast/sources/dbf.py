"""Attribute tables of shapefiles (dBASE files) as a Spark data source.

Records have one length, so that a file is read by byte ranges in parallel; only the fields asked for are taken apart. Register with register(), then
spark.read.format("dbf").schema(...).load(path), or read() for chosen columns. The path must be one that the driver and all executors can open.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of records that a task reads, and that it takes apart at once.
RANGE, AT_ONCE = 64 << 20, 8 << 20
_DELETED = ord("*")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    start: int
    length: int
    decimals: int

    def type(self) -> T.DataType:
        if self.kind == "N" and not self.decimals:
            return T.IntegerType() if self.length <= 9 else T.LongType() if self.length <= 18 else T.DecimalType(38, 0)
        return {"N": T.DoubleType(), "F": T.DoubleType(), "O": T.DoubleType(), "B": T.DoubleType(), "I": T.IntegerType(), "L": T.BooleanType(), "D": T.DateType()}.get(self.kind, T.StringType())


@dataclass(frozen=True)
class Header:
    records: int
    first: int
    length: int
    fields: tuple[Field, ...]


def header(path: str) -> Header:
    with open(path, "rb") as f:
        start = f.read(32)
        if len(start) < 32:
            raise ValueError(f"{path} is no dBASE file: it has {len(start)} bytes")
        records, first, length = struct.unpack("<IHH", start[4:12])
        rest = f.read(max(0, first - 32))
    fields, at = [], 1  # a record starts with the mark of deletion
    for k in range(0, len(rest) - 31, 32):
        if rest[k] == 0x0D:
            break
        name, size, decimals = rest[k : k + 11].split(b"\0")[0].decode("ascii", "replace").strip(), rest[k + 16], rest[k + 17]
        kind = chr(rest[k + 11]).upper()
        if kind == "C":
            size, decimals = size + 256 * decimals, 0
        fields.append(Field(name, kind, at, size, decimals))
        at += size
    if not length or at > length:
        raise ValueError(f"{path} is no dBASE file: fields take {at} bytes of {length}")
    # The header may promise more records than there are.
    return Header(max(0, min(records, (os.path.getsize(path) - first) // length)), first, length, tuple(fields))


def _texts(column: np.ndarray, encoding: str) -> pa.Array:
    """Fixed-length fields as strings without the spaces and zero bytes that fill them; null if nothing is left."""
    raw = pa.array(column.tolist(), pa.binary())
    try:
        text = raw.cast(pa.string()) if encoding.lower().replace("-", "") == "utf8" else None
    except pa.ArrowInvalid:
        text = None
    if text is None:
        text = pa.array([x.decode(encoding, "replace") for x in raw.to_pylist()], pa.string())
    text = pc.utf8_trim(text, " \0")
    return pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text)


def _numbers(text: pa.Array, kind: pa.DataType) -> pa.Array:
    """Numbers as far as they are any: fields that overflow are filled with asterisks."""
    fine = pc.match_substring_regex(text, r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    text = pc.if_else(fine, text, pa.scalar(None, pa.string()))
    text = pc.utf8_ltrim(text, "+")
    if pa.types.is_integer(kind):
        text = pc.replace_substring_regex(text, r"\.0*$", "")
    return text.cast(kind)


def _column(records: np.ndarray, field: Field, kind: T.DataType, encoding: str) -> pa.Array:
    raw = np.ascontiguousarray(records[:, field.start : field.start + field.length])
    if field.kind in "OBI" and field.length in (4, 8):
        return pa.array(raw.view("<i4" if field.kind == "I" else "<f8").ravel())
    text = _texts(raw.view(f"S{field.length}").ravel() if field.length else np.full(len(raw), b""), encoding)
    if isinstance(kind, T.BooleanType):
        upper = pc.utf8_upper(text)
        return pc.if_else(pc.is_in(upper, pa.array(["T", "Y"])), True, pc.if_else(pc.is_in(upper, pa.array(["F", "N"])), False, pa.scalar(None, pa.bool_())))
    if isinstance(kind, T.DateType):
        fine = pc.match_substring_regex(text, r"^[0-9]{8}$")
        return pc.strptime(pc.if_else(fine, text, pa.scalar(None, pa.string())), format="%Y%m%d", unit="s", error_is_null=True).cast(pa.date32())
    if isinstance(kind, T.StringType):
        return text
    return _numbers(text, {T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.DecimalType: pa.decimal128(38, 0)}.get(type(kind), pa.float64()))


@dataclass
class Range(InputPartition):
    begin: int
    end: int


class DbfReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, encoding: str, size: int):
        self.path, self.encoding, self.header = path, encoding, header(path)
        known = {f.name: f for f in self.header.fields}
        missing = [f.name for f in schema.fields if f.name not in known]
        if missing:
            raise ValueError(f"{path} has no field {', '.join(missing)}; it has {', '.join(known)}")
        self.columns = [(known[f.name], known[f.name].type()) for f in schema.fields]
        self.targets = schema
        self.rows = max(1, size // self.header.length)

    def partitions(self) -> list[Range]:
        n = self.header.records
        return [Range(k, min(n, k + self.rows)) for k in range(0, n, self.rows)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        h, step = self.header, max(1, AT_ONCE // self.header.length)
        with open(self.path, "rb") as f:
            f.seek(h.first + partition.begin * h.length)
            for k in range(partition.begin, partition.end, step):
                n = min(step, partition.end - k)
                records = np.frombuffer(f.read(n * h.length), np.uint8).reshape(-1, h.length)
                records = records[records[:, 0] != _DELETED]
                if len(records):
                    arrays = [_column(records, field, kind, self.encoding) for field, kind in self.columns]
                    yield pa.RecordBatch.from_arrays([self._as(a, t.dataType) for a, t in zip(arrays, self.targets.fields, strict=True)], names=[t.name for t in self.targets.fields])

    @staticmethod
    def _as(a: pa.Array, kind: T.DataType) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        return a.cast(to_arrow_type(kind))


class DbfSource(DataSource):
    """Options: path; encoding (else that of a .cpg file beside it, else utf-8); rangeBytes, the bytes that a task reads."""

    @classmethod
    def name(cls) -> str:
        return "dbf"

    def _path(self) -> str:
        return self.options["path"].removeprefix("file://").removeprefix("file:")

    def _encoding(self) -> str:
        if "encoding" in self.options:
            return self.options["encoding"]
        beside = os.path.splitext(self._path())[0] + ".cpg"
        if os.path.exists(beside):
            with open(beside) as f:
                return f.read().strip() or "utf-8"
        return "utf-8"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type()) for f in header(self._path()).fields])

    def reader(self, schema: T.StructType) -> DbfReader:
        return DbfReader(self._path(), schema, self._encoding(), int(self.options.get("rangeBytes", RANGE)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DbfSource)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, range_bytes: int = RANGE, encoding: str | None = None) -> DataFrame:
    """A dBASE file's records but for deleted ones, all columns or those named, which alone are taken apart.

    Blank fields and numbers that overflow their field are null; a file without records is an empty table; a file that is cut short has
    the records that are whole.
    """
    register(spark)
    reader = spark.read.format("dbf").option("rangeBytes", range_bytes)
    if encoding:
        reader = reader.option("encoding", encoding)
    if columns is not None:
        known = {f.name: f.type() for f in header(path.removeprefix("file://").removeprefix("file:")).fields}
        missing = [c for c in columns if c not in known]
        if missing:
            raise ValueError(f"{path} has no field {', '.join(missing)}; it has {', '.join(known)}")
        reader = reader.schema(T.StructType([T.StructField(c, known[c]) for c in columns]))
    return reader.load(path)
