"""Bytes of a declared encoding to text."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Names of encodings and Python's names for them (fixed values).
ENCODINGS = {
    "utf8": "utf-8", "unicode": "utf-8", "euc_jp": "euc_jp", "eucjp": "euc_jp", "sjis": "shift_jis", "shift_jis": "shift_jis",
    "latin1": "latin-1", "iso88591": "latin-1", "latin9": "iso8859-15", "win1252": "cp1252", "win1251": "cp1251",
    "koi8r": "koi8-r", "euc_kr": "euc_kr", "euckr": "euc_kr", "euc_cn": "gb2312", "gbk": "gbk", "big5": "big5", "sql_ascii": "ascii",
}


def encoding_named(name: str) -> str:
    key = name.strip().lower().replace("-", "")
    found = ENCODINGS.get(key) or ENCODINGS.get(key.replace("_", ""))
    if not found:
        raise ValueError(f"invalid encoding {name!r}")
    codecs.lookup(found)
    return found


def valid(data: Column) -> Column:
    """Whether bytes are UTF-8: all that is checked where file and table have the same encoding."""
    return F.is_valid_utf8(data.cast("string"))


def decoded(rows: DataFrame, encoding: str, column: str = "raw") -> DataFrame:
    """``rows`` with ``text`` for the bytes in ``column``; null where they are malformed, which rejects the row."""
    name = encoding_named(encoding)
    if name == "utf-8":
        return rows.withColumn("text", F.when(valid(F.col(column)), F.col(column).cast("string")))
    at, names = rows.columns.index(column), rows.columns

    def text(data: bytes | None) -> str | None:
        try:
            return None if data is None else data.decode(name)
        except UnicodeDecodeError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([text(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], [*names, "text"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("text", StringType())]))
