"""Fixed-width records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import checked_values, error, first_of
from ..plans.spec import TableSpec
from ..sinks.ordered import resolved
from . import ranges
from .layout import Field
from .text import ShortInput


def sizes_of(spark: SparkSession, path: str | list[str]) -> list[tuple[str, int]]:
    """Files and their bytes: a file, those of a folder by name, or a list of files."""
    found = []
    for p in [path] if isinstance(path, str) else path:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found += sorted((str(s.getPath().toString()), s.getLen()) for s in fs.listStatus(place) if s.isFile() and s.getPath().getName()[0] not in "._")
    return found


def read_records(
    spark: SparkSession, path: str | list[str], stride: int, skip: int = 0, fields: list[Field] | None = None, encoding: str | None = None
) -> DataFrame:
    """``rec_no`` (from 1, after ``skip`` records), ``raw`` (binary), and ``decoded`` ones of ``fields``, if given.

    Files are read by byte ranges of whole records (``ranges``), so their numbers are known from the start. A partial
    record at the end of a file is left out.
    """
    files = [(resolved(spark, f), n // stride) for f, n in sizes_of(spark, path)]
    if sum(n for _, n in files) < skip:
        raise ShortInput(f"cannot skip {skip} records: the input has {sum(n for _, n in files)}")
    return ranges.read(spark, files, stride, skip, fields or [], encoding)


def text_of(data: Column, f: Field) -> Column:
    """Text up to the first NUL; null if it equals NULLIF (which is empty if not given); CHAR loses blanks at its end."""
    upto = F.substring_index(F.decode(data, "ISO-8859-1"), "\0", 1)
    own = F.encode(upto, "ISO-8859-1")
    text = F.when(F.is_valid_utf8(own.cast("string")), own.cast("string"))
    text = F.rtrim(text) if f.kind == "CHAR" else text
    null = F.lit(f.nullif or b"")
    return F.when(own != null, text)


def valid_text(data: Column) -> Column:
    upto = F.substring_index(F.decode(data, "ISO-8859-1"), "\0", 1)
    return F.is_valid_utf8(F.encode(upto, "ISO-8859-1").cast("string"))


def wrapped(value: Column, kind: str) -> Column:
    """A number as an integer of fewer bits, as C casts it."""
    bits = {"smallint": 16, "int": 32}[kind]
    low = F.pmod(value.cast("bigint"), F.lit(1 << bits))
    return F.when(low >= 1 << (bits - 1), low - (1 << bits)).otherwise(low).cast(kind)


def number_as(value: Column, f: Field, target: str) -> Column:
    """A number of the file as the target's type."""
    order = ("smallint", "int", "bigint")
    if f.code in ("f4", "f8"):
        if target in order:
            whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
            return wrapped(whole, target) if target != "bigint" else whole.cast("bigint")
        if target.startswith("decimal"):
            return _rounded(value, 6 if f.code == "f4" else 15).try_cast(target)
        return F.format_string("%f", value.cast("double")) if target == "string" else value.cast(target)
    if target in order and order.index(target) < order.index(f.spark_type):
        return wrapped(value, target)
    return value.cast(target)


def _rounded(value: Column, digits: int) -> Column:
    """The value's text with so many significant digits."""
    v = value.cast("double")
    shift = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, v).otherwise(F.round(v * shift) / shift).cast("string")


def convert_fields(
    records: DataFrame, fields: list[Field], spec: TableSpec, defaults: dict | None = None
) -> DataFrame:
    """``rec_no``, ``raw``, ``err`` and the columns of ``spec`` from records read with ``fields``, one field each; trailing
    ones without a field take their value in ``defaults``."""
    missing = spec.columns[len(fields) :]
    if len(fields) > len(spec.columns) or any(c.name not in (defaults or {}) for c in missing):
        raise ValueError(f"{len(fields)} COL for {len(spec.columns)} columns")
    plain = lambda f, c: f.code and (c.spark_type in ("smallint", "int", "bigint", "float", "double") or c.base in ("numeric", "decimal"))
    pairs = list(zip(fields, spec.columns, strict=False))
    # Texts are columns of their own: each is looked at several times, and Spark computes columns once.
    texts, wrong = [], []
    for i, (f, c) in enumerate(pairs):
        own = F.col(f"f{i}")
        texts.append((F.lit(None).cast("string") if plain(f, c) else number_as(own, f, "string") if f.code else text_of(own, f)).alias(f"_t{i}"))
        wrong.append((F.lit(False) if f.code else ~valid_text(own)).alias(f"_w{i}"))
    rows = records.select("*", *texts, *wrong)
    rows, values, faults = checked_values(rows, TableSpec(tuple(c for _, c in pairs)))
    columns, errors = [], []
    for i, (f, c) in enumerate(pairs):
        if plain(f, c):
            columns.append(number_as(F.col(f"f{i}"), f, c.spark_type).alias(c.name))
            continue
        errors += [F.when(F.col(f"_w{i}"), error("encoding", i + 1, c.name)), faults[i]]
        columns.append(values[i].alias(c.name))
    columns += [F.lit(defaults[c.name]).cast(c.spark_type).alias(c.name) for c in missing]
    return rows.select("rec_no", "raw", first_of(errors).alias("err"), *columns)
