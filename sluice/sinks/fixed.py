"""Fixed-width files: checks, encoding and a control file that reads them back."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checks import error
from ..sources.layout import Field, spelled
from .ordered import write_chunks
from .table import file_system, plain_files


def check_output(rows: DataFrame, names: list[str], fields: list[Field]) -> DataFrame:
    """Adds to ``err``: null without NULLIF, text that is too long, numbers beyond their type."""
    errors = [F.col("err")]
    for i, (name, f) in enumerate(zip(names, fields, strict=True)):
        own = F.col(f"`{name}`")
        if f.nullif is None:
            errors.append(F.when(own.isNull(), error("not_null", i + 1, name)))
        if not f.code:
            errors.append(F.when(F.octet_length(own.cast("string")) > f.length, error("length", i + 1, name)))
        elif f.code[0] in "iu":
            bits = 8 * f.length
            low, high = (0, 2**bits - 1) if f.code[0] == "u" else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
            value = own.try_cast("decimal(38,0)")
            errors.append(F.when(own.isNotNull() & (value.isNull() | (value < low) | (value > high)), error("range", i + 1, name)))
        elif f.code == "f4":
            errors.append(F.when(F.abs(own.cast("double")) > 3.4028235677973366e38, error("range", i + 1, name)))
    return rows.withColumn("err", F.coalesce(*errors))


def encoded(batch: pa.RecordBatch, fields: list[Field]) -> bytes:
    """The batch's rows, one column a field, as records without gaps."""
    kind = np.dtype([(f"f{i}", ("<" + f.code) if f.code else f"S{f.length}") for i, f in enumerate(fields)])
    rows = np.zeros(batch.num_rows, kind)
    view = rows.view(np.uint8).reshape(batch.num_rows, kind.itemsize)
    for i, f in enumerate(fields):
        column = batch.column(i)
        if f.code:
            rows[f"f{i}"] = column.fill_null(0).to_numpy(zero_copy_only=False)
        else:
            rows[f"f{i}"] = [(x or "").encode().ljust(f.length) for x in column.to_pylist()]
        if column.null_count:
            at = kind.fields[f"f{i}"][1]
            null = column.is_null().to_numpy(zero_copy_only=False)
            view[null, at : at + f.length] = np.frombuffer(f.nullif.ljust(f.length, b" " if not f.code else b"\0"), np.uint8)
    return rows.tobytes()


def must_not_exist(spark: SparkSession, path: str) -> None:
    if not (os.path.isabs(path) or "://" in path or path.startswith("file:")):
        raise ValueError("the output path must be absolute")
    for p in (path, f"{path}.ctl"):
        fs, place = file_system(spark, p)
        if fs.exists(place):
            raise FileExistsError(p)


def chunks(rows: DataFrame, names: list[str], fields: list[Field]) -> DataFrame:
    """``n``, ``data``: rows in order of ``rec_no`` as records, a batch of them in one value."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [f.spark_type for f in fields]
    chosen = rows.repartitionByRange(tasks, "rec_no").sortWithinPartitions("rec_no")
    chosen = chosen.select(*(F.col(f"`{n}`").cast(k).alias(f"f{i}") for i, (n, k) in enumerate(zip(names, kinds, strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([encoded(batch, fields)], pa.binary())], ["n", "data"])

    return chosen.mapInArrow(run, "n long, data binary")


def write_fixed(rows: DataFrame, names: list[str], fields: list[Field], path: str) -> int:
    """Write good rows, in order of ``rec_no``, and, if there are any, their control file ``path.ctl``; how many there are.

    Tasks write the records, each at its place (``ordered``); no record goes through the driver.
    """
    spark = rows.sparkSession
    must_not_exist(spark, path)
    total = write_chunks(chunks(rows, names, fields), path)
    if total:
        lines = [f"INPUT = {path}", "TYPE = BINARY", f"STRIDE = {sum(f.length for f in fields)}", *(f"COL = {spelled(f)}" for f in fields)]
        fs, place = plain_files(spark, f"{path}.ctl")
        out = fs.create(place, False)
        try:
            out.write(bytearray("".join(f"{x}\n" for x in lines), "utf-8"))
        finally:
            out.close()
    return total
