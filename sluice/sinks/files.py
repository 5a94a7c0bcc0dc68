"""Reject files and the log."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ordinal import numbered
from .ordered import write_lines
from .table import plain_files


def write_rejects(rows: DataFrame, path: str, binary: bool = False) -> int:
    """The records' original bytes in order; text ones end with a line feed. Without rejects there is no file.

    Tasks write: see ``ordered``.
    """
    data = F.coalesce(F.col("raw").cast("binary"), F.lit(b""))
    return write_lines(rows.select("rec_no", (data if binary else F.concat(data, F.lit(b"\n"))).alias("data")), "rec_no", path)


def messages(rejects: DataFrame, skip: int) -> DataFrame:
    """``n``, ``message`` of each reject, by the order of its record."""
    ordered = rejects.orderBy("rec_no").withColumn("_b", F.spark_partition_id()).withColumn("_w", F.monotonically_increasing_id())
    column = F.coalesce(F.concat(F.lit(", column "), F.col("err.col").cast("string")), F.lit(""))
    text = F.concat(F.lit("record "), F.col("n"), F.lit(", input record "), F.col("rec_no") + skip, column, F.lit(": "), F.col("err.code"), F.lit(" "), F.col("err.msg"))
    return numbered(ordered, "_b", "_w", "n").select("n", text.alias("message"))


def write_log(spark: SparkSession, path: str, before: str, said: DataFrame | None, after: str, verbose: bool) -> None:
    """Append options, messages (``n``, ``message``) and counters; ``verbose`` says them on standard error as well.

    Messages are streamed, a partition at a time. A store that can't append gets the whole log written anew.
    """
    fs, place = plain_files(spark, path)
    old = None
    fs.mkdirs(place.getParent())
    if fs.exists(place):
        try:
            out = fs.append(place)
        except Exception:  # many stores
            _, old = plain_files(spark, f"{path}.old")
            fs.delete(old, False)
            fs.rename(place, old)
            out = fs.create(place, True)
    else:
        out = fs.create(place, True)
    try:
        if old:
            stream = fs.open(old)
            try:
                spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out)
            finally:
                stream.close()
        out.write(bytearray(before, "utf-8"))
        for row in said.orderBy("n").select("message").toLocalIterator() if said is not None else ():
            out.write(bytearray(f"{row[0]}\n", "utf-8"))
            if verbose:
                print(row[0], file=sys.stderr)
        out.write(bytearray(after, "utf-8"))
    finally:
        out.close()
    if old:
        fs.delete(old, False)
    if verbose:
        print(after, file=sys.stderr, end="")
