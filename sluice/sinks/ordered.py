"""Bytes of rows as one file in the order of the rows, written by tasks.

Rows are dealt to range partitions in order, and each task joins its rows' bytes to chunks, which it knows the place of
inside its partition. One number a partition, its bytes, goes to the driver, and the sums of these go back: then each chunk has its place in the file.
Tasks write chunks there, into one file, if all see a file system of files that can be written anywhere (``file:``); in other
stores, where objects are written from their beginning only, the output is a folder of parts, in order by name, that the readers
of this package take like the file. A chunk that is written again, by a task that is run again, has the same bytes at the same place.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import written
from .table import file_system


def resolved(spark: SparkSession, path: str) -> str:
    """The path as tasks in Python can open it: with its scheme, and what a mount table makes of it."""
    fs, place = file_system(spark, path)
    whole = fs.makeQualified(place)
    try:  # the nearest folder that exists
        parent = whole
        while parent.getParent() is not None and not fs.exists(parent):
            parent = parent.getParent()
        rest = str(whole.toString())[len(str(parent.toString())) :]
        return str(fs.resolvePath(parent).toString()).rstrip("/") + ("/" + rest.lstrip("/") if rest else "")
    except Exception:
        return str(whole.toString())


def local_name(path: str) -> str | None:
    """The file's name, for a path of scheme ``file``."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else None


def write_lines(rows: DataFrame, order: str, path: str) -> int:
    """Write column ``data`` (binary) of ``rows`` by ``order``; how many rows there were. Without rows nothing is written."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([len(data)]), pa.array([b"".join(data)], pa.binary())], ["n", "data"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(tasks, order).sortWithinPartitions(order).select("data")
    return write_chunks(ordered.mapInArrow(join, "n long, data binary"), path)


def write_chunks(chunks: DataFrame, path: str) -> int:
    """Write column ``data`` of ``chunks``, which have ``n`` records each and come by partition in order; how many records there were."""
    spark = chunks.sparkSession

    # Places are sums of sizes, which Spark adds up without the bytes: no task runs a second Python worker for them.
    staged = written(chunks.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("within"), "n", "data"))
    before = Window.partitionBy("part").orderBy("within").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("size").over(before), F.lit(0))
    placed = written(staged.select("part", "within", "n", F.octet_length("data").cast("long").alias("size")).select("*", at.alias("at")))
    sizes = placed.groupBy("part").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).orderBy("part").collect()
    total = sum(r["n"] for r in sizes)
    if not total:
        return 0
    starts, before = {}, 0
    for r in sizes:
        starts[r["part"]], before = before, before + r["size"]
    target = resolved(spark, path)
    fs, final = file_system(spark, path)
    fs.mkdirs(final.getParent())
    name = local_name(target)
    if name:
        with open(f"{name}.tmp", "wb") as file:
            file.truncate(before)
    sent = spark.sparkContext.broadcast(starts)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = os.open(f"{name}.tmp", os.O_WRONLY) if name else None
        try:
            for batch in batches:
                for part, at, data in zip(*batch.columns, strict=True):
                    at, data = at.as_py() + sent.value[part.as_py()], memoryview(data.as_buffer())
                    if file is not None:
                        while data:
                            done = os.pwrite(file, data, at)
                            data, at = data[done:], at + done
                    else:
                        from pyarrow import fs as stores

                        store, base = stores.FileSystem.from_uri(target)
                        store.create_dir(base, recursive=True)
                        with store.open_output_stream(f"{base}/part-{at:020d}") as out:
                            out.write(data)
        finally:
            if file is not None:
                os.fsync(file)
                os.close(file)
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], ["done"])

    # One row a chunk: three numbers for some megabytes at most.
    chunked = staged.select("within", "data").join(F.broadcast(placed.select("within", "part", "at")), "within")
    chunked.select("part", "at", "data").mapInArrow(put, "done int").agg(F.sum("done")).collect()
    if name:
        os.replace(f"{name}.tmp", name)
    return total
