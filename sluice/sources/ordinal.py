"""Numbers for rows in the order of their file, without a sort or a shuffle of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(rows: DataFrame, block: str, within: str, name: str) -> DataFrame:
    """``name``: position from 1 of each row, by ``block`` and then by ``within``.

    ``within`` must rise by one from row to row of a block (as ``monotonically_increasing_id`` does in a task). Only
    one row a block, its count and its least ``within``, goes to the driver and back.
    """
    per_block = rows.groupBy(block).agg(F.count("*").alias("n"), F.min(within).alias("first")).orderBy(block).collect()
    starts, before = [], 0
    for b in per_block:
        starts.append((b[block], before - b["first"] + 1))
        before += b["n"]
    kind = rows.schema[block].dataType.simpleString()
    offsets = rows.sparkSession.createDataFrame(starts, f"`{block}` {kind}, _offset long")
    return rows.join(F.broadcast(offsets), block).withColumn(name, F.col(within) + F.col("_offset")).drop("_offset")
