"""How far a load reads: a limit of good rows, and a cap of rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.options import INFINITE

BUCKET = 65536


def last_record(rows: DataFrame, limit: int, cap: int, bucket: int = BUCKET) -> int:
    """The last record that is processed; all are, if neither bound is met.

    A record is processed if fewer than ``limit`` good ones come before it and no more than ``cap`` bad ones do. Counts
    per bucket of record numbers show the bucket in which reading stops; only that one is looked into.
    """
    if limit == INFINITE and cap == INFINITE:
        return INFINITE
    if limit == 0:
        return 0
    flags = rows.select("rec_no", F.col("err").isNull().cast("long").alias("good"))
    flags = flags.withColumn("b", F.floor(F.col("rec_no") / bucket))
    per = flags.groupBy("b").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    sums = per.select("b", "good", "bad", F.sum("good").over(upto).alias("goods"), F.sum("bad").over(upto).alias("bads"))
    met = sums.where((F.col("goods") >= limit) | (F.col("bads") > cap)).orderBy("b").limit(1).collect()
    if not met:
        return INFINITE
    b, good, bad = met[0]["b"], met[0]["goods"] - met[0]["good"], met[0]["bads"] - met[0]["bad"]
    inside = Window.orderBy("rec_no").rowsBetween(Window.unboundedPreceding, 0)
    stop = (
        flags.where(F.col("b") == b)
        .select("rec_no", (F.sum("good").over(inside) + good).alias("g"), (F.sum(1 - F.col("good")).over(inside) + bad).alias("x"))
        .where((F.col("g") >= limit) | (F.col("x") > cap))
        .agg(F.min("rec_no"))
    )
    return stop.first()[0]
