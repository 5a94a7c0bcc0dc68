"""Shards that all have the mixture of the whole: proportional stratified interleaving."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import written

#: Bits of a drawn number: 15 hexadecimal digits of a hash.
BITS = 60


def drawn(seed: int, *values: Column) -> Column:
    """A number in 0..2^60 - 1 for seed and values; a null differs from every text of digits or letters."""
    parts = [F.coalesce(v.cast("string"), F.lit("\x00")) for v in values]
    text = F.concat_ws(":", F.lit(str(seed)), *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def interleaved(
    docs: DataFrame, shards: int, strata_col: str = "source", id_col: str = "doc_id", seed: int = 13, more: dict[str, Column] | None = None
) -> DataFrame:
    """``id``, the columns of ``more``, ``position`` (in the whole order), ``shard``, ``slot`` (place in its shard) of each row.

    Rows of a stratum are ordered by a number drawn from ``seed`` and id; the one with rank r of n has the fractional
    rank (r + phase) / n, with a phase from 0 to 1 drawn for the stratum, so that small strata don't all meet in one
    place. Sorted by fractional rank, every stretch of the order has each stratum's share of rows within one, and it is
    cut into ``shards`` parts whose row counts are at most one apart.

    Only ids, draws and ``more`` are shuffled, twice: ranks and positions are numbers of rows in earlier cells plus the
    place in the row's own cell. There are about as many cells as the square root of the number of rows, each as large;
    cells are even since draws and fractional ranks are, whatever the strata. So a stratum with a third of all rows is
    spread as evenly as all others, and no list of cells is longer than a cell.

    A null stratum is a stratum. Rows of one id are ordered by the columns of ``more``; null ids are an id. Rows that are equal in
    all of these are interchangeable. An empty table gives no rows; shards may be empty if rows are fewer. Texts that are
    equal may go to different shards. ``docs`` may have columns of any other names.
    """
    more = more or {}
    phase, draw = drawn(seed, F.lit("phase"), F.col(strata_col)), drawn(seed, F.lit("row"), F.col(id_col))
    kept = [F.col(f"_m{i}") for i in range(len(more))]
    rows = docs.select(F.col(id_col).alias("id"), phase.alias("phase"), draw.alias("draw"), *(c.alias(f"_m{i}") for i, c in enumerate(more.values())))
    rows = written(rows)
    n = rows.count()
    bits = max(0, math.ceil(math.log2(max(1, n)) / 2))
    rows = rows.withColumn("cell", F.shiftright("draw", BITS - bits))
    ties = [F.col("draw"), F.col("id"), *kept]

    counts = rows.groupBy("phase", "cell").agg(F.count("*").alias("n_cell"))
    stratum = Window.partitionBy("phase")
    before = F.coalesce(F.sum("n_cell").over(stratum.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("phase", "cell", before.alias("before"), F.sum("n_cell").over(stratum).alias("n_all"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("phase", "cell").orderBy(*ties)) - 1
    ranked = rows.join(counts, ["phase", "cell"]).select("id", "phase", "draw", *kept, ((rank + F.col("phase") / float(1 << BITS)) / F.col("n_all")).alias("part"))
    cell = F.least(F.floor(F.col("part") * float(1 << bits)), F.lit((1 << bits) - 1))
    ranked = written(ranked.withColumn("cell", cell))

    counts = ranked.groupBy("cell").agg(F.count("*").alias("n_cell"))
    before = F.coalesce(F.sum("n_cell").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("cell", before.alias("before"))
    position = F.col("before") + F.row_number().over(Window.partitionBy("cell").orderBy("part", "phase", *ties)) - 1
    placed = ranked.join(counts, "cell").withColumn("position", position)
    placed = placed.withColumn("shard", F.expr(f"cast(position * {shards} div {max(1, n)} as int)"))
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return placed.select(
        "id", *(F.col(f"_m{i}").alias(x) for i, x in enumerate(more)), "position", "shard", (F.col("position") - first).alias("slot")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, rows_per_file: int = 1_000_000, id_col: str = "doc_id") -> None:
    """Write whole rows of ``docs`` as Parquet folders ``shard=0``, ``shard=1``, ..., each file a stretch of slots in order.

    ``placed`` is what ``interleaved`` returned for ``docs``; ids must be unique and not null. Rows are joined to their
    places by one shuffle, and dealt by shard and slot, so that a file has about ``rows_per_file`` rows however large a
    shard is. ``shard`` and ``slot`` are taken as column names.
    """
    places = placed.select(F.col("id").alias(id_col), "position", "shard", "slot")
    files = max(1, math.ceil(places.count() / rows_per_file))
    rows = docs.join(places, id_col).repartitionByRange(files, "position").sortWithinPartitions("position")
    rows.select(*docs.columns, "slot", "shard").write.partitionBy("shard").parquet(path)
