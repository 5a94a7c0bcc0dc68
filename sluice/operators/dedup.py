"""Unique keys: which of the rows with one key stays, one key after the other."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import TableSpec, UniqueKey
from ..workspace import written


@dataclass
class Deduplicated:
    """What stays, and what was removed: both with ``is_new``, ``seq`` and the table's columns."""

    kept: DataFrame
    removed: DataFrame


def _compared(key: UniqueKey, names: list[Column]) -> Column:
    """Whether a row takes part: the predicate holds, and no part of the key is null unless nulls are alike."""
    found = F.coalesce(F.expr(key.where), F.lit(False)) if key.where else F.lit(True)
    if key.nulls_distinct:
        found = reduce(lambda a, b: a & b, (x.isNotNull() for x in names), found)
    return found


def deduplicate(new: DataFrame, existing: DataFrame | None, spec: TableSpec, keep: str = "NEW", more: tuple[str, ...] = ()) -> Deduplicated:
    """``new`` has ``rec_no`` and the columns of ``spec``; ``existing`` has the columns, and is free of duplicates.
    Columns named in ``more`` go along with the rows of both.

    Of new rows with one key the first record stays, always; ``keep`` decides between it and the existing row. Keys
    are enforced in order, and a row that an earlier key removed no longer counts. A key that many rows share is no large
    group for the aggregate; while repeated keys are too many to broadcast, its rows meet in one task of the join, unless adaptive
    execution divides them. ``new`` is read twice for each key, so it should be cheap or written.
    """
    own = [F.col(f"`{c}`") for c in (*spec.names, *more)]
    rows = new.select(F.lit(1).alias("is_new"), F.col("rec_no").alias("seq"), *own)
    if existing is not None:
        rows = rows.unionByName(existing.select(F.lit(0).alias("is_new"), F.lit(0).cast("long").alias("seq"), *own))
    removed = []
    for key in spec.unique:
        names = [F.expr(x) for x in key.expressions]
        taking = _compared(key, names)
        rank = F.struct((-F.col("is_new") if keep == "NEW" else F.col("is_new")).alias("a"), "seq")
        parts = [f"_k{i}" for i in range(len(names))]
        keyed = rows.withColumns({"_take": taking} | dict(zip(parts, names, strict=True)))
        # Ranks of each key combine before the shuffle. Only keys of more than one row, written once, are joined back: where
        # they are few, Spark broadcasts them and the rows themselves are never shuffled.
        best = keyed.where("_take").groupBy(*parts).agg(F.min(rank).alias("_best"), F.count("*").alias("_n"))
        best = written(best.where("_n > 1").select(*(F.col(x).alias(f"b{x}") for x in parts), "_best"))
        same = reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(f"b{x}")) for x in parts), F.col("_take"))
        marked = keyed.join(best, same, "left").withColumn("_stays", F.col("_best").isNull() | (rank == F.col("_best")))
        plain = ["is_new", "seq", *own]
        removed.append(marked.where(~F.col("_stays")).select(*plain))
        rows = marked.where("_stays").select(*plain)
    gone = reduce(DataFrame.unionByName, removed) if removed else rows.where("false")
    return Deduplicated(rows, gone)
