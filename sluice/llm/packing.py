"""Packing by minimum bin slack: each sequence gets the fullest combination that the lengths at hand allow."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import schema_of, written


def fullest(counts: dict[int, int], order: list[int], room: int) -> Counter:
    """The multiset of available lengths with the largest sum of at most ``room``.

    Bit s of ``sums`` says that s is a sum of lengths seen so far; each length enters in powers of two up to its
    count. Long ones come first, and the search ends as soon as ``room`` itself is a sum.
    """
    sums, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in order:
        left, times = min(counts[length], room // length), 1
        while left > 0 and not sums >> room & 1:
            times = min(times, left)
            steps.append((length, times, sums))
            sums |= sums << (length * times) & mask
            left -= times
            times *= 2
        if sums >> room & 1:
            break
    at, used = sums.bit_length() - 1, Counter()
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            used[length] += times
            at -= length * times
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations and how many sequences each fills, for so many pieces of each length.

    The longest length left goes into a sequence with the fullest combination for the rest of it; that combination is
    taken as often as the counts allow. Each one uses up a length or leaves less of it than one sequence takes, so
    there are a few thousand combinations at most, however many pieces there are.
    """
    left = {k: n for k, n in counts.items() if n}
    order = sorted(left, reverse=True)
    found = []
    while order:
        first = order[0]
        left[first] -= 1
        used = fullest(left, [x for x in order if x <= capacity - first and left[x]], capacity - first)
        used[first] += 1
        left[first] += 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= times * n
        order = [x for x in order if left[x]]
        found.append((dict(used), times))
    return found


def places(combinations: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces in a sequence, first sequence, offset), sorted: the n-th pieces of a length
    from ``first rank`` on go to sequences from ``first sequence`` on, so many in each, from ``offset`` in it."""
    rows, taken, sequence = [], Counter(), 0
    for used, times in combinations:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, taken[length], n, sequence, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` (from 0) and ``offset``: the place of each in a sequence of ``capacity``.

    Pieces of equal length are alike, so what is planned on the driver is one count for each length, at most
    ``capacity`` of them; the plan that goes out again has at most as many rows as combinations have lengths. Each
    piece finds its place by its rank among pieces of its length: a running number within its task, plus the counts of
    earlier tasks, which are summed per task and length. No length, however frequent, is gathered anywhere.

    Lengths must lie in 1..``capacity``; others, and nulls, raise an error. No pieces, no rows. All columns of
    ``pieces`` stay, whatever their names; those that are called ``sequence_id`` or ``offset`` are replaced. Offsets are
    gapless from 0. Pieces of equal length are interchangeable, and so are equal rows.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names, at = pieces.columns, pieces.columns.index(length_col)
    pieces = pieces.toDF(*(f"c{i}" for i in range(len(names))))  # no name clashes with those used here
    kept, length_col = pieces.columns, f"c{at}"
    same = {x: x for x in kept}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False)
            if not np.all((length >= 1) & (length <= capacity)):
                raise ValueError(f"lengths must lie in 1..{capacity}")
            length = length.astype(np.int64)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.r_[0, np.flatnonzero(np.diff(ordered)) + 1] if len(ordered) else np.zeros(0, np.int64)
            runs = np.diff(np.r_[first, len(ordered)])
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(ordered)) - np.repeat(first, runs) + seen[ordered]
            seen[ordered[first]] += runs
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(length), task, np.int32)), pa.array(rank)], [*kept, "_task", "_rank"]
            )

    # Pieces are a few numbers each; written first, so that no task holds two Python workers.
    rows = written(written(pieces).mapInArrow(number, schema_of(pieces, same, "_task int, _rank long")))
    per_task = rows.groupBy("_task", length_col).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(length_col).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = {r[0]: r[1] for r in per_task.groupBy(length_col).agg(F.sum("_n")).collect()}
    table = places(plan(counts, capacity))
    sent = pieces.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at, len(kept)))
            row = table[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            turn, slot = np.divmod(rank - row[:, 1], row[:, 2])
            new = [pa.array(row[:, 3] + turn), pa.array(row[:, 4] + slot * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], [*kept, "sequence_id", "offset"])

    ranked = rows.join(first.drop("_n"), ["_task", length_col]).select(*kept, (F.col("_rank") + F.col("_first")).alias("_rank"))
    return ranked.mapInArrow(place, schema_of(pieces, same, "sequence_id long, offset long")).toDF(*names, "sequence_id", "offset")
