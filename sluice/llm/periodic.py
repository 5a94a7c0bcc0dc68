"""Runs of periodically repeated words, by Karp-Miller-Rosenberg naming.

Level k names the stretches of 2^k words by numbers, so that two have one name if and only if they are equal: level 0
numbers the words, each next level numbers pairs of names. How far two places agree is then read off the names, from
the highest level down. Candidates lie on grids: a run of four periods p or more holds four multiples of p.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .runtime import schema_of

#: Words are separated by space, tab, line feed, vertical tab, form feed and carriage return.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has as many periods, and as many words, at least.
LEAST_PERIODS, LEAST_WORDS = 4, 6
#: Grid places looked at together.
AT_ONCE = 1 << 18


def name_levels(codes: np.ndarray) -> list[np.ndarray]:
    """Level k: a name for the 2^k words from each place on. The last level is the highest that has a name twice."""
    levels, size = [], 1
    names = codes.astype(np.int64)
    while len(names):
        found, names = np.unique(names, return_inverse=True)
        if len(found) == len(names):
            break
        levels.append(names.astype(np.int32))
        if size >= len(names):
            break
        names = names[:-size] * len(found) + names[size:]
        size *= 2
    return levels


def agree_forward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from ``i`` and from ``j`` on (``i < j``) are equal."""
    i, j = i.copy(), j.copy()
    start = j.copy()
    for k in reversed(range(len(levels))):
        names = levels[k]
        inside = np.flatnonzero(j < len(names))
        same = inside[names[i[inside]] == names[j[inside]]]
        # A level's stretch may be equal more than once only at the highest one.
        while len(same):
            i[same] += 1 << k
            j[same] += 1 << k
            if k < len(levels) - 1:
                break
            same = same[j[same] < len(names)]
            same = same[names[i[same]] == names[j[same]]]
    return j - start


def agree_backward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before ``i`` and before ``j`` (``i < j``) are equal."""
    i, j = i.copy(), j.copy()
    start = i.copy()
    for k in reversed(range(len(levels))):
        names, size = levels[k], 1 << k
        inside = np.flatnonzero(i >= size)
        same = inside[names[i[inside] - size] == names[j[inside] - size]]
        while len(same):
            i[same] -= size
            j[same] -= size
            if k < len(levels) - 1:
                break
            same = same[i[same] >= size]
            same = same[names[i[same] - size] == names[j[same] - size]]
    return start - i


def grids(n: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i = 0, p, 2p, ... with i + 3p < n, and p, for each period p up to ``most``; about ``AT_ONCE`` together."""
    p = 1
    while p <= most:
        periods, total = [], 0
        while p <= most and (not periods or total < AT_ONCE):
            periods.append(p)
            total += max(0, (n - 1) // p - 2)
            p += 1
        periods = np.array(periods, np.int64)
        counts = np.maximum(0, (n - 1) // periods - 2)
        of = np.repeat(periods, counts)
        turn = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield turn * of, of


def runs_of(codes: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), by start and period: the maximal stretches with smallest period q that have
    ``LEAST_PERIODS`` periods and ``LEAST_WORDS`` words at least.

    A run of period p holds three neighbouring periods on p's grid, and they are equal, as two names a period tell. Of
    neighbouring places where this is so, which lie in one run, the first is extended both ways. A multiple of q finds
    the same stretch, so the smallest period found for a stretch is its own.
    """
    n, levels = len(codes), name_levels(codes)
    if not levels:
        return np.zeros((0, 3), np.int64)
    # Two places p apart agree for three periods of words, which is less than two names of the highest level.
    most = min(n // LEAST_PERIODS, ((1 << len(levels)) - 1) // (LEAST_PERIODS - 1))
    found = []
    for i, p in grids(n, most):
        level = np.frexp(p)[1] - 1  # two names of it cover a period
        good = np.zeros(len(i), bool)
        for k in np.unique(level):
            own, names = np.flatnonzero(level == k), levels[k]
            for a in (i, i + p - (1 << k)):
                for b in (a + p, a + 2 * p):
                    own = own[names[a[own]] == names[b[own]]]
            good[own] = True
        first = good.copy()
        first[1:] &= ~(good[:-1] & (p[1:] == p[:-1]))
        i, p = i[first], p[first]
        start = i - agree_backward(levels, i, i + p)
        length = i + p + agree_forward(levels, i, i + p) - start
        long = length >= np.maximum(LEAST_PERIODS * p, LEAST_WORDS)
        found.append(np.stack([start, length, p], axis=1)[long])
    found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if len(found):
        fresh = np.r_[True, np.any(found[1:, :2] != found[:-1, :2], axis=1)]
        found = found[fresh]
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words stays: one that stands in a run after its first period goes."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:n]) == 0


def words_of(_: object, text: str) -> list[str]:
    return WORDS.findall(text)


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Callable[[object, str], list[str]] = words_of
) -> DataFrame:
    """``id``, ``runs`` (array of start, length, period, by start and period), ``collapsed`` (the words outside of
    repetitions, joined by one space) of each row of ``docs``.

    ``words(id, text)`` gives a text's words; by default what stands between white space. Every whole text is looked at
    in its own task; a text of n words takes n log n steps and four bytes a word and level (as many levels as the
    longest repeated stretch has binary digits). There is no shuffle.

    A null text is empty; a text without words has no runs and an empty ``collapsed``. Null and repeated ids give a row
    for each of their rows. An empty table gives an empty result. Runs may overlap and contain others; two of one period
    share less than a period. Other columns of ``docs`` are not read, so their names cannot clash.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def one(ident: object, text: str | None) -> tuple[np.ndarray, str]:
        own = words(ident, text or "")
        seen: dict[str, int] = {}
        codes = np.fromiter((seen.setdefault(w, len(seen)) for w in own), np.int64, len(own))
        if len(seen) == len(own):
            return np.zeros((0, 3), np.int64), " ".join(own)
        runs = runs_of(codes)
        if len(runs):
            own = [own[i] for i in np.flatnonzero(kept_words(len(own), runs))]
        return runs, " ".join(own)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(i.as_py(), t.as_py()) for i, t in zip(batch.column(0), batch.column(1), strict=True)]
            table = np.concatenate([np.zeros((0, 3), np.int64), *(r for r, _ in found)])
            ends = np.cumsum([0, *(len(r) for r, _ in found)]).astype(np.int32)
            runs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([batch.column(0), runs, pa.array([c for _, c in found], pa.string())], ["id", "runs", "collapsed"])

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema: StructType = schema_of(named, {"id": "id"}, "runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return named.mapInArrow(work, schema)
