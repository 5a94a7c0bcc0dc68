"""SimHash near-dedup by Golay-code fuzzy hashing."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .near_copies import near_copies, remixed, shingle_hashes
from .runtime import components, if_small, without, written
from .tokens import mapped

#: Generator polynomial of the perfect binary (23, 12) Golay code (fixed value).
GOLAY = 0xC75
#: First bit and bits of the fingerprint's three segments; the last has five bits less than a codeword.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: The most differing bits of a fingerprint that the keys below promise to find.
MOST_BITS = 5
#: Fingerprints of one key that one group compares; more are compared block by block, in groups of their own.
BLOCK = 4096


def fingerprint(text: str, words: int, width: int = 1) -> list[int]:
    """``width`` 64-bit SimHashes of the text's word shingles, as signed numbers; 0 without words."""
    return fingerprint_of(shingle_hashes(text, words), width)


def fingerprint_of(hashes: Iterable[np.ndarray], width: int = 1) -> list[int]:
    """The SimHashes of shingles whose hashes come in parts."""
    n, ones = 0, np.zeros((width, 64), np.int64)
    for h in hashes:
        n += len(h)
        for k in range(width):
            h = remixed(h) if k else h
            ones[k] += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(2 * x > n).tobytes(), "big", signed=True) for x in ones]


def fingerprints(docs: DataFrame, words: int, width: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``fp0`` ... ``fp(width - 1)`` of each row; null texts count as empty."""

    def work(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(x.as_py() or "", words, width) for x in batch.column(1)], np.int64).reshape(-1, width)
        return {"id": batch.column(0)} | {f"fp{k}": pa.array(found[:, k]) for k in range(width)}

    return mapped(docs, [id_col, text_col], StructType.fromDDL("id long, " + ", ".join(f"fp{k} long" for k in range(width))), work)


@functools.cache
def _decoder() -> tuple[list[np.ndarray], np.ndarray]:
    """Syndromes of each byte of a 23-bit word; the error pattern of each syndrome, of three bits at most."""

    def rest(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    syndromes = [np.array([rest(b << s & 0x7FFFFF) for b in range(256)], np.uint32) for s in (0, 8, 16)]
    errors = np.zeros(2048, np.uint32)
    for n in range(4):
        for bits in combinations(range(23), n):
            word = sum(1 << b for b in bits)
            errors[rest(word)] = word
    return syndromes, errors


def codewords(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    (a, b, c), errors = _decoder()
    words = words.astype(np.uint32)
    return (words ^ errors[a[words & 255] ^ b[words >> 8 & 255] ^ c[words >> 16]]) >> 11


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints, and the row each belongs to.

    A segment's keys are the codewords nearest to it and to every word one bit away: one, or up to six. Two segments
    that differ in two bits have a word one bit from both, and thus a key in common. If two fingerprints differ in
    five bits at most, no two of their three segments can differ in three bits or more; so at least two segments
    share a key, and the pair of these is a key of 24 bits.
    """
    fps = fps.view(np.uint64)
    own = []
    for first, bits in SEGMENTS:
        word = (fps >> np.uint64(64 - first - bits) & np.uint64((1 << bits) - 1)).astype(np.uint32)
        near = np.stack([codewords(word), *(codewords(word ^ np.uint32(1 << i)) for i in range(bits))], axis=1)
        near.sort(axis=1)
        new = np.concatenate([np.ones((len(fps), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
        own.append((near, new))
    keys, rows = [], []
    for k, (i, j) in enumerate(combinations(range(3), 2)):
        (a, new_a), (b, new_b) = own[i], own[j]
        row_a, at_a = np.nonzero(new_a)
        per_row = new_b.sum(axis=1)
        row_b, at_b = np.nonzero(new_b)
        first_b = np.cumsum(per_row) - per_row
        times = per_row[row_a]
        row = np.repeat(row_a, times)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        key_a = np.repeat(a[row_a, at_a], times).astype(np.int64)
        key_b = b[row_b, at_b].astype(np.int64)[first_b[row] + turn]
        keys.append(np.int64(k) << 24 | key_a << 12 | key_b)
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


class _Forest:
    """Union-find over what a task has linked so far."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        above = self.above
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.top(a), self.top(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
        return a != b


def _link(
    group: np.ndarray, half: np.ndarray, nodes: np.ndarray, fps: list[np.ndarray], bits: int, forest: _Forest, n: np.ndarray | None = None, least: float = 0
) -> list[tuple[int, int]]:
    """Join in ``forest`` what is linked inside groups (rows are sorted by group); the compared pairs that joined something.

    Rows are compared with their group's first, then rows d apart for d = 1, 2, ... until no group is that long. A row of a block pair is compared with
    rows of the other block only, unless both blocks are the same. Rows with one label are joined already. With sizes ``n``,
    the lesser of two must be ``least`` times the greater.
    """
    label, joined = np.arange(len(nodes)), []
    fps = [x.view(np.uint64) for x in fps]

    def meet(here: np.ndarray, there: np.ndarray) -> None:
        nonlocal label
        near = sum(np.bitwise_count(x[here] ^ x[there]).astype(np.int16) for x in fps) <= bits
        if n is not None:
            near &= np.minimum(n[here], n[there]) / np.maximum(n[here], n[there]) >= least
        near &= (label[here] != label[there]) & ((half[here] != half[there]) | (half[here] == 2))
        if near.any():
            a, b = here[near], there[near]
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            pairs = zip(nodes[a].tolist(), nodes[b].tolist(), strict=True)
            joined.extend((x, y) for x, y in pairs if forest.join(x, y))

    new = np.concatenate([np.ones(min(1, len(group)), bool), group[1:] != group[:-1]])
    meet(np.flatnonzero(~new), np.flatnonzero(new)[np.cumsum(new) - 1][~new])
    d, here = 1, np.arange(len(nodes) - 1)
    while len(here := here[here < len(nodes) - d]) and len(here := here[group[here] == group[here + d]]):
        meet(here, here + d)
        d += 1
    return joined


def linked(prints: DataFrame, bits: int, width: int = 1, compared: bool = False, least: float = 0) -> DataFrame:
    """Links (``a``, ``b``) that connect the ``node`` of ``prints`` whose fingerprints differ in ``bits`` or fewer.

    Each row goes to the keys of its fingerprints; those that share one are compared by all fingerprints. What comes
    out is not every pair but one row for each node that a task linked, with the smallest node it is connected to; with ``compared``
    as many pairs, which connect the same nodes and differ in ``bits`` or fewer themselves; with ``least``, of the sizes ``n`` (not 0) of a
    pair the lesser is so many times the greater. Keys shared by more than ``BLOCK``
    rows are divided into pairs of blocks, each compared in a group of its own, so that no group outgrows a task and
    no pair is lost.

    Pairs with up to ``MOST_BITS`` differing bits in any one fingerprint are found for certain; so are all pairs if
    ``bits`` is below ``width * (MOST_BITS + 1)``. Others are found where two segments of a fingerprint have few of
    the differing bits.
    """
    prints_of = [f"fp{k}" for k in range(width)]
    names = [*prints_of, "n"] if least else prints_of
    fields = ", ".join(f"{x} long" for x in names)

    def spread(batch: pa.RecordBatch) -> dict:
        columns = [x.to_numpy() for x in batch.columns]
        keys, rows = zip(*(keys_of(x) for x in columns[1 : 1 + width]), strict=True)
        key = np.concatenate([k + (np.int64(3 * i) << 24) for i, k in enumerate(keys)]).astype(np.int32)
        row = np.concatenate(rows)
        return {"key": pa.array(key), "node": pa.array(columns[0][row])} | {
            x: pa.array(c[row]) for x, c in zip(names, columns[1:], strict=True)
        }

    # Each row makes some 84 a fingerprint: spread over all tasks, however few rows there are.
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.select("node", *names).repartition(tasks)
    keys = mapped(rows, ["node", *names], StructType.fromDDL(f"key int, node long, {fields}"), spread)
    hot = if_small(keys.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK))
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    other = F.explode(F.when(F.col("rows").isNotNull(), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(0))))
    half = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") < F.col("other")).cast("int"))
    dealt = (
        keys.join(hot, "key", "left")
        .select("key", "node", *names, F.coalesce(own, F.lit(0)).alias("own"), other.alias("other"))
        # Two groups with one hash only mean a few comparisons more.
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), half.alias("half"), "node", *names)
        .repartition("group")
        .sortWithinPartitions("group", "node")  # so that the tasks pair the texts of a group of copies with the same few
    )

    def link(rows: list[np.ndarray], forest: _Forest) -> list[tuple[int, int]]:
        return _link(*rows[:3], rows[3 : 3 + width], bits, forest, rows[-1] if least else None, least)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        rest = [np.zeros(0, np.int64)] * (3 + len(names))
        joined: list[tuple[int, int]] = []

        for batch in batches:
            rows = [np.concatenate([x, y.to_numpy().astype(np.int64)]) for x, y in zip(rest, batch.columns, strict=True)]
            if not len(rows[0]):
                continue
            whole = np.searchsorted(rows[0], rows[0][-1])
            rest = [x[whole:] for x in rows]
            if whole:
                joined += link([x[:whole] for x in rows], forest)
        joined += link(rest, forest)
        pairs = np.array(joined if compared else [(x, forest.top(x)) for x in list(forest.above)], np.int64).reshape(-1, 2)
        for at in range(0, len(pairs), 10_000):
            part = pairs[at : at + 10_000]
            yield pa.RecordBatch.from_pydict({"a": pa.array(part[:, 0]), "b": pa.array(part[:, 1])})

    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = 5, bits: int = 21, width: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``fp0`` ..., ``component`` of each row of ``docs``: rows are linked if their fingerprints of ``width``
    times 64 bits differ in ``bits`` bits or fewer, and ``component`` is the smallest id reachable by links.

    ``linked`` says which pairs are found for certain. Bits only estimate a similarity; ``near_copies`` verifies it.

    A-Z are lower-cased; words are what lies between space, tab, line feed, vertical tab, form feed and carriage
    return; a text with fewer words than a shingle is one shingle; texts without words, and nulls, have fingerprint 0
    and are linked like any others. Equal fingerprints are one row from the start, so a group of copies costs as much
    as one text. Ids must be unique integers. An empty table gives an empty result; other columns are not read.
    """
    names = [f"fp{k}" for k in range(width)]
    prints = written(fingerprints(docs, words, width, id_col, text_col))
    nodes = prints.groupBy(*names).agg(F.min("id").alias("node"))
    roots = components(linked(nodes, bits, width)).withColumnRenamed("node", "linked")
    named = nodes.join(roots, nodes["node"] == roots["linked"], "left").select(
        *names, F.coalesce("root", "node").alias("component")
    )
    return prints.join(written(named), names).select("id", *names, "component")


def drop_near_duplicates(
    docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with all its columns, without the rows whose component has a smaller id: copies by SimHashes under Golay-code
    keys, verified by exact similarity, and completed where bits say too little. See ``near_copies``."""
    return without(docs, near_copies(docs, words, least, id_col, text_col).where("component <> id"), id_col)
