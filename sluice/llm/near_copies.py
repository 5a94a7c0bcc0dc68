"""Near copies by exact Jaccard similarity of shingle sets: SimHashes under Golay-code keys (``simhash``) find and link most
of them, MinHash bands say which other pairs are looked at, since bits alone lose some."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .runtime import components, if_small, written
from .tokens import mapped

#: Bands of a text and least hashes of each. A pair of similarity s shares no band with probability (1 - s ** ROWS) ** BANDS:
#: 0.00007 at 0.80, 0.0000003 at 0.85.
BANDS, ROWS = 24, 5
#: Rounds that compare each group's texts with one of them only, before all pairs not linked by then are compared.
STARS = 3
#: Texts of one band that are compared in one group; more are compared block by block.
BLOCK = 1024
#: A set's shingles are counted in so many bins. The lesser counts of two sets, added up, are no less than what they have in common.
BINS = 512
#: Groups that the pairs of one text are dealt to, so that no text gathers all its pairs in a task.
SLOTS = 256
SHINGLES_AT_ONCE = 1 << 15
#: Texts whose SimHashes share a Golay-code key and differ in so many bits of 64 are compared by their shingles: at a
#: similarity of 0.8 the mean is 10 (sets of one size), unrelated texts differ in 32.
PRINT_BITS = 14
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_TURNS = np.random.default_rng(42).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """Hashes of the text's word shingles in order, ``SHINGLES_AT_ONCE`` at a time; none without words."""
    found = text.encode().translate(_LOWER).split()
    if not found:
        return
    n = max(1, len(found) - words + 1)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:n].tolist()
    ends = ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLES_AT_ONCE):
        pairs = zip(starts[at : at + SHINGLES_AT_ONCE], ends[at : at + SHINGLES_AT_ONCE], strict=True)
        yield np.array([digest(joined[a:b], 42) for a, b in pairs], np.uint64)


def remixed(h: np.ndarray) -> np.ndarray:
    """Further independent hashes from hashes (constants: fixed values of a known 64-bit finaliser)."""
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return h ^ h >> np.uint64(31)


def shingle_set(text: str, words: int) -> np.ndarray:
    """The hashes of the text's distinct word shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least of each of ``BANDS * ROWS`` hashes of a set (constants: fixed values of a known 32-bit finaliser)."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    for at in range(0, len(h), 2048):
        x = (h[at : at + 2048] ^ _TURNS[0]) * (_TURNS[1] | np.uint32(1))
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of least hashes."""
    least = least.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), least.shape[:2])
    for k in range(ROWS):
        keys = remixed(remixed(keys) ^ least[:, :, k])
    return keys.view(np.int64)


def _sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``same`` (equal for equal shingle sets), ``n`` (distinct shingles), ``fp0`` (SimHash), ``keys`` of each row."""
    from .simhash import fingerprint_of

    def work(batch: pa.RecordBatch) -> dict:
        sets, prints = [], []
        for x in batch.column(1):
            hashes = list(shingle_hashes(x.as_py() or "", words))
            sets.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes])))
            prints += fingerprint_of(hashes)
        keys = band_keys(np.array([least_hashes(x) for x in sets], np.uint32)) if sets else np.zeros(0, np.int64)
        return {
            "id": batch.column(0),
            "same": pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
            "n": pa.array([len(x) for x in sets], pa.int64()),
            "fp0": pa.array(prints, pa.int64()),
            "keys": pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, pa.array(keys.reshape(-1))),
        }

    return mapped(docs, [id_col, text_col], StructType.fromDDL("id long, same binary, n long, fp0 long, keys array<long>"), work)


def _bins(shingles: np.ndarray) -> bytes:
    """How many shingles lie in each bin; 255 stands for 255 and more."""
    return np.minimum(np.bincount(shingles.view(np.uint64) >> np.uint64(55), minlength=BINS), 255).astype(np.uint8).tobytes()


def _sets(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``node``, ``shingles``, ``bins`` of each row."""

    def work(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(x.as_py() or "", words).view(np.int64) for x in batch.column(1)]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        shingles = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets or [np.zeros(0, np.int64)])))
        return {"node": batch.column(0), "shingles": shingles, "bins": pa.array([_bins(x) for x in sets], pa.binary())}

    return mapped(docs, [id_col, text_col], StructType.fromDDL("node long, shingles array<long>, bins binary"), work)


def possible_pairs(half: np.ndarray, node: np.ndarray, n: np.ndarray, root: np.ndarray, bins: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(a node, nodes that may be ``least`` similar to it) among rows of a group that are not linked yet.

    Rows with ``half`` 2 are compared with each other, those with 1 with those with 0. Sizes and bins bound a similarity
    from above, so no pair that is ``least`` similar is left out.
    """
    counts = bins if bins.max(initial=0) < 255 else np.where(bins == 255, np.int32(1 << 20), bins.astype(np.int32))
    for i in np.flatnonzero(half):
        j = np.flatnonzero(half == 0) if half[i] == 1 else i + 1 + np.flatnonzero(half[i + 1 :] == 2)
        j = j[(root[j] != root[i]) & (np.minimum(n[j], n[i]) >= least * np.maximum(n[j], n[i]) - 1e-9)]
        if len(j):
            common = np.minimum(counts[j], counts[i]).sum(axis=1, dtype=np.int64)
            j = j[common * (1 + least) >= least * (n[j] + n[i]) - 1e-9]
        if len(j):
            yield int(node[i]), node[j]


def _paired(rows: DataFrame, least: float) -> DataFrame:
    """``a``, ``b`` of ``possible_pairs`` among rows (``key``, ``size``, ``node``, ``n``, ``root``, ``bins``) that share a key.

    A key with more than ``BLOCK`` rows is divided into pairs of blocks, so that no group outgrows a task.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    half = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") < F.col("other")).cast("int")).cast("long")
    dealt = rows.select("*", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    group = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    # Two groups with one hash only mean a few comparisons more.
    dealt = dealt.select(group.alias("group"), half.alias("half"), "node", "n", "root", "bins").repartition("group").sortWithinPartitions("group")

    def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = [table.column(i).to_numpy() for i in range(5)]
        bins = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint8).reshape(-1, BINS)
        cuts = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), len(bins)]
        left, right = [], []
        for at, end in zip(cuts, cuts[1:], strict=False):
            for node, others in possible_pairs(*(c[at:end] for c in columns[1:]), bins[at:end], least):
                left.append(np.full(len(others), node))
                right.append(others)
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups; the last one of a batch may go on in the next."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not len(table):
                continue
            group = table.column(0).to_numpy()
            whole = int(np.flatnonzero(group != group[-1])[-1]) + 1 if group[0] != group[-1] else 0
            if whole:
                yield from told(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None and len(rest):
            yield from told(rest)

    return dealt.mapInArrow(compare, "a long, b long")


def _alike(a: Column, b: Column, least: float) -> Column:
    """Whether sets of two sizes can be ``least`` similar."""
    return F.least(a, b) / F.greatest(a, b) >= least


def _with_set(pairs: DataFrame, sets: DataFrame, side: str, other: str) -> DataFrame:
    """``pairs`` with the shingles of one side, in ``SLOTS`` groups at most for each text."""
    dealt = pairs.withColumn("slot", F.pmod(F.xxhash64(other), F.lit(SLOTS)))
    own = sets.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}"))
    return dealt.join(dealt.select(side, "slot").distinct().join(own, side), [side, "slot"]).drop("slot")


def _print_pairs(prints: DataFrame, least: float) -> DataFrame:
    """``a``, ``b`` of nodes of ``prints`` (``node``, ``n``, ``fp0``) whose SimHashes are alike and whose sets can be, as many as it takes to connect them.

    Nodes with one fingerprint are paired with the smallest of them, which alone goes to the keys.
    """
    from .simhash import linked

    firsts = prints.groupBy("fp0").agg(F.min(F.struct("node", "n")).alias("one"), F.count("*").alias("size"))
    firsts = written(firsts.select("fp0", F.col("one.node").alias("a"), F.col("one.n").alias("n_a"), "size"))
    equal = prints.join(firsts.where("size > 1"), "fp0").where((F.col("node") != F.col("a")) & _alike(F.col("n"), F.col("n_a"), least))
    alike = linked(firsts.select(F.col("a").alias("node"), "fp0", F.col("n_a").alias("n")), PRINT_BITS, compared=True, least=least)
    pairs = equal.select("a", F.col("node").alias("b")).unionByName(alike)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose sets have a Jaccard similarity of ``least`` or more."""
    both = _with_set(_with_set(pairs, sets, "a", "b"), sets, "b", "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(common / (F.size("set_a") + F.size("set_b") - common) >= least).select("a", "b")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) that ``roots`` (``node``, ``root``) don't join yet."""
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def near_copies(
    docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``component`` of each row of ``docs``: rows are linked if their sets of ``words``-word shingles have a
    Jaccard similarity of ``least`` or more, and ``component`` is the smallest id reachable by links.

    Texts with equal sets are one row from the start. Others are linked first by the method of ``simhash``: texts whose
    SimHashes share a Golay-code key and differ in ``PRINT_BITS`` or fewer are compared by all their shingles, each with one, then
    those that this leaves apart. Bits only estimate a similarity, so further pairs are looked at: two sets that share a band (``BANDS`` says how surely) are
    compared likewise, unless links join them already, first every text of a band with one of them, in
    ``STARS`` rounds, so that a group of copies costs as much as its texts, then all others, inside tasks, by counts that
    bound their similarity from above. Only pairs within the bound leave a task, and are compared by their shingles.

    Words and shingles are those of ``near_duplicates``; texts without words, and nulls, are copies of each other.
    """
    sketches = written(_sketches(docs, words, id_col, text_col))
    classes = written(sketches.groupBy("same").agg(F.min("id").alias("node")))
    own = sketches.where("n > 0").join(classes.select(F.col("node").alias("id")), "id", "left_semi").withColumnRenamed("id", "node")
    banded = own.select("node", "n", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(banded.join(shared, "key"))
    alike = written(_print_pairs(own.select("node", "n", "fp0"), least))
    paired = alike.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = if_small(shared.select("node").unionByName(paired).distinct().withColumnRenamed("node", id_col))
    sets = written(_sets(docs.select(id_col, text_col).join(wanted, id_col, "left_semi"), words, id_col, text_col))

    # A group of copies has many pairs; one for each text joins most of it. The others are compared below, where they still may join something.
    seen = written(alike.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    roots = components(written(_verified(seen, sets, least)))
    for turn in range(STARS + 1):
        named = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        groups = named.groupBy("key").agg(
            F.min_by(F.struct("node", "n", "root"), F.xxhash64("key", "node", F.lit(turn)) if turn else F.col("node")).alias("one"),
            F.min("root").alias("low"),
            F.max("root").alias("high"),
        ).where("low <> high")
        if turn < STARS:
            found = named.join(groups, "key").select("node", "n", "root", F.col("one.node").alias("node2"), F.col("one.n").alias("n2"), F.col("one.root").alias("root2"))
            found = found.where((F.col("root") != F.col("root2")) & _alike(F.col("n"), F.col("n2"), least))
            pairs = found.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
        else:
            left = named.join(groups.select("key"), "key", "left_semi").join(sets.select("node", "bins"), "node")
            pairs = _paired(left.select("key", "size", "node", "n", "root", "bins"), least)
        if not turn:
            pairs = pairs.unionByName(_apart(alike, roots))
        pairs = pairs.distinct()
        pairs = written(pairs.join(seen, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        seen = seen.unionByName(pairs)
        links = written(_verified(pairs, sets, least))
        if links.isEmpty():
            continue
        # Components so far are stars, so few rounds join them by the new links.
        roots = components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = classes.join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("component"))
    return sketches.select("id", "same").join(written(named), "same").select("id", "component")
