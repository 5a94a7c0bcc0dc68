"""What a file's rows can have as keys: least and greatest key, and Bloom bits, so that a load reads only files that can hold its keys.

A folder ``s=...`` has ``ranges`` (a row a file) and ``bits`` (a row for each key and each 4,096 bytes of a file's bits).
All bits of a key lie in one such part, so parts are made, combined and looked up on their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import TableSpec, UniqueKey
from . import table

#: Bits of a part (fixed value: what ``bitmap_or_agg`` combines), bits for each row of a file, bits set for a key.
PART_BITS, BITS_A_ROW, SET_BITS = 32768, 12, 5
#: Keys of a load that are looked up in Bloom bits (8 bytes each, sent to every task); with more, ranges alone decide.
KEYS_SENT = 2_000_000


def signature(key: UniqueKey) -> str:
    return hashlib.sha256(repr((key.expressions, key.where, key.nulls_distinct)).encode()).hexdigest()[:16]


def key_columns(key: UniqueKey) -> tuple[list[Column], Column]:
    """The key's parts, and whether a row takes part: the predicate holds, and no part is null unless nulls are alike."""
    parts = [F.expr(x) for x in key.expressions]
    taking = F.coalesce(F.expr(key.where), F.lit(False)) if key.where else F.lit(True)
    if key.nulls_distinct:
        for x in parts:
            taking = taking & x.isNotNull()
    return parts, taking


def folder_of(data: str) -> str:
    """The summary's folder of a data folder (``v=...``, or one inside it)."""
    return "s=" + data.partition("=")[2].partition("/")[0]


def _places(h: np.ndarray) -> np.ndarray:
    """``SET_BITS`` places in a part for each hash (constants: fixed values of a known 64-bit finaliser)."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        y = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        turns = np.arange(SET_BITS, dtype=np.uint64)[:, None]
        return ((x + turns * y) >> np.uint64(40)) % np.uint64(PART_BITS)


def _part(h: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    """Which of so many parts a hash lies in: its upper 32 bits, scaled."""
    return (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def write(spark: SparkSession, path: str, data: str, spec: TableSpec) -> None:
    """Summarise the files of the folder ``data``. Key columns are read again, nothing else; what combines is shuffled by file."""
    rows = spark.read.schema(spec.ddl).parquet(data).withColumn("_file", F.col(table.PLACE["_file"]))
    ranges, hashes = [], []
    for i, key in enumerate(spec.unique):
        parts, taking = key_columns(key)
        own = F.when(taking, F.struct(*(x.alias(f"k{j}") for j, x in enumerate(parts))))
        ranges += [F.min(own).alias(f"least_{signature(key)}"), F.max(own).alias(f"most_{signature(key)}")]
        hashes.append(F.when(taking, F.xxhash64(*parts)).alias(f"h{i}"))
    per_file = rows.groupBy("_file").agg(F.count("*").alias("n"), *ranges)
    per_file.write.parquet(f"{path}/ranges")
    sizes = {r[0]: max(1, -(-r[1] * BITS_A_ROW // PART_BITS)) for r in spark.read.parquet(f"{path}/ranges").select("_file", "n").toLocalIterator()}
    names = [signature(k) for k in spec.unique]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            keep = [k for k in found if found[k].any()]
            if keep:
                bits = pa.array([np.packbits(found[k], bitorder="little").tobytes() for k in keep], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep]), pa.array([k[1] for k in keep]), pa.array([k[2] for k in keep], pa.int32()), bits], ["_file", "key", "part", "bits"])
            found.clear()

        for batch in batches:
            files = batch.column(0).dictionary_encode()
            for code, file in enumerate(files.dictionary.to_pylist()):
                own = files.indices.to_numpy(zero_copy_only=False) == code
                for i, name in enumerate(names):
                    column = batch.column(1 + i).drop_null() if own.all() else batch.column(1 + i).filter(pa.array(own)).drop_null()
                    h = column.to_numpy(zero_copy_only=False).view(np.uint64)
                    part = _part(h, sizes[file])
                    for p in np.unique(part):
                        bits = found.setdefault((file, name, int(p)), np.zeros(PART_BITS, bool))
                        bits[_places(h[part == p]).reshape(-1)] = True
            if len(found) > 1000:  # 32 KB each
                yield from told()
        yield from told()

    bits = rows.select("_file", *hashes).mapInArrow(fill, "_file string, key string, part int, bits binary")
    bits.groupBy("_file", "key", "part").agg(F.bitmap_or_agg("bits").alias("bits")).write.parquet(f"{path}/bits")


def files_with(spark: SparkSession, path: str, version: table.Version, keys: DataFrame, spec: TableSpec) -> list[str]:
    """Files (folder/name) of the table ``path`` that can hold a key of the rows in ``keys`` (the columns of ``spec``).

    Folders without a summary of a key are read whole. In others a file can hold a key if it lies between the file's
    least and greatest one and, while keys are at most ``KEYS_SENT``, if its bits are set. A file that holds one is
    always found.
    """
    wanted = {signature(k): k for k in spec.unique}
    covered = [d for d, have in version.data if set(wanted) <= set(have)]
    found = set(table._files(spark, path, [d for d in version.folders if d not in covered]))
    if not covered:
        return sorted(found)
    names = {x.rpartition("/")[2]: x for x in table._files(spark, path, covered)}
    summaries = [f"{path}/{folder_of(d)}" for d in covered]
    ranges = spark.read.parquet(*(f"{x}/ranges" for x in summaries))
    bits = spark.read.schema("_file string, key string, part int, bits binary").parquet(*(f"{x}/bits" for x in summaries))
    for name, key in wanted.items():
        parts, taking = key_columns(key)
        own = keys.where(taking).select(F.struct(*(x.alias(f"k{j}") for j, x in enumerate(parts))).alias("k"), F.xxhash64(*parts).alias("h"))
        bound = F.broadcast(own.agg(F.min("k").alias("low"), F.max("k").alias("high")))  # one row
        near = ranges.join(bound, (F.col(f"least_{name}") <= F.col("high")) & (F.col(f"most_{name}") >= F.col("low"))).select("_file", "n")
        hashes = own.select("h").distinct().limit(KEYS_SENT + 1).toArrow().column(0).to_numpy()
        if len(hashes) > KEYS_SENT:
            found |= {names[r[0]] for r in near.select("_file").toLocalIterator()}
            continue
        sent = spark.sparkContext.broadcast(np.sort(hashes.astype(np.int64).view(np.uint64)))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = sent.value
            for batch in batches:
                hit = []
                for file, n, part, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    sizes = max(1, -(-n * BITS_A_ROW // PART_BITS))
                    # Keys of this part are neighbours in the sorted list.
                    low, high = (np.uint64(min(-(-(p << 32) // sizes), (1 << 32) - 1) << 32) if p < sizes else None for p in (part, part + 1))
                    own = keys[np.searchsorted(keys, low) : None if high is None else np.searchsorted(keys, high)]
                    set_bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").astype(bool)
                    if len(own) and set_bits[_places(own)].all(axis=0).any():
                        hit.append(file)
                yield pa.RecordBatch.from_arrays([pa.array(hit, pa.string())], ["_file"])

        asked = bits.where(F.col("key") == name).join(near, "_file").select("_file", "n", "part", "bits")
        found |= {names[r[0]] for r in asked.mapInArrow(look, "_file string").distinct().toLocalIterator()}
    return sorted(found)
