"""The prefix trie of conversations by smallest-member ownership.

Each node belongs to the smallest conversation that begins with it, so what a conversation owns is a suffix of its
path. A node's sums over its subtree are sums over its members of what lies deeper on their paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .runtime import with_groups, written

NODE = ["depth", "k1", "k2"]
#: Aggregates along a path, and how those of two stretches of it are combined; null stands for no rows.
COMBINED = {
    "sum": (F.sum, lambda a, b: F.coalesce(F.col(a) + F.col(b), F.col(a), F.col(b))),
    "bit_xor": (F.bit_xor, lambda a, b: F.coalesce(F.col(a).bitwiseXOR(F.col(b)), F.col(a), F.col(b))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}
#: Ids of members that end in a node are joined to texts of so many ids at most.
IDS_AT_ONCE = 4096
#: SHA-256 of nothing (fixed value).
NOTHING = hashlib.sha256(b"").hexdigest()


def _keyed(text: Column) -> list[Column]:
    """Two numbers of 60 bits from a hash of ``text``."""
    digest = F.md5(text.cast("binary"))
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(f"h{i + 1}") for i, at in enumerate((1, 17))]


def _in_blocks(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows``, written in ranges of ``order``, with the number of the range in ``block``.

    A path of any length is divided among blocks; only the first and last path of a block can go on in another one.
    """
    return written(written(rows).repartitionByRange(*order).withColumn("block", F.spark_partition_id()))


def _along(rows: DataFrame, key: str, order: list[str], before: dict[str, tuple[str, str]], after: dict[str, str] | None = None) -> DataFrame:
    """``rows`` of ``_in_blocks`` with values along each ``key``: ``before`` (name: an aggregate of ``COMBINED``, and a
    column) over the rows before the row, ``after`` (name: column) sums over the row and those behind it.

    Windows see one key's rows of one block. What other blocks of the key add is a row for each block that begins or
    ends inside a key's rows, two a block at most, so what is broadcast is bounded by the number of partitions.
    """
    after = after or {}
    up = Window.partitionBy(key, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key, "block")
    local = rows.select(
        "*",
        *(COMBINED[f][0](c).over(up).alias(f"_b_{x}") for x, (f, c) in before.items()),
        *((F.sum(c).over(whole) - F.coalesce(F.sum(c).over(up), F.lit(0))).alias(f"_a_{x}") for x, c in after.items()),
    )
    per = rows.groupBy(key, "block").agg(
        *(COMBINED[f][0](c).alias(f"_b_{x}") for x, (f, c) in before.items()), *(F.sum(c).alias(f"_a_{x}") for x, c in after.items())
    )
    ends = rows.groupBy("block").agg(F.min(key).alias("least"), F.max(key).alias("most"))
    ends = ends.select(F.explode(F.array_distinct(F.array("least", "most"))).alias(key), "block")
    per = per.join(F.broadcast(ends), [key, "block"])
    past = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy(key).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(
        key,
        "block",
        *(COMBINED[f][0](f"_b_{x}").over(past).alias(f"_c_{x}") for x, (f, _) in before.items()),
        *(F.sum(f"_a_{x}").over(rest).alias(f"_d_{x}") for x in after),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return local.join(F.broadcast(carried), [key, "block"], "left").select(
        *rows.columns,
        *(COMBINED[f][1](f"_b_{x}", f"_c_{x}").alias(x) for x, (f, _) in before.items()),
        *((zero(f"_a_{x}") + zero(f"_d_{x}")).alias(x) for x in after),
    )


def rebuilt_paths(turns: DataFrame, shared: int = 5, most: int = 9) -> DataFrame:
    """``conv``, ``depth``, ``h1``, ``h2``, ``bytes``, ``turns``: a row for each turn of each rebuilt conversation, and one with depth 0.

    ``turns`` has ``conv``, ``turn``, ``digest``, ``bytes``. Conversation c begins with the first h turns of c - c %
    ``shared`` (all if there are fewer), h being the crc32 of its decimal id modulo ``most``, and goes on with its own
    turns after its first h.
    """
    ranked = _along(_in_blocks(turns.withColumn("one", F.lit(1)), ["conv", "turn", "digest"]), "conv", ["turn", "digest"], {"pos": ("sum", "one")})
    ranked = written(ranked.select("conv", "digest", "bytes", (F.coalesce("pos", F.lit(0)) + 1).alias("pos")))
    convs = written(ranked.groupBy("conv").agg(F.count("*").alias("n")))
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    asked = convs.select("conv", "n", taken.alias("h"), (F.col("conv") - F.col("conv") % shared).alias("base"))
    of = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    known = asked.join(of, "base", "left").withColumn("own_from", F.least("h", F.coalesce("n_base", F.lit(0))))
    known = written(known.withColumn("turns", F.col("own_from") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    own = with_groups(ranked, known.drop("base", "n_base"), ["conv"], "n", ranked.count(), "inner").where("pos > h")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("own_from")).alias("depth"), "digest", "bytes", "turns")
    first = ranked.where(F.col("pos") < most).select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "digest", "bytes")
    begun = known.join(first, "base").where("depth <= own_from").select("conv", "depth", "digest", "bytes", "turns")
    at = F.concat_ws(":", F.col("depth").cast("string"), "digest")
    roots = known.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("bytes"), "turns")
    return own.unionByName(begun).select("conv", "depth", *_keyed(at), "bytes", "turns").unionByName(roots)


def _ends(paths: DataFrame) -> DataFrame:
    """``NODE`` and ``ends_sha256`` of each node in which conversations end.

    Ids are joined to texts in groups of consecutive ids; nearly all nodes have one. The few texts of a node with more
    go through a hash one after the other, in their order: a stream, of which a task holds one text.
    """
    part = F.floor(F.col("conv") / IDS_AT_ONCE).alias("part")
    ids = F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",")
    texts = written(paths.where("depth = turns").groupBy(*NODE, part).agg(ids.alias("ids")))
    parts = texts.groupBy(*NODE).agg(F.count("*").alias("n"), F.first("ids").alias("ids"))
    single = parts.where("n = 1").select(*NODE, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    many = texts.join(parts.where("n > 1").select(*NODE), NODE)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        out: list[tuple] = []
        for batch in batches:
            for *own, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if own != node:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if node:
            out.append((*node, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)] + [pa.array([x[3] for x in out], pa.string())], [*NODE, "ends_sha256"])

    ordered = many.repartition(*NODE).sortWithinPartitions(*NODE, "part").select(*NODE, "ids")
    return single.unionByName(ordered.mapInArrow(stream, StructType.fromDDL("depth long, k1 long, k2 long, ends_sha256 string")))


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of the trie of rebuilt conversations (``rebuilt_paths``): one for each distinct sequence of first turns,
    from the textless root on.

    Returns ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (of the parent; null for the root),
    ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes in the subtree), ``saved_tokens`` (UTF-8 bytes of last
    texts that members beyond the first repeat, summed over the subtree), ``ends_sha256`` (of the ids of the members that
    end in the node, in order, joined by commas).

    A text is read once, and only a hash of role and text goes on. A node's key is made of the hashes of its turns at
    their places (120 bits), by a running exclusive or along each path. An aggregate gives each node's owner, which is
    joined back to all occurrences (large nodes, as the root, by a broadcast of fewer than ten thousand); sums of what
    lies deeper run along each path, in blocks; a last aggregate by node sums occurrence bytes minus owned bytes, leaf
    flags and children. All aggregates combine before the shuffle.

    Turns are ordered by number, nulls first; turns of one number by a hash of role and text. Null roles and texts are
    empty. Rows without a conversation's id are left out. Repeated rows are turns of their own. Without rows there is
    no conversation, and so no node. Other columns are not read, so their names cannot clash.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), said.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    paths = _along(_in_blocks(rebuilt_paths(turns), ["conv", "depth"]), "conv", ["depth"], {"p1": ("bit_xor", "h1"), "p2": ("bit_xor", "h2")})
    key = lambda p, h: F.coalesce(F.col(p), F.lit(0)).bitwiseXOR(F.col(h))
    paths = written(paths.select("conv", "block", "depth", key("p1", "h1").alias("k1"), key("p2", "h2").alias("k2"), "bytes", "turns"))
    owners = paths.groupBy(*NODE).agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.max("turns").alias("deepest"))
    marked = with_groups(paths, written(owners), NODE, "n_convs", paths.count(), "inner")
    owned, zero = F.col("conv") == F.col("owner"), F.lit(0).cast("long")
    marked = marked.select(
        "conv", "block", *NODE, "turns", "owner", "bytes",
        F.when(owned, F.col("bytes")).otherwise(zero).alias("own_bytes"),
        owned.cast("long").alias("own"),
        (owned & (F.col("deepest") == F.col("depth"))).cast("long").alias("leaf"),
    )
    below = {"all_bytes": "bytes", "all_own_bytes": "own_bytes", "all_own": "own", "leaves": "leaf"}
    sums = _along(written(marked), "conv", ["depth"], {"above": ("max", "owner")}, below)
    # What a conversation owns is a suffix of its path: it owns the next node if it owns all that are left.
    next_owned = (F.col("turns") > F.col("depth")) & (F.col("all_own") - F.col("own") == F.col("turns") - F.col("depth"))
    nodes = sums.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"),
        F.max(F.when(F.col("own") == 1, F.col("above"))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if(next_owned).alias("n_children"),
        F.sum("leaves").alias("n_leaves"),
        F.sum(F.col("all_bytes") - F.col("all_own_bytes")).alias("saved_tokens"),
    )
    found = nodes.join(_ends(paths), NODE, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")
    )
