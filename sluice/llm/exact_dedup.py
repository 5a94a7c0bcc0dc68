"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import if_small, with_groups, without, written

#: White space that does not count in a comparison: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, columns: list[str], prefix_chars: int = 64) -> DataFrame:
    """``id`` and those of ``points``, ``len``, ``prefix``, ``digest`` that are asked for, from one scan without a shuffle of texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = {
        "points": F.length("text").cast("long"),
        "len": F.length("clean").cast("long"),
        "prefix": F.xxhash64(F.substring("clean", 1, prefix_chars)),
        "digest": F.sha2("clean", 256),
    }
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), normalised(F.col(text_col)).alias("clean"))
    return rows.select("id", *(found[x].alias(x) for x in columns))


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``group_size``, ``keep`` of the groups of more than one row. Counts combine before the shuffle."""
    best = F.max(F.struct("points", (-F.col("id")).alias("minus"))).alias("best")
    found = rows.groupBy(*keys).agg(F.count("*").alias("group_size"), best).where("group_size > 1")
    return written(found.select(*keys, "group_size", (-F.col("best.minus")).alias("keep")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups of rows whose texts are identical without white space, with every row's digest.

    Returns one row for each row of ``docs``: ``id``, ``keep_id`` (of the row that stays: most code points in the
    original text, then the smallest id), ``group_size``, ``kept``, ``digest`` (SHA-256 of the normalised text).

    Since every digest is asked for, every text is read whole anyway: one scan makes length, prefix hash and digest,
    and the three levels are one grouping by all of them. Where no digest is wanted, ``surplus_ids`` reads less. A group
    with a third of the rows is a row per task, and is broadcast to its rows (``with_groups``).

    Null texts count as empty, and all empty texts form a group. Ids must not be null; a repeated id gives a row for each of
    its rows, and of equal rows with one id all that have the smallest id are ``kept``. An empty table gives an empty result. Other
    columns of ``docs`` are not read, so their names cannot clash.
    """
    rows = written(_fingerprints(docs, id_col, text_col, ["points", "len", "prefix", "digest"]))
    groups = _groups(rows, ["len", "prefix", "digest"])
    return with_groups(rows, groups, ["len", "prefix", "digest"], "group_size", rows.count()).select(
        "id",
        F.coalesce("keep", "id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.coalesce("keep", "id") == F.col("id")).alias("kept"),
        "digest",
    )


def surplus_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` of the rows of ``docs`` that aren't kept, by progressive refinement.

    A first scan takes each text's length, and the hash of a prefix. Rows whose length nobody shares are settled by
    counting lengths, those whose prefix hash nobody of that length shares by counting these. Only the rest is hashed
    whole, in a second scan that skips all other rows, and grouped by length, prefix and digest.
    """
    rows = written(_fingerprints(docs, id_col, text_col, ["points", "len", "prefix"]))
    n = rows.count()
    lengths = written(rows.groupBy("len").agg(F.count("*").alias("n_len")).where("n_len > 1"))
    rest = with_groups(rows, lengths, ["len"], "n_len", n, "inner").drop("n_len")
    prefixes = written(rest.groupBy("len", "prefix").agg(F.count("*").alias("n_prefix")).where("n_prefix > 1"))
    rest = written(with_groups(rows, prefixes, ["len", "prefix"], "n_prefix", n, "inner").drop("n_prefix"))
    wanted = if_small(rest.select(F.col("id").alias(id_col)).distinct())
    hashed = _fingerprints(docs.select(id_col, text_col).join(wanted, id_col, "left_semi"), id_col, text_col, ["points", "len", "prefix", "digest"])
    hashed = written(hashed)
    groups = _groups(hashed, ["len", "prefix", "digest"])
    found = with_groups(hashed, groups, ["len", "prefix", "digest"], "group_size", n, "inner")
    return found.where("id <> keep").select("id")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts. ``id_col`` must be unique and not null."""
    return without(docs, surplus_ids(docs, id_col, text_col), id_col)
