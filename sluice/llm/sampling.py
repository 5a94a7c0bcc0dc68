"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_rest(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def picked_by_class(rows: DataFrame, class_col: str, size: int, id_col: str) -> Column:
    """A condition that holds for about ``size`` rows of each class at most (all rows of smaller ones), by a hash of the id.

    ``rows`` are counted by class, which reads that column only; there is no sort and no shuffle of rows. Classes must
    be few.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(class_col).isNotNull()).groupBy(class_col).count().collect()}
    share = F.lit(0.0)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        share = F.when(F.col(class_col) == value, size / n).otherwise(share)
    at = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    return F.col(class_col).isNotNull() & (at < share)


def labelled_texts(docs: DataFrame, labels: DataFrame, class_col: str, size: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``label``, ``text`` of a sample of ``labels`` with ``size`` rows a class; two classes at most are expected.

    The sampled ids are at most ``size`` a class, so they are broadcast and the texts are not shuffled. Null texts are
    empty; of several labels of an id the smallest counts; ids without a document are left out.
    """
    own = labels.groupBy(id_col).agg(F.min(class_col).alias(class_col))
    picked = own.where(picked_by_class(own, class_col, size, id_col)).select(F.col(id_col).alias("_id"), F.col(class_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), texts["id"] == picked["_id"]).select("id", "label", "text")
