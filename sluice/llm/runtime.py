"""What the operators share: session settings, joins with groups of any size, connected components.

``written`` tables lie in the shared folder: computed once, safe from lost executors, without lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..workspace import send_package, written

def session_of(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, and set the batch size for Python stages where it is Spark's default."""
    return send_package(spark)


def schema_of(df: DataFrame, names: dict[str, str], more: str) -> StructType:
    """Columns of ``df`` under new names (new: old), then those of the DDL string ``more``."""
    return StructType([StructField(new, df.schema[old].dataType) for new, old in names.items()] + StructType.fromDDL(more).fields)


#: Rows of one number that are broadcast; a table with more is joined by a shuffle.
SMALL_ROWS = 300_000


def if_small(narrow: DataFrame) -> DataFrame:
    """``narrow`` (a column or two of numbers) written, and marked for a broadcast if it has few rows."""
    narrow = written(narrow)
    return F.broadcast(narrow) if narrow.count() <= SMALL_ROWS else narrow


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the ids in ``gone`` (column ``id``). Texts are shuffled only if very many ids go."""
    return docs.join(if_small(gone.select(F.col("id").alias(id_col))), id_col, "left_anti").select(*docs.columns)


#: Groups that may be broadcast: those that hold more than one in so many rows, of which there can be no more.
HOT_GROUPS = 10_000


def with_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, n: int, how: str = "left") -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) with ``groups``, which has one row a group and the number of its rows in ``size``.

    A shuffle would gather a large group in one task. So groups with more than ``n / HOT_GROUPS`` of all ``n`` rows, of
    which there are fewer than ``HOT_GROUPS``, are broadcast, and only rows of the others are shuffled. Both tables are
    read twice, so ``rows`` should be written, and ``groups`` written or an aggregate whose shuffle Spark uses again.
    """
    least = n // HOT_GROUPS
    hot = F.broadcast(groups.where(F.col(size) > least))
    cold = rows.join(hot.select(*on), on, "left_anti").join(groups.where(F.col(size) <= least), on, how)
    return rows.join(hot, on).unionByName(cold)


#: Links whose smallest nodes are broadcast whole.
FEW_LINKS = 40_000


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``links`` (``a``, ``b``: long, any order, repeats and loops allowed).

    Returns ``node``, ``root`` (the smallest node reachable) for every node that has a link to another one.
    Alternates large-star and small-star rounds until all links are of stars: in each, every node is linked to the smallest
    node of its neighbourhood, so the number of rounds grows with the logarithm of the longest path. A star's rows are
    made by a join with one minimum per node, broadcast if they are few; else ``with_groups`` keeps large neighbourhoods
    out of the shuffle.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    for _ in range(max_rounds):
        n, settled = _state(edges)
        if settled:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _with_least(both.where("b > a"), least, 2 * n)
        large = written(large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, down, n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = written(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _with_least(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """Each link of ``a`` with the smallest node beside it."""
    if n <= FEW_LINKS:
        return rows.join(F.broadcast(least.select("a", "m")), "a")
    return with_groups(rows, least, ["a"], "n", n, "inner")


def _state(edges: DataFrame) -> tuple[int, bool]:
    """The number of links, and whether all are of stars: no node has two smaller ones, or a smaller one and a greater one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("all_up"))
    n, others = nodes.agg(F.sum("ups"), F.count_if((F.col("ups") > 1) | (F.col("ups") > F.col("all_up")))).first()
    return n or 0, not others
