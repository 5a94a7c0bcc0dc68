from collections import Counter

from conftest import CLASHING
from pyspark.sql import functions as F

from sluice.llm.sharding import interleaved, write_shards


def placed(spark, rows, shards, extra=(), **more):
    given = spark.createDataFrame(rows, "doc_id long, source string")
    for name in extra:
        given = given.withColumn(name, F.lit(7))
    return interleaved(given, shards, **more)


def test_each_shard_has_the_mixture(spark):
    """A source with a third of all rows, one of one row, a null one; rows a shard at most one apart, shares within two."""
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)] + [(9000, "one"), (9001, None), (9002, None)]
    found = placed(spark, rows, 7, CLASHING + ("phase", "draw", "cell", "part", "position", "shard")).collect()
    assert sorted(r.id for r in found) == sorted(i for i, _ in rows)
    assert sorted(r.position for r in found) == list(range(len(rows)))
    sizes = Counter(r.shard for r in found)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
    of, n_of = dict(rows), Counter(s for _, s in rows)
    for (source, shard), n in Counter((of[r.id], r.shard) for r in found).items():
        assert abs(n - n_of[source] * sizes[shard] / len(rows)) < 2, (source, shard, n)


def test_order_is_the_fractional_ranks(spark):
    """Against a sort of all rows in one list."""
    found = placed(spark, [(i, "ab"[i % 5 == 0]) for i in range(400)], 5).collect()
    place = {r.id: r.position for r in found}
    for keep in (lambda i: i % 5 == 0, lambda i: i % 5):
        order = sorted((i for i in place if keep(i)), key=place.get)
        n = len(order)
        gaps = [place[b] - place[a] for a, b in zip(order, order[1:], strict=False)]
        assert max(gaps) - min(gaps) <= 2 and abs(sum(gaps) / (n - 1) - 400 / n) < 1
        assert order != sorted(order)


def test_repeated_rows_few_rows_and_none(spark):
    found = placed(spark, [(1, "a")] * 5 + [(None, None)] * 2, 24).collect()
    assert len({r.position for r in found}) == 7 and all(r.slot == 0 for r in found)
    assert placed(spark, [], 24).count() == 0
    again = placed(spark, [(1, "a")] * 5 + [(None, None)] * 2, 24).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    other = placed(spark, [(i, "a") for i in range(50)], 2, seed=5).collect()
    assert {r.id: r.position for r in other} != {r.id: r.position for r in placed(spark, [(i, "a") for i in range(50)], 2).collect()}


def test_files_of_shards(spark, docs, tmp_path):
    given = docs([f"text {i}" * (i % 3) for i in range(100)] + [None, "x" * 200_000])
    write_shards(given, interleaved(given, 4), f"{tmp_path}/shards", rows_per_file=20)
    found = spark.read.parquet(f"{tmp_path}/shards")
    assert found.count() == 102 and found.select("doc_id").distinct().count() == 102
    assert {(r.doc_id, r.text) for r in found.collect()} == {(r.doc_id, r.text) for r in given.collect()}
    for shard in range(4):
        slots = [r.slot for r in spark.read.parquet(f"{tmp_path}/shards/shard={shard}").collect()]
        assert sorted(slots) == list(range(len(slots)))
