import hashlib
import random
import zlib

import pytest
from conftest import CLASHING
from pyspark.sql import functions as F

from sluice.llm import prefix_trie as module
from sluice.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The trie by dictionaries of prefixes. Turns of one number are put in the operator's order."""
    told = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            told.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    told = {c: [x[3:] for x in sorted(t)] for c, t in told.items()}
    paths = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = told.get(c - c % 5, [])[:h] + own[h:]
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    found = set()
    for node, of in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        childless = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * (len(x[-1][1].encode()) if x else 0) for x in below)
        ends = ",".join(str(c) for c in sorted(of) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        found.add((min(of), len(node), parent, len(of), len(children), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return found, len(members)


def check(spark, rows, extra=()):
    given = spark.createDataFrame(rows, SCHEMA)
    for name in extra:
        given = given.withColumn(name, F.lit(7))
    found = prefix_trie(given).collect()
    want, n = brute(rows)
    assert len(found) == n
    assert {tuple(r) for r in found} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, monkeypatch, seed):
    """Few words, so that prefixes are shared; ids are joined two at a time, so that nodes have many texts of ids."""
    monkeypatch.setattr(module, "IDS_AT_ONCE", 2)
    draw = random.Random(seed)
    rows = [(c, t, draw.choice(["user", "bot", None]), draw.choice(["ä", "b", None])) for c in range(60) if c % 7 for t in range(draw.randrange(1, 6))]
    check(spark, rows, CLASHING + ("depth", "k1", "k2", "block", "owner", "turns", "conv", "above"))


def test_ties_nulls_and_odd_ids(spark):
    rows = [
        (1, None, "a", "x"), (1, 0, "a", "y"), (1, 0, "a", "z"), (1, 0, "a", "z"), (None, 0, "a", "lost"), (2, 5, None, None),
        (-3, 1, "a", "x"), (10**15, 1, "a", "x"), (3, 1, "", "x" * 100_000), (3, 2, "", "y"), (4, None, None, "x"), (4, None, None, "w"),
    ]
    check(spark, [r for r in rows if r[0] != -3])


def test_one_long_conversation_and_a_group_of_copies(spark):
    """A third of the rows is one conversation, which blocks divide; another third are equal conversations."""
    long = [(7, t, "a", f"t{t}") for t in range(300)]
    copies = [(c, t, "a", f"same {t}") for c in range(100, 200, 5) for t in range(8)]
    check(spark, long + copies + [(c, 0, "b", "z") for c in range(300, 340)])


def test_blocks_carry_what_paths_have_before_and_behind(spark):
    rows = spark.createDataFrame([(k, d, 1 + (d * 7 + k) % 5) for k, n in ((1, 40), (2, 1), (3, 90)) for d in range(n)], "key long, d long, v long")
    rows = rows.withColumn("block", F.floor((F.col("key") * 100 + F.col("d")) / 17))
    found = module._along(rows, "key", ["d"], {"s": ("sum", "v"), "x": ("bit_xor", "v"), "m": ("max", "v")}, {"rest": "v"}).collect()
    assert len(found) == 131
    for r in found:
        values = [1 + (d * 7 + r.key) % 5 for d in range({1: 40, 2: 1, 3: 90}[r.key])]
        past, xor = values[: r.d], 0
        for v in past:
            xor ^= v
        assert (r.s, r.x, r.m, r.rest) == ((sum(past), xor, max(past)) if past else (None, None, None)) + (sum(values[r.d :]),)


def test_without_rows(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
