import hashlib
import random

import numpy as np
from conftest import CLASHING
from pyspark.sql import functions as F

from sluice.llm import queries
from sluice.llm.periodic import WORDS, agree_backward, agree_forward, name_levels, periodic_runs, runs_of


def brute(words):
    """Every maximal stretch of each period, word by word; the smallest period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_as_brute_force():
    draw = random.Random(1)
    for _ in range(1500):
        words = [draw.randrange(draw.choice([1, 2, 3])) for _ in range(draw.randrange(60))]
        if words and draw.random() < 0.6:
            a = draw.randrange(len(words))
            p = 1 + (len(words) - a) // draw.randint(3, 9)
            words[a:] = [words[a + i % p] for i in range(len(words) - a)]
        assert [tuple(map(int, r)) for r in runs_of(np.array(words, np.int64))] == brute(words)


def test_names_tell_how_far_places_agree():
    draw = random.Random(2)
    words = [draw.randrange(2) for _ in range(40)] * 3
    levels = name_levels(np.array(words))
    pairs = [(i, j) for j in range(len(words)) for i in range(j)]
    i, j = np.array(pairs).T
    forward, backward = agree_forward(levels, i, j), agree_backward(levels, i, j)
    for k in draw.sample(range(len(pairs)), 500):
        a, b = pairs[k]
        ahead = next((x for x in range(len(words) - b) if words[a + x] != words[b + x]), len(words) - b)
        behind = next((x for x in range(a) if words[a - 1 - x] != words[b - 1 - x]), a)
        assert (forward[k], backward[k]) == (ahead, behind)


def test_texts_of_every_kind(docs):
    long = " ".join(f"w{i}" for i in range(4000)) + " a b" * 4000 + " c d e" * 5
    texts = [None, "", " \n", "one", "x x x x x", "x x x x x x", "a b\ta b\n\x0ba b a", "a b c " * 4, long, "x x x x x x", "ä ö " * 9, "a\xa0b " * 6]
    rows = periodic_runs(docs(texts, extra=CLASHING)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = WORDS.findall(texts[r.id] or "")
        own = [(x.start, x.length, x.period) for x in r.runs]
        if texts[r.id] != long:
            assert own == brute(words)
        else:
            assert own == [(4000, 8000, 2), (12000, 15, 3)]
        assert r.collapsed == collapsed(words, own)
    assert periodic_runs(docs([])).count() == 0


def test_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a a a a a a"), (1, "a a a a a a"), (None, "b")], "doc_id long, text string")
    assert sorted(len(r.runs) for r in periodic_runs(rows).collect()) == [0, 1, 1]


def test_the_query_is_brute_force_on_planted_words(spark, tmp_path):
    draw = random.Random(3)
    texts = [" ".join(draw.choice("abcdefg") for _ in range(draw.randrange(120))) for _ in range(150)] + [None, "", "z " * 30]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        words = queries.planted(i, text or "")
        runs = brute(words)
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want = (len(runs), *top, 1000 * top[1] // top[2] if runs else None)
        r = rows[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == want
        assert r.runs_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert any(r.n_runs for r in rows.values())
    assert rows[len(texts) - 1].length == 30
    assert queries.op11_periodic_runs(spark, str(tmp_path)).where(F.col("runs_sha256").isNull()).count() == 0
