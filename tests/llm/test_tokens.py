import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from conftest import CLASHING
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm.packing import fullest, pack, places, plan
from sluice.llm.tokens import _ranks, byte_bpe_decode, byte_bpe_encode, distinct_runs, runs_of, safe_parts, token_counts, token_pieces

RANKS, BYTES, WORDS = (P.path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", None, " ", "\n\n  x", "don't I'LL <|endoftext|>", "a\x1cb !\x1c!", "İstanbul ΣΑΣ ẞ ﬁ é", "日本語 👍🏽", "a  b  c　d", "x" * 3000, " " * 3000]


def made(n=300):
    rng = random.Random(5)
    letters = "aB cÉé'sS.,!?\x1c\x85\xa0 \n\t12ΣσİıſßẞḰ̇ëﬁǅ中文👍🏽-_<|endoftext|> don't I'LL"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_byte_bpe_is_the_library_and_comes_back(docs):
    texts = made() + ["word, " * 30_000]
    enc = _ranks(RANKS, P.PATTERN)
    found = byte_bpe_decode(byte_bpe_encode(docs(texts, extra=CLASHING), RANKS, P.PATTERN), RANKS, P.PATTERN)
    for r in found.collect():
        want = enc.encode_ordinary(texts[r.id] or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.data) == (texts[r.id] or "").encode()


def test_parts_join_to_the_text():
    text = "one  two\n three " * 9
    for size in (1, 5, 50):
        assert "".join(safe_parts(text, size)) == text
    assert "".join(runs_of(text)) == text


@pytest.mark.parametrize("frequent", [1, 50, 1_000_000])
def test_counts_are_the_librarys(docs, frequent):
    """Whatever part of the pre-tokens is joined by a shuffle."""
    texts = made() + ["x" * 65, "x" * 64 + " y", "= 3", "word, " * 30_000]
    library = Tokenizer.from_file(BYTES)
    found = token_counts(docs(texts, extra=CLASHING), BYTES, frequent=frequent).collect()
    assert sorted(r.id for r in found) == list(range(len(texts)))
    for r in found:
        text = texts[r.id] or ""
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert r.n_bytes == len(text.encode())


def test_counts_of_repeated_and_null_ids_and_of_nothing(spark, docs):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (1, None)], "doc_id long, text string")
    assert sorted(token_counts(rows, BYTES).collect(), key=str) == [(1, 0, 0), (1, 3, 2), (1, 3, 2), (None, 1, 1)]
    assert token_counts(docs([]), BYTES).count() == 0


def test_pieces_are_counted_once_for_each_pre_token(docs):
    found = distinct_runs(docs(["a b a", "b a", None, "", "x" * 65]), BYTES).collect()
    assert {r.run: (r.n, r.pieces) for r in found} == {"a": (1, 1), " a": (2, 1), " b": (1, 1), "b": (1, 1)} and len(found) == 4


@pytest.mark.parametrize("capacity", [7, 64])
def test_pieces_and_packing(docs, capacity):
    texts = made() + ["the cat, " * 400] * 30
    library = Tokenizer.from_file(WORDS)
    rows = pack(token_pieces(docs(texts, extra=CLASHING), WORDS, capacity), capacity).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.id, []).append(r)
    assert len(pieces) == len(texts)
    for i, own in pieces.items():
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.start == r.piece * capacity and zlib.crc32(part) == r.ids_crc32
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(bins) <= total / capacity * 1.02 + 1


def test_packing_of_nothing_and_wrong_lengths(spark, docs):
    assert pack(token_pieces(docs([]), WORDS, 16), 16).count() == 0
    with pytest.raises(Exception, match="lengths must lie"):
        pack(spark.createDataFrame([(1, 99)], "id long, length long"), 16).count()


def test_fullest_is_brute_force():
    from itertools import product

    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 12): rng.randrange(1, 3) for _ in range(4)}
        room = rng.randrange(0, 30)
        best = max(s for c in product(*(range(n + 1) for n in counts.values())) if (s := sum(a * b for a, b in zip(c, counts, strict=True))) <= room)
        used = fullest(counts, sorted(counts, reverse=True), room)
        assert sum(k * n for k, n in used.items()) == best and all(n <= counts[k] for k, n in used.items())


def test_plan_uses_every_piece():
    counts = {1: 5, 3: 1000, 5: 77, 16: 3, 9: 40}
    found = plan(counts, 16)
    assert {k: sum(u.get(k, 0) * t for u, t in found) for k in counts} == counts
    assert len(places(found)) == sum(len(u) for u, _ in found)


def test_digests_of_the_queries(spark):
    from sluice.llm.queries import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    enc = _ranks(RANKS, P.PATTERN)
    for r in queries()["op5_byte_bpe"](spark, sf).collect():
        ids = np.array(enc.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_packing_with_names_of_its_own(spark):
    names = ("_first", "_rank", "_task", "_n", "c0", "c1", "sequence_id", "offset", "n")
    pieces = spark.createDataFrame([(i, 1 + i % 5) for i in range(40)], "doc_id long, length long")
    own = pieces
    for name in names:
        own = own.withColumn(name, F.lit("own"))
    found = pack(own, 7)
    assert found.columns == ["doc_id", "length", *(x for x in names if x not in ("sequence_id", "offset")), "sequence_id", "offset"]
    rows = found.collect()
    assert all(r._first == r.c1 == "own" for r in rows)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted((r.doc_id, r.length) for r in rows) == [(i, 1 + i % 5) for i in range(40)]
    for parts in places.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 7


def test_words_are_remembered_in_two_generations(monkeypatch):
    """Words that are met again and again are encoded once, however many others come between; ids are the library's."""
    from sluice.llm import tokens

    monkeypatch.setattr(tokens, "GENERATION", 60)
    path = P.path("word_bpe_49k.json")
    words = tokens._Words(path)
    learned, merge = [], words.merge
    words.merge = lambda x: (learned.extend(x), merge(x))
    odd = "Ünïted naïve Straße œuvre ｆｕｌｌ ªº Ωμ дом don't x2 été! ŁÓDŹ ǆ"
    for i in range(200):
        text = f"{odd} the same words again " + " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}q" for k in range(20))
        assert words(text) == np.asarray(tokens._library(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert learned.count("again") == 1 and learned.count("straße") == 1 and len(words.known) < 200
