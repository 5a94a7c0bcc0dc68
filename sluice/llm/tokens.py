"""Tokens of public vocabularies: byte-level BPE encoding and decoding, token counts, pieces for packing.

Encoding and decoding map Arrow batches to Arrow batches: no shuffle, no row leaves its partition, and a lost task is
simply run again; a worker keeps the vocabulary and a bounded store of pre-tokens from one batch to the next. Token
counts join pre-tokens with what was counted once for each.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .runtime import schema_of, written

#: The characters of Unicode's White_Space property, which the vocabularies' patterns mean by \s (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: str.split() takes these for white space; the patterns don't.
SEPARATORS = re.compile("[\x1c-\x1f]")
WORDS = re.compile(f"[^{WHITE}]+")
#: A run without a safe boundary inside: white space, then the characters up to the next white space.
RUNS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: White space before a space: only here may a space not begin a run.
LOOSE = re.compile(f"[{WHITE}] ")

#: Marks that are pre-tokens of their own behind a word of letters.
MARKS = ".,!?;:"
#: Pre-tokens that a worker remembers; the store starts anew when full, which costs time only.
REMEMBERED = 200_000
#: Words of an encoder that a worker remembers in each of two generations: when the newer one is full, the older one goes.
GENERATION = 150_000
#: Words of these characters are one pre-token, which neither the normaliser nor the pattern changes.
LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+")
#: Longer texts are encoded in parts cut at safe boundaries.
LONG_CHARS = 50_000


def mapped(df: DataFrame, columns: list[str], schema: StructType, work: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``work`` over batches of ``columns`` only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(work(batch))

    return df.select(*columns).mapInArrow(run, schema)


def safe_parts(text: str, size: int = LONG_CHARS) -> Iterator[str]:
    """``text`` cut before white space that follows something else, into parts of ``size`` characters or more.

    No match of the patterns spans such a place, and none looks back, so the parts' tokens are the text's tokens. A
    text without such a place stays whole.
    """
    if len(text) <= size:
        yield text
        return
    boundary = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
    at = 0
    while len(text) - at > size and (cut := boundary.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@functools.cache
def _ranks(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def byte_bpe_encode(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``n_tokens``, ``ids`` (binary: little-endian unsigned 32-bit) of each text, without special tokens.

    ``ranks_path`` is a rank file of the tiktoken library, ``pattern`` splits a text before merging. Strings that look
    like special tokens are ordinary text. Null and empty texts have no ids. Repeated ids give repeated rows; other
    columns are not read.
    """

    def work(batch: pa.RecordBatch) -> dict:
        encode = _ranks(ranks_path, pattern).encode_to_numpy
        ids, counts = [], []
        for text in batch.column(1):
            parts = [encode(x, disallowed_special=()).astype("<u4").tobytes() for x in safe_parts(text.as_py() or "")]
            ids.append(b"".join(parts))
            counts.append(len(ids[-1]) // 4)
        return {"id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array(ids, pa.binary())}

    return mapped(df, [id_col, text_col], schema_of(df, {"id": id_col}, "n_tokens long, ids binary"), work)


def byte_bpe_decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``data``, the bytes that its ``ids`` stand for, put together as bytes (an id may hold part of a
    character). An id that the vocabulary lacks raises an error; null ids stay null."""
    kept = encoded.columns

    def work(batch: pa.RecordBatch) -> dict:
        decode = _ranks(ranks_path, pattern).decode_bytes
        data = [
            None if x is None else decode(np.frombuffer(x, "<u4").tolist()) for x in batch.column(kept.index("ids")).to_pylist()
        ]
        return dict(zip(kept, batch.columns, strict=True)) | {"data": pa.array(data, pa.binary())}

    return mapped(encoded, kept, schema_of(encoded, {x: x for x in kept}, "data binary"), work)


def runs_of(text: str) -> list[str]:
    """``text`` cut at every safe boundary."""
    if LOOSE.search(text):
        return RUNS.findall(text)
    first, *rest = text.split(" ")
    found = [first] if first else []
    found += [" " + x for x in rest]
    return found


class _Counts:
    """The vocabulary's library, and what splits a text for it."""

    def __init__(self, path: str):
        self.library = _library(path)
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Of the runs; and special strings, each one token as the library has it."""
        if not self.split or not self.split.search(text):
            return Counter(runs_of(text)), 0
        parts = self.split.split(text)
        return Counter(y for x in parts for y in runs_of(x)), len(parts) - 1

    def pieces(self, runs: list[str]) -> list[int]:
        found = []
        for at in range(0, len(runs), 4096):
            found += map(len, self.library.encode_batch_fast(runs[at : at + 4096], add_special_tokens=False))
        return found


@functools.cache
def _counts(path: str) -> _Counts:
    return _Counts(path)


#: Longer pre-tokens are counted where they stand: as keys they would cost more than counting them again.
LONG_RUN = 64
#: Frequent pre-tokens, each more than one in so many of all: there can be no more of them than this.
FREQUENT = 1_000_000


def distinct_runs(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``run``, ``n``, ``pieces``: each distinct pre-token of all texts of at most ``LONG_RUN`` characters, how often it
    occurs, and its number of tokens, counted once. Tasks add up what they meet before the shuffle."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, met = _counts(path), Counter()

        def told() -> pa.RecordBatch:
            found = [(k, n) for k, n in met.items() if len(k) <= LONG_RUN]
            runs, n = zip(*found, strict=True) if found else ((), ())
            met.clear()
            return pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(n, pa.int64())], ["run", "n"])

        for batch in batches:
            for text in batch.column(0):
                met.update(store.frequencies(text.as_py() or "")[0])
                if len(met) > REMEMBERED:
                    yield told()
        yield told()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(_counts(path).pieces(batch.column(0).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], ["run", "n", "pieces"])

    met = df.select(text_col).mapInArrow(meet, "run string, n long").groupBy("run").agg(F.sum("n").alias("n"))
    return met.mapInArrow(count, "run string, n long, pieces long")


def token_counts(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """``id``, ``n_bytes`` (UTF-8), ``n_tokens`` of each text by the byte-level vocabulary file at ``path``.

    Pieces are counted once for each distinct pre-token (a run between safe boundaries, which no token spans) of all
    texts, joined to the frequencies of each text's pre-tokens, and summed; ids are never kept. The join has two ways: a
    pre-token that makes up more than one in ``frequent`` of all is sent to the tasks that split the texts (there are fewer
    than ``frequent`` such, of 64 characters at most), the others meet in a shuffle, where none is a large group.
    Pre-tokens of more than 64 characters are counted in their text. Strings of the vocabulary's added tokens count as one
    token each, as the library has it by default. Null and empty texts have none. Repeated ids give repeated rows, null
    ids are kept; other columns are not read.
    """
    known = written(distinct_runs(df, path, text_col))
    least = (known.agg(F.sum("n")).first()[0] or 0) // frequent
    often = dict(known.where(F.col("n") > least).select("run", "pieces").collect())
    sent = df.sparkSession.sparkContext.broadcast(often)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, often = _counts(path), sent.value
        for batch in batches:
            rows, runs, counts, totals, sizes = [], [], [], [], []
            numbers = batch.column(0).to_pylist()
            for row, text in zip(numbers, batch.column(2), strict=True):
                text = text.as_py() or ""
                found, total = store.frequencies(text)
                for run, n in found.items():
                    if pieces := often.get(run):
                        total += pieces * n
                    elif len(run) > LONG_RUN:
                        total += store.pieces([run])[0] * n
                    else:
                        rows.append(row)
                        runs.append(run)
                        counts.append(n)
                totals.append(total)
                sizes.append(len(text.encode()))
            # A text's own row has a key that no run equals (white space behind something else), and what it counted so far.
            own = [batch.column(0), batch.column(1), sizes, [f"= {row}" for row in numbers], totals]
            none = pa.nulls(len(rows), batch.schema.field(1).type), pa.nulls(len(rows), pa.int64())
            for columns in (own, [rows, *none, runs, counts]):
                kinds = (pa.int64(), batch.schema.field(1).type, pa.int64(), pa.string(), pa.int64())
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "id", "n_bytes", "run", "n"])

    numbered = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = schema_of(numbered, {"row": "row", "id": "id"}, "n_bytes long, run string, n long")
    parts = numbered.mapInArrow(count, schema).join(known.where(F.col("n") <= least).select("run", "pieces"), "run", "left")
    sums = parts.groupBy("row").agg(
        F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens")
    )
    return sums.select("id", "n_bytes", "n_tokens")


@functools.cache
def _as_bytes() -> dict[int, str]:
    """What byte-level vocabularies write for each byte: printable characters of Latin-1 as they are, others from U+0100 on (fixed values)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words:
    """Packed ids of each distinct word, encoded once while remembered."""

    def __init__(self, path: str):
        self.library = _library(path)
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.packed = [i.to_bytes(4, "little") for i in range(size)]

    def encode(self, words: list[str]) -> None:
        for at in range(0, len(words), 1024):
            part = words[at : at + 1024]
            for word, found in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[word] = np.asarray(found.ids, "<u4").tobytes()

    def merge(self, words: list[str]) -> None:
        """Words of ``LATIN`` go to the vocabulary's merges at once: there is nothing to normalise or to cut."""
        tokenize, packed, table = self.library.model.tokenize, self.packed, _as_bytes()
        for word in words:
            own = word if word.isascii() else word.encode().decode("latin-1").translate(table)
            self.known[word] = b"".join([packed[x.id] for x in tokenize(own)])

    def learn(self, words: set[str]) -> None:
        """A word of letters only is one pre-token, so many are encoded as one text and told apart by their last
        tokens; one mark behind letters is a pre-token of its own."""
        marked = {x for x in words if len(x) > 1 and x[-1] in MARKS and x[:-1].isalpha()}
        wanted = {x for x in words - marked if x.isalpha()} | {x[:-1] for x in marked}
        self.recall(wanted)
        letters = [x for x in wanted if x not in self.known]
        latin = LATIN.fullmatch
        self.merge([x for x in letters if latin(x)])
        letters = [x for x in letters if not latin(x)]
        self.encode([x for x in words - marked if not x.isalpha()] + [x for x in MARKS if x not in self.known])
        for at in range(0, len(letters), 512):
            part = letters[at : at + 512]
            ids = np.asarray(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                self.encode(part)
                continue
            data, start = ids.tobytes(), 0
            for word, end in zip(part, (4 * ends).tolist(), strict=True):
                self.known[word] = data[start:end]
                start = end
        for word in marked:
            self.known[word] = self.known[word[:-1]] + self.known[word[-1]]

    def recall(self, words: set[str]) -> None:
        """Words of the older generation that are met again become part of the newer one."""
        if self.older:
            older, known = self.older, self.known
            for word in words:
                if word not in known and (found := older.get(word)) is not None:
                    known[word] = found

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        # The library lower-cases each character by itself; only these two may then differ.
        plain = "\u03a3" not in text and "\u0130" not in text and unicodedata.is_normalized("NFC", text)
        text = text.lower() if plain else text
        words = WORDS.findall(text) if SEPARATORS.search(text) else text.split()
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > GENERATION:
                self.older, self.known = self.known, {}
            new = {x for x in words if x not in self.known}
            self.recall(new)
            new = {x for x in new if x not in self.known}
            self.learn(new) if plain else self.encode(list(new))
            return b"".join(map(self.known.__getitem__, words))


@functools.cache
def _words(path: str) -> _Words:
    return _Words(path)


def token_pieces(
    df: DataFrame, path: str, capacity: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of the pieces of each text's ids.

    The vocabulary at ``path`` must drop white space and join nothing across it; a word is then encoded once while the
    worker remembers it. ``end_id`` follows the ids of a text, so a null or empty text is one piece of length 1. Only
    texts of more than ``capacity`` ids are cut, into pieces of ``capacity`` and a shorter last one. Repeated ids give
    repeated rows; other columns are not read.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def work(batch: pa.RecordBatch) -> dict:
        encode = _words(path)
        ids, rows = [], []
        for at, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = encode(text.as_py() or "") + end
            for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                part = data[start : start + 4 * capacity]
                ids.append(at)
                rows.append((piece, start // 4, len(part) // 4, zlib.crc32(part)))
        table = np.array(rows, np.int64).reshape(-1, 4)
        names = ("piece", "start", "length", "ids_crc32")
        found = {k: pa.array(table[:, i], pa.int32() if k == "piece" else pa.int64()) for i, k in enumerate(names)}
        return {"id": pa.array(ids, batch.schema.field(0).type)} | found

    schema = schema_of(df, {"id": id_col}, "piece int, start long, length long, ids_crc32 long")
    return mapped(df, [id_col, text_col], schema, work)
