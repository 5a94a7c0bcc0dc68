"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import schema_of
from .sampling import labelled_texts

#: Lengths, in bytes, of the character n-grams.
GRAMS = (3, 4, 5)
#: Log of the number of hashed vectors.
BUCKET_BITS = 17
DIMENSIONS = 12
#: The bucket of words that repeat the word before them.
AGAIN = (1 << BUCKET_BITS) - 1
#: Stands between texts hashed together; UTF-8 has no such byte.
BETWEEN = b" \xff "
#: Bytes hashed at a time.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint32(2654435761)


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    size = PIECE + 64
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))])
    return up, down


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text's bytes in pieces of at most ``PIECE``, cut behind a space if there is one."""
    at = 0
    while len(data) - at > PIECE:
        cut = data.rfind(b" ", at, at + PIECE) + 1
        cut = cut if cut > at else at + PIECE
        yield data[at:cut]
        at = cut
    yield data[at:]


def _hashed(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray | None, int]]:
    """Buckets, first bytes (None: every byte) and widths (words: 1) of the words, of words said twice, of the n-grams."""
    b = np.frombuffer(data, np.uint8)
    shift = np.uint32(32 - BUCKET_BITS)
    with np.errstate(over="ignore"):
        space = b <= 32
        starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
        ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
        up, down = _powers()
        sums = np.r_[np.uint64(0), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)]
        h = ((sums[ends] - sums[starts]) * down[starts]) * _BASE >> np.uint64(32)
        yield (h.astype(np.uint32) >> shift).astype(np.int32), starts, 1
        again = starts[1:][h[1:] == h[:-1]]
        yield np.full(len(again), AGAIN, np.int32), again, 1
        h = b.astype(np.uint32)
        for n in range(2, max(GRAMS) + 1):
            if len(b) < n:
                return
            h = (h[:-1] * np.uint32(16777619)) ^ b[n - 1 :]
            if n in GRAMS:
                yield ((h + np.uint32(n)) * _MIX >> shift).astype(np.int32), None, n


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's words and n-grams, and the share of the text's features in each."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for piece in _pieces(text.encode()):
        for buckets, *_ in _hashed(piece):
            counts += np.bincount(buckets, minlength=len(counts))
    found = np.flatnonzero(counts)
    return found.astype(np.int32), (counts[found] / max(1, counts.sum())).astype(np.float32)


@dataclass
class QualityModel:
    """Since a text's vector is the mean of its features' vectors, and the output is linear in it, the difference of
    the two classes' logits is the mean of one number a feature: ``weights``, by bucket. ``bias`` is added."""

    weights: np.ndarray
    bias: float


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 3.0, seed: int = 1) -> QualityModel:
    """Learned vectors of hashed features, averaged per text, into a softmax of two classes; one text at a time."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, buckets, shares = rows[i]
            own = vectors[buckets]
            hidden = shares @ own
            logits = hidden @ out + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            now = rate * (1 - step / steps)
            step += 1
            back = out @ error
            out -= now * np.outer(hidden, error)
            bias -= 0.1 * now * error
            # A feature's own step is scaled by its share's root, or rare features of long texts would hardly learn.
            vectors[buckets] = own - now * np.outer(np.sqrt(shares), back)
    return QualityModel((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = 1500,
) -> QualityModel:
    """Fit on about ``sample`` labelled documents of each class at most, chosen by a hash of their id, by whole texts.

    The features are made in the tasks; what comes to the driver is at most one number a bucket for each sampled text.
    Labels other than 0 and 1 are ignored. Without labelled rows of both classes all texts score alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([x.tobytes() for x, _ in found], pa.binary()),
                    pa.array([x.tobytes() for _, x in found], pa.binary()),
                ],
                ["id", "label", "buckets", "shares"],
            )

    texts = labelled_texts(docs, labels.where(F.col(label_col).isin(0, 1)), label_col, sample, id_col, text_col)
    rows = texts.mapInArrow(run, schema_of(texts, {"id": "id"}, "label int, buckets binary, shares binary")).collect()
    rows.sort(key=lambda r: str(r[0]))
    found = [(r[1], np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in rows]
    if len({x[0] for x in found}) < 2:
        return QualityModel(np.zeros(1 << BUCKET_BITS, np.float32), 0.0)
    return train(found)


def _scores(texts: list[str], model: QualityModel) -> list[float]:
    sums, counts = np.zeros(len(texts)), np.zeros(len(texts))

    def add(data: list[bytes], own: list[int]) -> None:
        joined = BETWEEN.join(data)
        if not joined:
            return
        ends = np.cumsum([len(x) + len(BETWEEN) for x in data]) - len(BETWEEN)
        starts = ends - [len(x) for x in data]
        for buckets, first, width in _hashed(joined):
            total = np.r_[0.0, np.cumsum(model.weights[buckets], dtype=np.float64)]
            last = np.maximum(starts, ends - width + 1)  # an n-gram that begins later ends in the next text
            if first is not None:
                a, b = np.searchsorted(first, starts), np.searchsorted(first, last)
            else:  # the last texts may be shorter than an n-gram
                a, b = np.minimum(starts, len(total) - 1), np.minimum(last, len(total) - 1)
            np.add.at(sums, own, total[b] - total[a])
            np.add.at(counts, own, b - a)

    data: list[bytes] = []
    own: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in _pieces(text.encode()):
            if size + len(piece) + len(BETWEEN) > PIECE + 48 and data:
                add(data, own)
                data, own, size = [], [], 0
            data.append(piece)
            own.append(i)
            size += len(piece) + len(BETWEEN)
    if data:
        add(data, own)
    logits = sums / np.maximum(counts, 1) + model.bias
    return (1 / (1 + np.exp(-np.clip(logits, -500, 500)))).tolist()


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``score`` (0 to 1, higher: class 1 likelier) of each text, from the whole text only.

    Null and empty texts have no features and score what the bias alone gives. A text of over a mebibyte is hashed in
    pieces cut behind a space; n-grams across a cut don't count. Repeated ids give repeated rows; other columns are not
    read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores([x or "" for x in batch.column(1).to_pylist()], sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, schema_of(docs, {"id": id_col}, "score double"))
