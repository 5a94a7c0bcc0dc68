"""Toxicity by compression distance: separate zstandard dictionaries of toxic and of ordinary text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import schema_of, written
from .sampling import labelled_texts

WORDS = re.compile(r"[^\W\d_]{3,}")
#: A window is a word, repeated with a space to at least so many bytes: zstandard's headers hide shorter ones.
WINDOW = 24
#: Bytes of the part of a dictionary that zstandard trains; behind it stand all windows that were chosen.
TRAINED = 8_192
#: Compression level; lower ones miss matches in texts as short as a window.
LEVEL = 5
REMEMBERED = 100_000
#: Settings that a task holds at once.
SETTINGS_AT_ONCE = 50_000
#: Settings that a word of a toxic dictionary may be required to stand in, in half of the sample.
LEAST = (2, 3, 4, 6, 10)
#: Of a text, how many of the windows most like toxic text count.
STRONGEST = 3


def window_of(word: str) -> bytes:
    data = word.encode() + b" "
    return data * max(3, -(-WINDOW // len(data)))


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


@dataclass
class ToxicityModel:
    """Two dictionaries, and weights that make a probability of a text's strongest windows."""

    toxic: bytes
    ordinary: bytes
    weights: list[float]
    bias: float


def dictionary_of(words: list[tuple[str, int]]) -> bytes:
    """A dictionary trained on the words' windows, each as often as it occurs; behind it stand the windows that
    training left out, the most frequent last."""
    windows = [(window_of(w), n) for w, n in sorted(words, key=lambda x: (x[1], x[0]))]
    content = b""
    try:
        samples = [x for x, n in windows for _ in range(min(n, 30))]
        content = zstandard.train_dictionary(TRAINED, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        pass
    return content + b"".join(x for x, _ in windows)


class Distance:
    """How much shorter a word's window gets with the toxic dictionary than with the ordinary one, as a share of what
    the whole word costs."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = self._compressor(toxic), self._compressor(ordinary)
        self.known: dict[str, float] = {}

    @staticmethod
    def _compressor(content: bytes):
        if len(content) < 8:
            content = b"\0" * 8
        options = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=WINDOW, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0
        )
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(compression_params=options)
        return zstandard.ZstdCompressor(dict_data=own, compression_params=options).compress

    def of(self, word: str) -> float:
        window = window_of(word)
        size = len(word.encode()) + 1
        toxic = len(self.toxic(window))
        # Without a match a window takes its first word and some 14 bytes: if it is no shorter, the rest doesn't matter.
        if toxic >= size + 13:
            return 0.0
        return max(0.0, (len(self.ordinary(window)) - toxic) / size)

    def strongest(self, text: str) -> list[float]:
        """The largest distances of the text's distinct words."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, found = self.known, []
        for word in set(words_of(text)):
            value = known.get(word)
            if value is None:
                value = known[word] = self.of(word)
            if value > 0.3:
                found.append(value)
        return (sorted(found, reverse=True) + [0.0] * STRONGEST)[:STRONGEST]


def settings_of(texts: DataFrame) -> DataFrame:
    """``word``, ``half``, ``toxic``, ``ordinary``: in how many settings (pairs of neighbours) a word stands.

    A setting counts once, so passages that many texts share, and copies, count once.
    """

    def told(rows: set) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["word", "label", "half", "at"])

    def settings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: set = set()
        for batch in batches:
            for label, half, text in zip(*batch.columns, strict=True):
                label, half, words = label.as_py(), half.as_py(), words_of(text.as_py())
                for at in range(0, len(words), SETTINGS_AT_ONCE):
                    own, end = words[at : at + SETTINGS_AT_ONCE], at + SETTINGS_AT_ONCE
                    before, after = words[max(0, at - 1) : end - 1] if at else ["", *own[:-1]], [*words[at + 1 : end + 1], ""]
                    rows.update((w, label, half, f"{a} {b}") for a, w, b in zip(before, own, after, strict=False))
                    if len(rows) >= SETTINGS_AT_ONCE:
                        yield told(rows)
                        rows.clear()
        yield told(rows)

    found = texts.select("label", "half", "text").mapInArrow(settings, "word string, label int, half int, at string")
    found = found.select("word", "label", "half", F.xxhash64("at").alias("at")).distinct()
    return found.groupBy("word", "half").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("ordinary"))


def telling_words(counts: DataFrame, least: int, ratio: float = 10.0) -> tuple[list, list]:
    """Words (with counts) of toxic texts that ordinary ones lack, and as many of the most frequent ordinary words (100 at
    least), so that neither dictionary is favoured. The sample's rows bound both.

    Toxic ones stand in ``least`` settings or more and, by share, ``ratio`` times as often as in ordinary texts.
    """
    toxic, ordinary = counts.agg(F.sum("toxic"), F.sum("ordinary")).first()
    if not toxic or not ordinary:
        return [], []
    often = (F.col("toxic") + 0.5) / toxic > ratio * (F.col("ordinary") + 0.5) / ordinary
    bad = counts.where(often & (F.col("toxic") >= least)).orderBy(F.desc("toxic"), "word").collect()
    good = counts.where(~often).orderBy(F.desc("ordinary"), "word").limit(max(100, len(bad))).collect()
    return [(r["word"], r["toxic"]) for r in bad], [(r["word"], r["ordinary"]) for r in good]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Weights and, last, the bias by Newton's method; both classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + ridge * np.r_[w[:-1], 0] / 100
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * ridge / 100
        w -= np.linalg.solve(curve, slope)
    return w


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Mean of the classes' logarithmic losses."""
    p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
    return -float(np.log(p[y == 1]).mean() + np.log(1 - p[y == 0]).mean())


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = 4000,
) -> ToxicityModel:
    """Dictionaries and threshold from about ``sample`` labelled documents of each class at most, whole texts.

    Words are counted in Spark; to the driver come the windows of the dictionaries and, to calibrate, a few numbers for
    each sampled text. Labels other than 0 and 1 are ignored. Without rows of both classes all texts score 0.
    """
    texts = labelled_texts(docs, labels.where(F.col(label_col).isin(0, 1)), label_col, sample, id_col, text_col)
    texts = written(texts.select("label", "text", F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)).cast("int").alias("half")))
    counts = written(settings_of(texts))

    def model_of(bad: list, good: list, least: int) -> ToxicityModel:
        bad = [x for x in bad if x[1] >= least]
        good = good[: max(100, len(bad))]
        return ToxicityModel(dictionary_of(bad), dictionary_of(good), [0.0] * STRONGEST, 0.0)

    def strongest(texts: DataFrame, models: list[ToxicityModel]) -> tuple[np.ndarray, np.ndarray]:
        """Labels, and what each model finds in each text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            distances = [Distance(m.toxic, m.ordinary) for m in models]
            for batch in batches:
                rows = [[y for d in distances for y in d.strongest(x.as_py())] for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])

        rows = texts.select("label", "text").mapInArrow(run, "label int, x array<double>").collect()
        return np.array([r["label"] for r in rows]), np.array([r["x"] for r in rows]).reshape(len(rows), len(models), STRONGEST)

    # How rare a word may be is settled on the half of the sample that the trial dictionaries haven't seen.
    bad, good = telling_words(counts.where("half = 0"), LEAST[0])
    best = 0
    if bad:
        y, x = strongest(texts.where("half = 1"), [model_of(bad, good, n) for n in LEAST])
        if 0 < y.sum() < len(y):
            losses = [_loss(x[:, k], y, _logistic(x[:, k], y)) for k in range(len(LEAST))]
            best = int(np.argmin(losses))
    both = counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    bad, good = telling_words(both, 2 * LEAST[best])
    if not bad:
        return ToxicityModel(b"", b"", [0.0] * STRONGEST, -5.0)
    model = model_of(bad, good, 0)
    y, x = strongest(texts, [model])
    w = _logistic(x[:, 0], y)
    model.weights, model.bias = w[:-1].tolist(), float(w[-1])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``score`` (0 to 1, higher: toxic likelier) of each text, from all windows of the whole text.

    Windows are the text's distinct words of three letters or more, in lower case. Null and empty texts, and those
    without such words, have no windows and score what the bias alone gives. Repeated ids give repeated rows; other
    columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        distance = Distance(model.toxic, model.ordinary)
        weights = np.array(model.weights)
        for batch in batches:
            x = np.array([distance.strongest(t.as_py() or "") for t in batch.column(1)]).reshape(-1, STRONGEST)
            scores = 1 / (1 + np.exp(-np.clip(x @ weights + model.bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["id", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, schema_of(docs, {"id": id_col}, "score double"))
