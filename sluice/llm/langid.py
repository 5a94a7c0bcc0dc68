"""Language identification by word-first backoff."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import schema_of, written
from .sampling import picked_by_class

WORDS = re.compile(r"[^\W\d_]+")
#: Longest and shortest character n-grams tried for a word that is not known.
ORDERS = (5, 4, 3, 2, 1)
#: Words whose evidence counts in the score; more would only saturate it.
SATURATED = 20
REMEMBERED = 100_000
#: Words that a task cuts into n-grams at once.
WORDS_AT_ONCE = 1_000
UNDETERMINED = "und"


def words_of(text: str) -> list[str]:
    found = WORDS.findall(text.lower())
    return found if any(c.isalpha() for w in found for c in w) else []


def grams_of(word: str, order: int) -> list[str]:
    word = f"\x02{word}\x03" if order > 1 else word
    return [word[i : i + order] for i in range(len(word) - order + 1)]


@dataclass
class LanguageModel:
    """Log frequencies, one row a known word or n-gram, one column a language."""

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray


def _table(counts: DataFrame, name: str, languages: list[str], size: int) -> tuple[dict[str, int], np.ndarray]:
    """The ``size`` most frequent names of each language and their smoothed log frequencies in every language."""
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), name))
    best = counts.withColumn("_rank", rank).where(F.col("_rank") <= size).select(name).distinct()
    sums = [F.sum(F.when(F.col("lang") == x, F.col("n"))).alias(f"n{i}") for i, x in enumerate(languages)]
    top = counts.join(best, name).groupBy(name).agg(F.sum("n").alias("n"), *sums).orderBy(name).toPandas()
    n = top[[f"n{i}" for i in range(len(languages))]].fillna(0).to_numpy(np.float64).reshape(len(top), len(languages))
    total = np.array([totals.get(x, 0) for x in languages], np.float64)
    scores = np.log((n + 0.1) / (total + 0.1 * (len(top) + 1))).astype(np.float32)
    return {x: i for i, x in enumerate(top[name])}, scores


def fit_language_model(
    docs: DataFrame,
    lang_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = 2000,
    most_words: int = 15_000,
    most_grams: int = 30_000,
) -> LanguageModel:
    """Count words and character n-grams of about ``sample`` documents of each language, chosen by a hash of their id.

    Whole texts are counted, in Spark; the model keeps the ``most_words`` and ``most_grams`` most frequent ones of each
    language, so that no language crowds out another one; this bounds what is collected and sent to the tasks. Rows without language or text teach nothing. Without any rows the
    model knows no language.
    """
    condition = picked_by_class(docs.select(id_col, lang_col), lang_col, sample, id_col)
    picked = docs.where(condition & F.col(text_col).isNotNull()).select(lang_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.update((lang, w) for w in words_of(text.as_py()))
            keys = list(found)
            yield pa.RecordBatch.from_pydict(
                {"lang": [k[0] for k in keys], "word": [k[1] for k in keys], "n": pa.array([found[k] for k in keys], pa.int64())},
                pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]),
            )

    words = written(
        picked.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(at, WORDS_AT_ONCE) for x in batches for at in range(0, x.num_rows, WORDS_AT_ONCE)):
            rows = [
                (lang, gram, n)
                for lang, word, n in zip(*(x.to_pylist() for x in batch.columns), strict=True)
                for order in ORDERS
                for gram in grams_of(word, order)
            ]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())],
                ["lang", "gram", "n"],
            )

    grams = words.mapInArrow(split, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    return LanguageModel(
        languages, *_table(words, "word", languages, most_words), *_table(written(grams), "gram", languages, most_grams)
    )


class _Scorer:
    """Scores of known words, and of unseen ones as long as they are remembered."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.known = dict(model.words)
        self.first = len(self.known)
        self.scores = np.empty((self.first + REMEMBERED, len(model.languages)), np.float32)
        self.scores[: self.first] = model.word_scores
        self.floor = len(model.grams)
        lowest = model.gram_scores.min() if self.floor else 0.0
        self.grams = np.vstack([model.gram_scores, np.full((1, len(model.languages)), lowest, np.float32)])

    def backoff(self, word: str) -> list[int]:
        """The word's known n-grams of the longest order that has any."""
        known = self.model.grams
        for order in ORDERS:
            if found := [known[x] for x in grams_of(word, order) if x in known]:
                return found
        return [self.floor]

    def learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > len(self.scores):  # one text with more unseen words than are remembered
            self.scores = np.vstack([self.scores[: self.first], np.empty((len(words), self.scores.shape[1]), np.float32)])
        found = [self.backoff(x) for x in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((y for x in found for y in x), np.int64, int(sizes.sum()))
        at = len(self.known)
        sums = np.add.reduceat(self.grams[flat], np.cumsum(sizes) - sizes, axis=0)
        self.scores[at : at + len(words)] = sums / sizes[:, None]
        self.known.update(zip(words, range(at, at + len(words)), strict=True))

    def __call__(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0
        if new := {x for x in words if x not in self.known}:
            if len(self.known) + len(new) > len(self.scores):
                self.known = dict(self.model.words)
                new = {x for x in words if x not in self.known}
            self.learn(sorted(new))
        rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        mean = np.zeros(len(self.model.languages))
        for at in range(0, len(rows), 1 << 16):
            mean += self.scores[rows[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        mean /= len(rows)
        weight = np.exp((mean - mean.max()) * min(len(words), SATURATED))
        best = int(mean.argmax())
        return self.model.languages[best], float(weight[best] / weight.sum())


def predict_language(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``lang_pred``, ``score`` (0 to 1) of each text, from the whole text only.

    A known word adds its log frequency in each language; any other one the mean of its longest character n-grams that
    the model knows. Texts that are null or have no letter are ``und`` with score 0. Of languages that score alike the
    first in order is taken. Repeated ids give repeated rows; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(sent.value)
        for batch in batches:
            found = [score(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["id", "lang_pred", "score"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema_of(docs, {"id": id_col}, "lang_pred string, score double"))
