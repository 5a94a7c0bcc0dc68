import random

import numpy as np
import pytest
from conftest import CLASHING

from pyspark.sql import functions as F

from sluice.llm.langid import UNDETERMINED, fit_language_model, predict_language
from sluice.llm.quality import BUCKET_BITS, PIECE, QualityModel, _scores, features, fit_quality, score_quality
from sluice.llm.toxicity import Distance, dictionary_of, fit_toxicity, score_toxicity, window_of

ODD = [None, "", " \n", "12 34 !?", "a", "é", "x" * 200_000, "日本語", "\x00", "word " * 50_000]


def words(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language(docs):
    rng = random.Random(1)
    kinds = {"aa": ["the", "ing", "er"], "bb": ["que", "eau", "le"], "cc": ["sch", "ung", "ei"]}
    texts, langs = [], []
    for lang, syllables in kinds.items():
        for _ in range(40):
            texts.append(words(rng, syllables, 60))
            langs.append(lang)
    model = fit_language_model(docs(texts, langs, CLASHING))
    assert model.languages == sorted(kinds)
    new = [words(rng, s, 20) for s in kinds.values()] + [words(rng, s, 20).upper() for s in kinds.values()]
    rows = {r.id: r for r in predict_language(docs(new + ODD, extra=CLASHING), model).collect()}
    assert [rows[i].lang_pred for i in range(6)] == list(kinds) * 2
    for i in range(6, 10):
        assert rows[i].lang_pred == UNDETERMINED and rows[i].score == 0
    assert all(r.lang_pred in kinds and 0 <= r.score <= 1 for r in rows.values() if r.id >= 10 and r.id != 14)
    assert rows[14].lang_pred == UNDETERMINED  # a control character is no letter


def test_language_without_rows(docs):
    model = fit_language_model(docs([]))
    assert [r.lang_pred for r in predict_language(docs(["text"]), model).collect()] == [UNDETERMINED]
    assert predict_language(docs([]), model).count() == 0


def test_seen_words_come_before_their_letters(docs):
    texts, langs = ["zzz"] * 9 + ["abab " * 9] * 9, ["xx"] * 9 + ["yy"] * 9
    model = fit_language_model(docs(texts, langs))
    found = predict_language(docs(["zzz", "zzzz", "abababab"]), model).orderBy("id").collect()
    assert [r.lang_pred for r in found] == ["xx", "xx", "yy"]


def test_quality(spark, docs):
    rng = random.Random(2)
    good = [words(rng, ["the", "ing", "er", "an"], 80) + "." for _ in range(60)]
    junk = [" ".join(f"{w}%%%" for w in words(rng, ["the", "ing", "er", "an"], 80).split()) for _ in range(30)]
    junk += [" ".join([w] * 9) for w in words(rng, ["the", "ing", "er", "an"], 30).split()]
    own = docs(good + junk, extra=CLASHING)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    model = fit_quality(own, labels.where("doc_id % 3 <> 0"))
    scores = {r.id: r.score for r in score_quality(own, model).collect()}
    held = range(0, 120, 3)
    assert np.mean([(scores[i] >= 0.3) == (i < 60) for i in held]) > 0.9
    odd = score_quality(docs(ODD, extra=CLASHING), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert score_quality(docs([]), model).count() == 0
    same = fit_quality(own, labels.where("quality = 1"))
    assert len({round(r.score, 6) for r in score_quality(own, same).collect()}) == 1


@pytest.mark.parametrize("texts", [["one two two", "", "é", "two one", "x" * 9], ["word " * (PIECE // 4), "a b"]])
def test_scores_are_the_mean_of_the_features(texts):
    weights = np.random.default_rng(0).normal(size=1 << BUCKET_BITS).astype(np.float32)
    model = QualityModel(weights, 0.1)
    for text, score in zip(texts, _scores(texts, model), strict=True):
        buckets, shares = features(text)
        logit = float((weights[buckets].astype(float) * shares).sum()) + 0.1
        assert score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-4)


def test_toxicity(spark, docs):
    rng = random.Random(3)
    bad = ["idiot", "scum", "worthless", "vequaire"]
    texts, labels = [], []
    for i in range(240):
        own = words(rng, ["the", "ing", "er", "an", "on", "sh"], 70).split()
        if i % 4 == 0:
            for _ in range(4):
                own[rng.randrange(70)] = rng.choice(bad)
        texts.append(" ".join(own))
        labels.append((i, 1, int(i % 4 == 0)))
    own = docs(texts, extra=CLASHING)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit_toxicity(own, table.where("doc_id % 3 <> 1"))
    rows = {r.id: r.score for r in score_toxicity(own, model).collect()}
    held = [i for i in range(240) if i % 3 == 1]
    assert np.mean([(rows[i] >= 0.7) == (i % 4 == 0) for i in held]) > 0.9
    odd = score_toxicity(docs(ODD, extra=CLASHING), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score < 0.7 for r in odd)
    assert score_toxicity(docs([]), model).count() == 0
    nothing = fit_toxicity(own, table.where("toxic = 0"))
    assert all(r.score < 0.7 for r in score_toxicity(own, nothing).collect())


def test_windows_are_shorter_with_their_own_dictionary():
    toxic, ordinary = [("idiot", 9), ("scum", 5)], [("thering", 9), ("ander", 8)]
    d = Distance(dictionary_of(toxic), dictionary_of(ordinary))
    assert d.of("idiot") > 0.5 and d.of("scum") > 0.5
    assert d.of("thering") == 0 and d.of("oningsh") < 0.5
    assert len(window_of("é" * 40)) >= 24


def test_held_out_accuracy(spark):
    from sluice.llm.queries import queries

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    found = queries()["op8_language"](spark, sf).where("held_out").join(docs, "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    for name, label in (("op1_quality", "quality"), ("op4_toxicity", "toxic")):
        found = queries()[name](spark, sf).where("held_out").join(labels, "doc_id")
        assert found.agg(F.avg((F.col(label) == F.col("predicted")).cast("int"))).first()[0] > 0.93
