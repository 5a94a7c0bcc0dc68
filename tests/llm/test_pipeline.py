import corpus_pipeline
from conftest import CLASHING
from pyspark.sql import functions as F

from sluice.llm.exact_dedup import exact_duplicates
from sluice.llm.langid import fit_language_model, predict_language

SF = "/root/testdata/sf0.01"


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(3).select(F.col("doc_id") + 10_000, F.lit(None).cast("string"), "lang", "source", "n_chars").toDF(*docs.columns))
    docs = docs.withColumns({c: F.lit(1) for c in CLASHING})
    before = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.toArrow())
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert len(ids) == after.count() and ids <= {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language":
            model = fit_language_model(docs)
            want = predict_language(docs, model).where("lang_pred <> 'und' and score >= 0.5").collect()
            assert ids == {r.id for r in want} and not any(i >= 10_000 for i in ids)
        if name == "exact":
            assert ids == {r.id for r in exact_duplicates(docs).where("kept").collect()}
        same = after.join(before.select("doc_id", F.col("text").alias("t")), "doc_id").where(~F.col("text").eqNullSafe(F.col("t")))
        assert same.count() == 0
        docs = after
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
