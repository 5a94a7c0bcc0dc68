import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    def make(texts, lang="en", extra=()):
        rows = [(i, t, lang if isinstance(lang, str) else lang[i], "src0", len(t or "")) for i, t in enumerate(texts)]
        found = spark.createDataFrame(rows, SCHEMA)
        for name in extra:  # names that the operators use themselves
            from pyspark.sql import functions as F

            found = found.withColumn(name, F.lit(7))
        return found

    return make


#: Names of columns inside the operators.
CLASHING = ("id", "len", "prefix", "digest", "key", "node", "fp0", "group", "label", "word", "n", "row", "piece", "length", "_task", "score")
