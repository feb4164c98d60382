"""What the stages gather comes to the driver as Arrow batches, not as objects of rows."""

import pytest
from pyspark.sql.classic.dataframe import DataFrame

import corpus_pipeline
from tallyfield.llm import common, jaccard, language

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rows_gathered(monkeypatch):
    """How many rows each collect() and toPandas() gave."""
    seen = []
    for name in ("collect", "toPandas"):
        def counted(self, *args, own=getattr(DataFrame, name), **named):
            out = own(self, *args, **named)
            seen.append(len(out))
            return out

        monkeypatch.setattr(DataFrame, name, counted)
    return seen


def test_models_and_lists_come_as_batches(spark, rows_gathered):
    docs = common.table(spark, SF, "documents")
    language.fit(docs)
    assert max(rows_gathered) < 10
    jaccard.near_duplicates(docs).count()
    assert max(rows_gathered) < 10


def test_fit_of_one_and_of_no_language(spark):
    docs = spark.createDataFrame([(i, "one text of words " * 3, "en") for i in range(20)], "doc_id long, text string, lang string")
    assert set(language.fit(docs).languages) == {"en"}
    assert language.fit(docs.where("false")).languages == []
    assert corpus_pipeline.language_id(spark, docs, SF).count() == 20
