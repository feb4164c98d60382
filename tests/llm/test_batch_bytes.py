"""Workers get small Arrow batches, however long the texts of a partition are."""

import pyarrow as pa

import corpus_pipeline
from tallyfield.llm import common, packing


def largest(docs):
    def run(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    return docs.mapInArrow(run, "n long").agg({"n": "max"}).first()[0]


def long_texts(session):
    return session.range(2000, numPartitions=1).selectExpr("id as doc_id", "repeat('some words ', 1000) as text")  # 22 MB


def test_packing_limits_batches(spark):
    docs = long_texts(spark.newSession())
    packing.pack(docs)
    assert largest(docs) < common.SLICE_BYTES


def test_stages_and_tables_limit_batches(spark):
    for use in (
        lambda s: common.table(s, "/root/testdata/sf0.001", "documents"),
        lambda s: corpus_pipeline.near_copies(s, s.createDataFrame([(1, "a b c")], "doc_id long, text string"), ""),
        lambda s: corpus_pipeline.pii_masking(s, s.createDataFrame([(1, "a b c", 5)], "doc_id long, text string, n_chars long"), ""),
    ):
        session = spark.newSession()
        use(session)
        assert largest(long_texts(session)) < common.SLICE_BYTES


def test_own_limit_stays(spark):
    session = spark.newSession()
    session.conf.set(common.BATCH_SETTING, "1m")
    packing.pack(long_texts(session))
    assert session.conf.get(common.BATCH_SETTING) == "1m"
