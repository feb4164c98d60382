"""The pipeline on the smallest tables: each stage keeps its columns, and the packed pieces hold the masked texts of the documents that stayed."""

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from tallyfield.llm import jaccard
from tallyfield.llm.common import table
from tallyfield.llm.tokens import default_tokenizer, encoder

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        kept.append(docs.count())
        if name == "near_copies":
            assert docs.count() == jaccard.near_duplicates(before).select("component_id").distinct().count()
    assert kept[0] == kept[1] > kept[2] >= kept[3] == kept[4]
    e = encoder(default_tokenizer())
    expected = {r["doc_id"]: e.encode([r["text"] or ""])[0].tolist() + [0] for r in docs.collect()}
    got = {}
    for r in sorted(corpus_pipeline.packed(spark, docs, SF).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(bytes(r["ids"]), "<u4").tolist())
    assert got == expected


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
