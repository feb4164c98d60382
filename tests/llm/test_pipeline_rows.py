"""Every filtering stage decides row by row: null ids, ids used twice, repeated rows, odd column names, empty tables."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, n_chars int, row_key string, rows string, n string, root string, contaminated string"


def _words(seed: int, n: int = 60) -> str:
    return " ".join(f"w{(seed * 7919 + i * 104729) % 100003}" for i in range(n))


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", len(t or ""), f"k{k}", "x", "x", "x", "x") for k, (i, t) in enumerate(rows)], SCHEMA)


def _kept(df):
    assert df.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    return sorted(r["row_key"] for r in df.collect())


def test_near_copies_by_row(spark):
    copy, other, third = _words(1), _words(2), _words(3)
    rows = [(5, copy), (None, copy + " end"), (9, copy), (7, other), (7, third), (None, None), (None, ""), (3, other + " end"), (-4, third), (7, third)]
    kept = _kept(corpus_pipeline.near_copies(spark, _docs(spark, rows), ""))
    assert kept == ["k0", "k5", "k6", "k7", "k8"]


def test_equal_rows_leave_one(spark):
    rows = [(7, _words(4)), (7, _words(4)), (None, _words(5)), (None, _words(5)), (7, _words(6))]
    kept = _kept(corpus_pipeline.near_copies(spark, _docs(spark, rows), ""))
    assert len(kept) == 3 and "k4" in kept


def test_contaminated_rows_go_one_by_one(spark, tmp_path):
    item = _words(11, 20)
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "before " + item + " after"), (1, _words(12)), (None, item), (None, _words(13)), (None, None), (2, "")]
    kept = _kept(corpus_pipeline.decontamination(spark, _docs(spark, rows), str(tmp_path)))
    assert kept == ["k1", "k3", "k4", "k5"]


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert _kept(stage(spark, docs, str(tmp_path))) == []
    assert corpus_pipeline.packed(spark, docs, "").count() == 0


def test_masking_and_language_keep_columns(spark):
    english = "the quick brown fox jumps over the lazy dog and runs away from the house with all of its friends "
    rows = [(None, english * 3 + "mail me at jo@example.com"), (1, english * 2), (1, english * 4), (2, None)]
    docs = _docs(spark, rows)
    masked = {r["row_key"]: r for r in corpus_pipeline.pii_masking(spark, docs, "").collect()}
    assert set(masked) == {"k0", "k1", "k2", "k3"} and "jo@example.com" not in masked["k0"]["text"] and masked["k3"]["text"] is None
    assert masked["k0"]["n_chars"] == len(masked["k0"]["text"])
    assert set(_kept(corpus_pipeline.language_id(spark, docs, ""))) <= {"k0", "k1", "k2"}
