import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    rows = [(i, f"the cat number {i} sat on the mat and the dog {i * 7} was there with {i * 13} of them in house {i}", "en", f"s{i % 3}", 80) for i in range(40)]
    rows += [(100 + i, rows[3][1], "en", "s0", 80) for i in range(5)] + [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, "a secret: password=hunter2222 in the text that is here and there", "en", "s2", 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen, at = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = at
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == docs.columns
    ids = lambda name: {r["doc_id"] for r in seen[name].select("doc_id").collect()}
    assert ids("language ID") == {r[0] for r in rows} - {200, 201}
    assert not ids("SimHash near-dedup") & set(range(100, 105)) and 3 in ids("SimHash near-dedup")
    assert "hunter" not in seen["secret scans"].where("doc_id = 202").first()["text"]
    assert ids("mixing") <= ids("secret scans")
    last = seen["BPE"].join(seen["mixing"].select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("want")).distinct(), "doc_id")
    assert seen["BPE"].count() == seen["mixing"].count() and last.where("want <> decoded_sha256").count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
