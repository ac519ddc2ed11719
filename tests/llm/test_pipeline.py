from driftmark.session import new_work_dir

import corpus_pipeline


def test_stages_keep_columns_and_clean_rows(spark, docs, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = docs.select(*columns).filter("doc_id is null or doc_id not in (25, 51, 52)")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, folder)
        if name != "packing":
            assert out.columns == columns
        path = new_work_dir(spark, name)
        out.write.parquet(path)
        rows = spark.read.parquet(path)
    assert {r.doc_id for r in rows.collect()} >= {1, 2, 3, 4, 5, 50}


def test_stages_of_an_empty_table(spark, empty, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = empty
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, folder)
    assert rows.count() == 0
