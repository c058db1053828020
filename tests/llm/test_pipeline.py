import corpus_pipeline as C
from palimpsest.llm.common import persist


def test_stages_on_a_small_corpus(spark, tmp_path, prose):
    rows = []
    for i in range(24):
        rows.append((i, prose(i, 90), "en" if i % 2 else "de", "s", 1))
    rows += [(100, None, "en", "s", 0), (101, "123 456", "en", "s", 7), (102, "x " + rows[3][1].replace("\n", " "), "en", "s", 1), (103, prose(3, 90), "en", "s", 1)]
    rows.append((104, prose(400, 60) + " " + prose(777, 40) + " " + prose(401, 60), "en", "s", 1))
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, prose(777, 40))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "sentencepiece"]
    ids = []
    for name, stage in C.STAGES:
        docs = persist(stage(spark, docs, folder), name)
        if name != "sentencepiece":
            assert docs.columns == list(C.COLUMNS)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert ids[0] == {*range(24), 102, 103, 104}
    assert ids[1] == ids[0] - {103}  # all its lines stand elsewhere
    assert ids[2] == ids[1] - {102}
    assert ids[3] == ids[2] - {104} and ids[4] == ids[3]
    assert all(r.lossless for r in docs.select("lossless").collect())
    assert C.run(spark, folder).count() == len(ids[4])
