from helpers import SMALL

import corpus_pipeline


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == before
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] >= counts[3] >= counts[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == counts[4]


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_line_stage_drops_lines_of_a_few_in_a_hundred_pages(spark):
    rows = []
    for i in range(200):
        extra = ["footer"] * (i % 40 < 2) + ["kept"] * (i < 4)
        rows.append((i, "\n".join([f"own line {i}", *extra]), "en", "src0", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.line_stage(spark, docs, SMALL).collect()}
    assert all(got[i]["text"] == "\n".join([f"own line {i}", *["kept"] * (i < 4)]) for i in range(200))
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
