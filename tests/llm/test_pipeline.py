import corpus_pipeline
from aerotrace.llm.queries import QUERIES

from .cases import documents, texts


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rows = [*texts(), (500, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" " + " ".join(f"u{i}" for i in range(60)))]
    documents(spark, rows).withColumnRenamed("n", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in [*range(60), *range(100, 136), 145, 500]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = [set(r.doc_id for r in docs.select("doc_id").collect())]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert 140 not in ids[1] and ids[1] & set(range(100, 105)) == set(range(100, 105))
    assert ids[2] & set(range(100, 105)) == {100}
    assert ids[3] <= ids[2] and ids[4] == ids[3] and not any("04dbebab" in r.text for r in docs.collect())
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == ids[4]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "secret_scan", "packing"]


def test_each_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
