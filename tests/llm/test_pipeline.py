import corpus_pipeline
from lattica.llm import common, near_dedup, quality_classifier, quality_rules


def test_stages_filter_and_keep_columns(spark, docs, tmp_path):
    sf_dir, seen = "/root/testdata/sf0.001", docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near-dedup", "packing"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keeps = [lambda d: {r.doc_id for r in quality_rules.quality_rules(d, labels).where("kept").collect()}, lambda d: {r.doc_id for r in quality_classifier.quality_classifier(d, labels, fit_on=docs).where("kept").collect()}, lambda d: {r.class_id for r in near_dedup.near_duplicates(d).collect()}]
    for k, ((_, stage), keep) in enumerate(zip(corpus_pipeline.STAGES[:-1], keeps, strict=True)):
        stage(spark, seen, sf_dir).write.parquet(str(tmp_path / str(k)))
        got = spark.read.parquet(str(tmp_path / str(k)))
        assert got.columns == docs.columns
        assert {r.doc_id for r in got.collect()} == keep(seen)
        seen = got
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in seen.collect()}


def test_stages_on_odd_and_empty_tables(spark, odd, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    odd.write.parquet(str(tmp_path / "odd"))
    odd.limit(0).write.parquet(str(tmp_path / "none"))
    for name in ("odd", "none"):
        d = spark.read.parquet(str(tmp_path / name))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, d, sf_dir).columns == d.columns
            stage(spark, d, sf_dir).count()
        assert (corpus_pipeline.STAGES[-1][1](spark, d, sf_dir).count() == 0) == (name == "none")


def test_classifier_stage_drops_what_documents_teach(spark, docs, labels):
    """Fitted on all documents, it drops rows where bad ones are left, whatever is left of the labels."""
    sf_dir = "/root/testdata/sf0.001"
    stage = corpus_pipeline.STAGES[1][1]
    bad = docs.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    good = docs.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    left = {name: stage(spark, d, sf_dir).count() / d.count() for name, d in (("bad", bad), ("good", good))}
    assert left["bad"] < 0.5 < 0.9 < left["good"]


def test_a_task_gives_its_memory_back(spark, tmp_path, monkeypatch):
    mark = str(tmp_path / "released")
    monkeypatch.setattr(common, "release", lambda: open(mark, "a").close(), raising=False)
    assert common.in_arrow(spark.range(3), lambda batches: batches, "id long").count() == 3
    assert (tmp_path / "released").exists()
