"""The stages, one by one and together."""

import corpus_pipeline
import __spark_entry__
from pyspark.sql import functions as F


def test_stages_keep_columns(spark, docs, labels, tmp_path):
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    own.write.parquet(f"{tmp_path}/documents.parquet")
    now = own
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == own.columns and now.schema.simpleString() == own.schema.simpleString()
    n = now.count()
    assert 0 < n
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() == n


def test_pipeline_of_nothing(spark, docs, labels, tmp_path):
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, d, l in (("empty", own.where("false"), labels), ("unlabelled", own, labels.where("false"))):
        l.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == ["doc_id", "n_tokens", "ids"] and (out.count() > 0) == (name == "unlabelled")


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_quality_stage_learns_from_every_trusted_text(spark, tmp_path):
    """The last 150 of 20,150 trusted documents, in the order of their ids' hashes, are in a script of their own."""
    order = [r.doc_id for r in spark.range(20_150).withColumnRenamed("id", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    rows = [(i, "the river and the stone" if at < 20_000 else "жар и лёд", "en") for at, i in enumerate(order)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    docs.select("doc_id", F.lit(1).alias("quality")).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.good(spark, docs, str(tmp_path)).count() == len(rows)


def test_toxicity_stage_learns_from_every_labelled_text(spark, tmp_path):
    """The last 150 of 4,150 toxic documents, in the order of their ids' hashes, have a word of their own."""
    order = [r.doc_id for r in spark.range(4150).withColumnRenamed("id", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    rows = [(i, f"the river {'grumblefoot' if at < 4000 else 'snarkwort'} stone", 1) for at, i in enumerate(order)] + [(i, "the river and the stone", 0) for i in range(4150, 22_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    docs.select("doc_id", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.clean(spark, docs.drop("toxic"), str(tmp_path))
    assert kept.count() == len(rows) - len(order)


def test_stages_hold_little_at_a_time(spark, docs, labels, tmp_path, monkeypatch):
    """Every stage that runs Python bounds its batches by itself; runs and blocks are the pipeline's own and change no result."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    own, name = docs.select("doc_id", "text", "lang", "source", "n_chars"), "spark.sql.execution.arrow.maxBytesPerBatch"
    before, got = spark.conf.get(name), {}
    try:
        for stage in (corpus_pipeline.clean, corpus_pipeline.good, corpus_pipeline.distinct, corpus_pipeline.encoded):
            spark.conf.set(name, "64000000")
            got[stage.__name__] = stage(spark, own, str(tmp_path))
            assert int(spark.conf.get(name).rstrip("bB")) <= 2_000_000
        monkeypatch.setattr(corpus_pipeline, "RUN_CHARS", 10_000)
        monkeypatch.setattr(corpus_pipeline, "BLOCK_CHARS", 10_000)
        for stage in (corpus_pipeline.good, corpus_pipeline.encoded):
            again = stage(spark, own, str(tmp_path))
            assert sorted(map(str, again.collect())) == sorted(map(str, got[stage.__name__].collect()))
    finally:
        spark.conf.set(name, before)
