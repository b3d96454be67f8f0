import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm.common import materialise, shared_dir

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100
    kept = {r["doc_id"] for r in docs.collect()}
    assert not any(i in kept and q == 0 for i, q in labels.items())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.collect()} == kept


def test_odd_rows_pass_through(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "fr", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.format("noop").mode("overwrite").save()
        stage(spark, docs.limit(0), SF).write.format("noop").mode("overwrite").save()


def test_columns_named_like_results_keep_their_values(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["score", "rejected", "lang_pred", "n_words", "kept", "quality_score", "keep", "class_id", "row_id", "base", "_all", "hash", "good"]
    docs = materialise(docs.select("*", *(F.concat(F.lit(f"{n} of "), "doc_id").alias(n) for n in names)), "clash")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialise(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns
        for r in kept.collect():
            assert all(r[n] == f"{n} of {r['doc_id']}" for n in names), name
    assert kept.count() > 20
    assert corpus_pipeline.STAGES[-1][1](spark, kept, SF).select("doc_id").distinct().count() == kept.count()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Spark:
        conf = Conf

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Spark)
    Spark.sparkContext.master = "local[4]"
    assert shared_dir(Spark).startswith("file:")
