from pyspark.sql import functions as F

import corpus_pipeline

from ..conftest import SF


def test_stages_keep_columns_and_work_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "src", 0), (-2, "q@x.example here and there", "en", "src", 26)], docs.schema)
    docs = docs.union(odd).union(docs.limit(5))
    for name in ("spans", "score", "fp", "_key", "_text", "clean", "c0", "_spans"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    columns = docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        counts.append(out.count())
        assert out.where("spans = 'own spans' AND score = 'own score' AND fp = 'own fp' AND _key = 'own _key' AND clean = 'own clean'").count() == counts[-1]
        if name == "personal_data":
            assert out.count() == docs.count()
            assert out.where("text LIKE '%@x.example%'").count() == 0
            assert out.where((F.length("text") != F.col("n_chars")) & F.col("text").contains("[EMAIL]")).count() == 0
        docs = out
    assert counts[0] >= counts[1] == counts[2] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
