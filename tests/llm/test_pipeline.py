"""The pipeline's stages against what each should keep, on the small table."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "token_files"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, SF).cache()
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and len(after) == len(set(after)) and set(after) <= before
        counts.append(len(after))
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > counts[4] > 0
    out = corpus_pipeline.write_token_files(spark, docs, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == counts[4]


def test_odd_rows_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", None, "src1", 0), (9002, None, "en", None, None)], docs.schema)
    docs = docs.unionByName(odd).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
    corpus_pipeline.write_token_files(spark, docs, SF).collect()


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
