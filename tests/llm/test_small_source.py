"""Sources far smaller than a block of the mixing schedule."""

import corpus_pipeline
from lexspark.llm import mixing


def test_one_document_beside_millions_of_words(spark):
    big = spark.range(600).selectExpr("id as doc_id", "repeat('w ', 5000) as text", "'a' as source")
    small = spark.createDataFrame([(1000 + i, "x " * 30, f"s{i}") for i in range(8)], "doc_id long, text string, source string")
    docs = big.union(small).cache()
    for r in mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 2 + r["max(target)"] / 64
    copies = {r.source: r["count"] for r in corpus_pipeline.mixed(spark, docs, "").groupBy("source").count().collect()}
    assert all(copies[f"s{i}"] == 3 for i in range(8))
