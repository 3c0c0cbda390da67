"""The pipeline against what its stages must do by brute force."""
import corpus_pipeline
from tests.oracle import DATA


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    rows = docs.collect()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), schema=docs.schema if i < 4 else None)
        if i < 4:
            assert docs.columns == names
        if i == 1:  # of equal texts the largest doc_id
            last = {r["text"]: r["doc_id"] for r in sorted(rows, key=lambda r: r["doc_id"])}
            assert {r["doc_id"] for r in docs.collect()} == set(last.values())
    got = {r["doc_id"]: r["decoded_sha256"] for r in docs.collect()}
    assert got and set(got) <= {r["doc_id"] for r in rows}
    assert {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, DATA).collect()} == got
