"""The query of substring dedup returns every document."""

from quillmill.llm.queries import op2_substring_dedup

DIR = "/root/testdata/sf0.001"


def test_every_document_is_a_row(spark):
    want = sorted(r["doc_id"] for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id").collect())
    got = op2_substring_dedup(spark, DIR).collect()
    assert sorted(r["doc_id"] for r in got) == want
    assert any(r["repeat_spans"] is None for r in got) and any(r["repeat_spans"] for r in got)
