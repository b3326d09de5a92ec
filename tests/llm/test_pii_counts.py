"""The counts of op3_pii by kind, held against the spans that the same rows name."""

from clausewright.llm import pii


def test_each_kind_is_counted_apart(spark, tmp_path):
    texts = ["a@b.co, c@d.org and e@f.net from 10.0.0.1", "card 4111111111111111 and 4111 1111 1111 1111", "call +1 555 123 4567", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.op3_pii(spark, str(tmp_path)).collect()}
    assert got == {0: (3, 1, 0, 0), 1: (0, 0, 2, 0), 2: (0, 0, 0, 1), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0)}
