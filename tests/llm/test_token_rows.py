"""The pipeline's last stage encodes and decodes."""

import hashlib

import corpus_pipeline as CP


def test_last_stage_returns_the_digest_of_the_decoded_ids(spark):
    data = [(1, "the  quick\tbrown été"), (2, ""), (3, "    indented = 1"), (4, "日本 \U0001F600")]
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.decoded_sha256 for r in CP.STAGES[-1][1](spark, d, "").collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in data}
