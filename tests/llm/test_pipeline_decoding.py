"""The last stage decodes what it encodes."""

import hashlib

import corpus_pipeline


def test_last_stage_decodes(spark, documents, awkward):
    _, encode = corpus_pipeline.STAGES[-1]
    for df in (documents, awkward):
        want = sorted((hashlib.sha256((r.text or "").encode()).hexdigest(), str(r.doc_id)) for r in df.collect())
        assert sorted((r.decoded_sha256, str(r.doc_id)) for r in encode(spark, df, "").collect()) == want
