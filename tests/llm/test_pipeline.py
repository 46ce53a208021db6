"""Every stage against what its operator says of its own input, and the whole against all of them."""

import corpus_pipeline as corpus
from flowsieve.llm import bpe_codec, decontaminate, langid, pii, simhash

from .conftest import ODD, SF_DIR

NAMES = ["language ID", "SimHash near-dedup", "benchmark decontamination", "PII", "BPE encoding and decoding"]


def test_stages(spark, documents, tmp_path):
    assert [n for n, _ in corpus.STAGES] == NAMES
    docs = documents
    for k, (name, stage) in enumerate(corpus.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        made = stage(spark, docs, SF_DIR)
        if k < 4:
            assert made.columns == documents.columns
        made.write.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / str(k))).collect()}
        if name == NAMES[0]:
            model = langid.train(docs, eligible=~langid.held_out())
            want = {r.doc_id for r in langid.predict(docs, model).collect() if r.lang_pred != "und" and r.score >= langid.LEAST_SCORE}
            assert set(after) == want
        elif name == NAMES[1]:
            assert set(after) == {r.doc_id for r in simhash.near_duplicates(docs).collect() if r.component_id == r.doc_id}
        elif name == NAMES[2]:
            hit = {r.doc_id for r in decontaminate.matches(docs, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - hit
        elif name == NAMES[3]:
            assert {i: (r.text, r.n_chars) for i, r in after.items()} == {i: ((t := pii.masked(r.text, pii.find_spans(r.text))), len(t)) for i, r in before.items()}
        else:
            assert set(after) == set(before)
            ids = {r.doc_id: r for r in bpe_codec.digests(docs).collect()}
            assert all(after[i].ids_sha256 == ids[i].ids_sha256 for i in after)
        if k < 3:
            assert all(after[i] == before[i] for i in after)
        docs = spark.read.parquet(str(tmp_path / str(k)))
    whole = {r.doc_id: r.ids_sha256 for r in corpus.run(spark, SF_DIR).collect()}
    assert whole == {r.doc_id: r.ids_sha256 for r in docs.collect()}


def test_odd_and_empty_rows(spark, odd, clashing):
    for docs in (odd, clashing, odd.limit(0)):
        for k, (_, stage) in enumerate(corpus.STAGES):
            made = stage(spark, docs, SF_DIR)
            assert k == 4 or made.columns == docs.columns
            assert made.count() <= len(ODD)
