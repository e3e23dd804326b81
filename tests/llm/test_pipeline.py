"""The pipeline against its stages by brute force."""

from collections import Counter

import corpus_pipeline
from lodestone.llm import pieces, pii, repetition
from lodestone.llm.common import pseudonym_key
from tests.llm.test_exact import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in repetition.query(docs).filter("kept").collect()}
    one = corpus_pipeline.quality(spark, docs, SF).cache()
    assert one.columns == columns and {r.doc_id: r.text for r in one.collect()} == {k: rows[k] for k in kept}
    two = corpus_pipeline.near_duplicates(spark, one, SF).cache()
    comp = brute_components([(k, rows[k]) for k in kept], 5, 80)
    assert two.columns == columns and {r.doc_id for r in two.collect()} == {k for k, (_, c) in comp.items() if c == k}
    three = corpus_pipeline.pseudonyms(spark, two, SF).cache()
    new = {r.doc_id: r.text for r in three.collect()}
    want = {r.doc_id: r.text for r in pii.query(two, pseudonym_key(spark)).collect()}
    assert three.columns == columns and new == want
    four = corpus_pipeline.mixture(spark, three, SF).cache()
    from lodestone.llm import mixing

    copies = {r.doc_id: r.copies for r in mixing.query(three).collect() if r.copies}
    assert four.columns == columns and Counter(r.doc_id for r in four.collect()) == copies
    five = corpus_pipeline.tokens(spark, four, SF)
    coder = pieces.coder_of(pieces.production_model())
    assert Counter((r.doc_id, r.n_tokens) for r in five.collect()) == Counter({(k, len(coder.encode(new[k]))): n for k, n in copies.items()})
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, five.collect()))


def test_plan():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pseudonyms", "mixture", "tokens"] and corpus_pipeline.ORACLE_SQL is None
