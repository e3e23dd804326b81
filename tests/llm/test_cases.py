"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import crf, hilbert, minhash, mixing, nndescent, pieces, pii, repetition, weak, ziplang
from lodestone.llm.common import DOCUMENTS

LABELS = "doc_id long, quality int, toxic int"
LONG = "the quick brown fox " * 30_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from all of them today. It was fine.", "en", "src0", 10), (1, "The quick brown fox jumps over the lazy dog and runs away from all of them today. It was fine.", "en", "src0", 10),
    (2, None, None, None, None), (None, "An id is missing here", "en", "src1", 5), (None, None, None, None, None), (3, "", "de", "src0", 0), (4, " \n\t ", "de", "src0", 4), (5, LONG, "en", None, len(LONG)), (6, "\x00�😀  ", None, "src2", 3), (7, "ein Haus und ein Garten", "de", "src0", 5),
]
CLASH = ["row", "maybe", "__kept", "_copies", "n_passage_words", "size", "shard", "node", "sig", "root", "score", "kept", "component_id", "label", "held_out", "path", "tokens", "budget1", "n_words", "_row", "order", "bucket", "curve", "__found", "weight"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, DOCUMENTS)
    return d.withColumns({c: F.lit(c) for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, None), (None, 1, 1), (5, None, 1), (7, 1, 0), (99, 0, 1)], LABELS).withColumn("text", F.lit("x"))


def run(name, docs, labels):
    return {
        "mixing": lambda: mixing.query(docs), "hilbert": lambda: hilbert.shard_hilbert(docs), "repetition": lambda: repetition.query(docs), "crf": lambda: crf.query(docs, labels), "pii": lambda: pii.query(docs, "k"),
        "pieces": lambda: pieces.query(docs), "minhash": lambda: minhash.query(docs), "ziplang": lambda: ziplang.query(docs), "weak": lambda: weak.query(docs, labels),
    }[name]()


NAMES = ["mixing", "hilbert", "repetition", "crf", "pii", "pieces", "minhash", "ziplang", "weak"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(docs, labels, name):
    rows = run(name, docs, labels).collect()
    assert len(rows) == len(ROWS)
    same = [tuple(v for k, v in r.asDict().items() if k not in ("slot", "shard", "copies", "tail_tokens")) for r in rows if r.doc_id == 1]
    assert same[0] == same[1]  # repeated rows are treated alike (places and shares differ)
    null = next(r for r in rows if r.doc_id == 2)
    want = {"mixing": {"tokens": 0, "language": "und", "src": "none"}, "hilbert": {"size": 1, "text_crc32": 0}, "repetition": {"n_words": 0, "base_failed": True, "kept": False}, "pii": {"text": None, "n_found": 0}, "pieces": {"n_tokens": 0}, "minhash": {"n_shingles": 0, "component_id": 2, "kept": True}, "ziplang": {"lang_pred": "und", "score": 0.0}, "crf": {}, "weak": {}}[name]
    assert {k: null[k] for k in want} == want


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, docs, labels, name):
    none = spark.createDataFrame([], DOCUMENTS)
    assert run(name, none, spark.createDataFrame([], LABELS)).count() == 0
    assert run(name, docs, spark.createDataFrame([], LABELS)).count() == len(ROWS)
    assert run(name, none, labels).count() == 0


def test_vectors(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nndescent.query(d).count() == 0
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, None]), (6, None)]
    got = sorted(nndescent.query(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("x"))).collect(), key=str)
    assert [r.n_links for r in got if r.vec_id == 4] == [2, 2] and all(r.component_id == 4 for r in got if r.vec_id in (None, 4)) and all(r.n_links == 0 for r in got if r.vec_id in (5, 6))


def test_pipeline_of_odd_rows(spark, docs, tmp_path):
    d = docs
    for name, f in corpus_pipeline.STAGES:
        assert d.columns == docs.columns
        d = f(spark, d, "")
        d.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
    assert d.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    empty = spark.createDataFrame([], DOCUMENTS)
    for _, f in corpus_pipeline.STAGES:
        empty = f(spark, empty, "")
    assert empty.count() == 0


def test_broken_utf8(spark, labels):
    """Bytes that are no UTF-8 stop nothing: each operator gives a row for each row, and U+FFFD stands for them where characters count."""
    broken = F.unhex(F.lit("FFFE4120E28220" + "776F726420" * 30)).cast("string")
    d = spark.createDataFrame(ROWS[:3], DOCUMENTS).withColumn("text", F.when(F.col("doc_id") == 1, broken).otherwise(F.col("text")))
    for name in NAMES:
        rows = run(name, d, labels).collect()
        assert len(rows) == 3, name
        if name == "repetition":
            assert rows[0].n_words == 32 and rows[0].word_chars == 3 + 1 + 120
        if name == "pieces":
            assert rows[0].n_tokens > 30
    for _, f in corpus_pipeline.STAGES:
        d = f(spark, d, "")
    assert d.count() >= 0


def test_very_long_texts():
    """Memory for each word is bounded: a million words that repeat one, and a million lines."""
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert repetition.measure([b"word " * 1_000_000])["longest_repeat"] == [999_999]
    z, size = crf.potentials(b"a line of words.\n" * 200_000, __import__("numpy").zeros(crf.N_FEATURES))
    assert len(z) == len(size) == 200_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kB
