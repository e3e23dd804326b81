"""Trained operators: held-out accuracy, what may be learned from, and bounds."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import crf, weak, ziplang

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


def test_quality_held_out(docs, labels):
    rows = crf.query(docs, labels).join(labels, "doc_id").filter("held_out and quality is not null").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_held_out(docs, labels):
    rows = weak.query(docs, labels).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def test_language_held_out(docs):
    d = docs.select("doc_id", "lang")
    rows = ziplang.query(docs).join(d, "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


@pytest.mark.parametrize("op", ["crf", "weak", "lang"])
def test_held_out_rows_teach_nothing(spark, docs, labels, op):
    """Turning the labels of held-out rows about changes no score."""
    k = {"crf": 3, "weak": 5, "lang": 5}[op]
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % k == (1 if op == "crf" else 0)
    if op == "lang":
        changed = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
        a, b = ziplang.query(docs), ziplang.query(changed)
        cols = ["doc_id", "lang_pred", "score"]
    else:
        c = "quality" if op == "crf" else "toxic"
        f = crf.query if op == "crf" else weak.query
        a, b = f(docs, labels), f(docs.withColumn("lang", F.lit(None).cast("string")), labels.withColumn(c, F.when(held, 1 - F.col(c)).otherwise(F.col(c))))
        cols = ["doc_id", "score"]
    assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))


def test_posteriors_alone_teach(monkeypatch):
    """The classifier's target is the label model's posterior."""
    seen = {}
    monkeypatch.setattr(weak, "_logistic", lambda rows, target, n: (seen.update(target=target), (np.zeros(n), 0.0))[1])
    rng = np.random.default_rng(4)
    hits = [([0] if rng.random() < 0.3 else [], [], [int(rng.random() < 0.3) for _ in range(weak.GROUPS)]) for _ in range(300)]
    out = weak.label_and_learn(hits, ["=x"], 0.2)
    assert np.array_equal(seen["target"], out["posterior"])


def test_long_text_gives_lines_from_all_over():
    rng = np.random.default_rng(5)
    lines = [b" ".join(b"w" * int(n) for n in rng.integers(1, 12, 1 + k % 17)) for k in range(1000)]
    whole = crf.chain(crf.own_features(lines))
    parts = crf.stretches(lines)
    assert len(parts) == crf.PARTS and all(len(p) == crf.LINES // crf.PARTS for p in parts)
    places = [next(k for k in range(len(lines)) if np.array_equal(whole[k : k + len(p)], p)) for p in parts]
    assert [k * crf.PARTS // 1000 for k in places] == list(range(crf.PARTS))
    z, size = crf.potentials(b"\n".join(lines), np.arange(crf.N_FEATURES) / 10)
    assert np.allclose(z, whole @ (np.arange(crf.N_FEATURES) / 10)) and size.tolist() == [len(x) for x in lines]


def test_pieces_from_all_over():
    text = b" ".join(b"w%d" % k for k in range(5000))
    got = [int(w[1:]) for w in ziplang.pieces(text, 1000).split()]
    assert len(ziplang.pieces(text, 1000)) <= 1000 and got == sorted(got) and [sum(1000 * k <= w < 1000 * (k + 1) for w in got) > 10 for k in range(5)] == [True] * 5
    assert ziplang.pieces(b"short text", 1000) == b"short text"


def test_compression_by_brute_force():
    """The class by the sum of each language's compressed sizes, with dictionaries made anew for every call."""
    import zstandard

    dictionaries = [("en", b"the house and the garden of the town with many words " * 3), ("de", b"das haus und der garten in der stadt mit vielen worten " * 3)]
    of = ziplang.Classifier(dictionaries)
    for text in ("the town and the house with a garden and many more words in it " * 8, "in der stadt und im garten mit dem haus und vielen worten mehr " * 8):
        size = {}
        for lang, content in dictionaries:
            z = zstandard.ZstdCompressor(level=ziplang.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            p = ziplang.plain(text)
            size[lang] = sum(len(z.compress(p[k : k + ziplang.BLOCK])) for k in range(0, len(p), ziplang.BLOCK))
        assert of(text.encode())[0] == min(size, key=size.get)


def test_rare_languages_are_kept(spark):
    rows = [(k, f"{w} {w}{k} {w} {w}s", f"l{n}") for n, w in enumerate(("alpha", "beta", "gamma")) for k in range(1000 * n, 1000 * n + (40, 5, 1)[n])]
    got = ziplang.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [lang for lang, _ in got] == ["l0", "l1", "l2"] and b"gamma2000" in got[2][1]


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    unary, pair = rng.standard_normal((1, 4, 2)), rng.standard_normal((2, 2))
    got, counts = crf.forward_backward(unary, pair, np.array([4]))
    total, on, trans = 0.0, np.zeros(4), np.zeros((2, 2))
    for path in np.ndindex(2, 2, 2, 2):
        p = np.exp(sum(unary[0, k, y] for k, y in enumerate(path)) + sum(pair[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += p
        on += p * np.array(path)
        for a, b in zip(path, path[1:], strict=False):
            trans[a, b] += p
    assert np.allclose(got[0], on / total) and np.allclose(counts, trans / total)


def test_label_model_without_labels():
    """From votes alone: accuracies come out right, copies of one voter hang on one another in the tree, and the posterior is
    that of the model's own joint probabilities."""
    rng = np.random.default_rng(2)
    y = (rng.random(6000) < 0.3).astype(int)
    noisy = lambda on, off: (rng.random(6000) < np.where(y == 1, on, off)).astype(float)
    v = noisy(0.6, 0.2)
    copy = lambda: np.where(rng.random(6000) < 0.95, v, 1 - v)
    votes = np.column_stack([v, copy(), copy(), noisy(0.9, 0.05), noisy(0.8, 0.1), noisy(0.7, 0.1)])
    m = weak.LabelModel(votes, 0.3)
    assert np.allclose(m.on[1], [0.6, 0.59, 0.59, 0.9, 0.8, 0.7], atol=0.08) and np.allclose(m.on[0], [0.2, 0.23, 0.23, 0.05, 0.1, 0.1], atol=0.08)
    tied = {frozenset((k, p)) for k, p in enumerate(m.parent.tolist()) if p >= 0}
    assert len([t for t in tied if t <= {0, 1, 2}]) == 2 and len(tied) == 5
    post = m.posterior(votes)
    assert np.mean((post > 0.5) == y) > 0.9
    for row, got in zip(votes[:200].astype(int), post[:200], strict=True):
        joint = []
        for c in (0, 1):
            p = m.prior if c else 1 - m.prior
            for j, x in enumerate(row):
                on = m.cells[c][row[m.parent[j]] if m.parent[j] >= 0 else 0, j]
                p *= on if x else 1 - on
            joint.append(p)
        assert np.isclose(got, joint[1] / sum(joint))


def test_tree_cells_by_counting():
    """Rates given the class and the parent's vote, by hand; the tree is the heaviest of all trees."""
    rng = np.random.default_rng(3)
    votes, post = (rng.random((300, 4)) < 0.4).astype(float), rng.random(300)
    votes[:, 1] = np.where(rng.random(300) < 0.8, votes[:, 0], votes[:, 1])
    m = weak.LabelModel(votes, 0.4)
    cells = m._cells(votes, post)
    for j, p in enumerate(m.parent.tolist()):
        for c, w in enumerate((1 - post, post)):
            for b in (0, 1):
                rate = ((w * votes[:, j]).sum() + 0.05) / (w.sum() + 1)
                own = [k for k in range(300) if p >= 0 and votes[k, p] == b]
                want = (sum(w[k] * votes[k, j] for k in own) + 4 * rate) / (sum(w[k] for k in own) + 4) if p >= 0 else rate
                assert np.isclose(cells[c][b, j], want)


def test_hits_by_counting():
    entries = ["=idiot", "^idio", "^path", "=scum"]
    own, patterns, groups = weak.Hits(entries)(b"Idiot! you idiotic SCUM, idiot " + b"word " * 70)
    assert [entries[k] for k in own] == ["=idiot", "^idio", "=scum"] and set(patterns) == {"#2", "#3", "#4", "%400", "%200", "%100", "%50", "%25"} and max(groups) <= 4
    assert weak.Hits(entries)(None) == ([], [], [0] * weak.GROUPS) and weak.Hits(entries)(b"\xff\xfe idiot")[0] == [0, 1]


def test_margin_rejects(spark):
    rows = [(k, t, lang) for k in range(1, 40) for t, lang in ((f"the house and the garden number {k} of the town", "en"), (f"das haus und der garten nummer {k} in der stadt", "de"))]
    d = spark.createDataFrame([(2 * r[0] + (r[2] == "de"), r[1], r[2]) for r in rows], "doc_id long, text string, lang string")
    got = {r.text: r for r in ziplang.classify(spark.createDataFrame([(t, t) for t in ("the garden of the town", "der garten in der stadt", "12 34", "zzz qqq xxx")], "text string, t2 string").select("text", F.col("t2").alias("copy")).withColumnRenamed("copy", "keep"), ziplang.fit(d)).withColumnRenamed("keep", "text").collect()}
    assert got["the garden of the town"].lang_pred == "en" and got["der garten in der stadt"].lang_pred == "de" and got["12 34"].lang_pred == "und"
