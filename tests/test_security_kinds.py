"""The secret queries see every kind, not only the one that the test tables hold."""

import hashlib

import pytest

from lodestone.plans import registry

SECRETS = {
    1: ("aws-access-key", "AKIA" + "Q7ZK2M5X9B4W8N3T"),
    2: ("github-token", "ghp_" + "a1B2c3D4e5" * 3),
    3: ("jwt", "eyJhbGciOi.eyJzdWIiOi.c2lnbmF0dXJl"),
    4: ("private-key-block", "-----BEGIN PRIVATE KEY-----\nMIIBVQ\n-----END PRIVATE KEY-----"),
}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("kinds"))
    rows = [(k, f"first {v} last\n", "en", "s", 0) for k, (_, v) in SECRETS.items()] + [(9, "nothing here\n", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def test_all_kinds(spark, sf):
    run = lambda name: registry.queries()[name](spark, sf).collect()
    kinds = {(f"s/en/{k}.md", kind) for k, (kind, _) in SECRETS.items()}
    values = {(f"s/en/{k}.md", hashlib.sha256(v.encode()).hexdigest()) for k, (_, v) in SECRETS.items()}
    assert {(r.path, r.kind) for r in run("x01_secret_kinds")} == kinds
    assert {(r.path, r.kinds) for r in run("a29_finding_report")} == kinds
    assert {(r.path, r.value) for r in run("x01_findings")} == values == {(r.path, r.value) for r in run("j23_leaks")}
    assert {r.path: r.action for r in run("x02_policy")} == {p: "blocked" for p, _ in kinds} | {"s/en/9.md": "none"}
    assert {r.path: r.placeholders for r in run("x03_redacted_lines")} == {p: 1 for p, _ in kinds} | {"s/en/9.md": 0}


def test_every_match_holds_what_its_kind_needs(spark):
    """What is looked for before a kind's pattern loses no match, and findings go without pandas."""
    from lodestone.operators import security as S

    m = "0a1b2c3d4e5f60718293a4b5c6d7e8f9"
    texts = ["AKIA" + m[:16].upper(), *[f"gh{c}_{m}" for c in "pousr"], "xoxr-" + m, "rk_live_" + m, "AIza" + m + "abc", "sk-" + m, "-----BEGIN RSA PRIVATE KEY-----\n" + m, f"eyJ{m[:8]}.{m[8:16]}.{m[16:24]}", f"redis://u:{m}@h/x", "Bearer " + m, f"a\nexport MY_API_KEY={m}", f"Auth-Token'  :\t'{m}'", f'PASSWD="{m}"']
    for t in texts:
        want = sorted({k for k, p, c, d, g in S._COMPILED for x in p.finditer(t) if not g or S._entropy(x[1]) >= S.MIN_ENTROPY and not S._placeholder(x[1])})
        assert want and sorted({x[0] for x in S.spans(t)}) == want
    d = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string")
    count = {(r.path, r.kind) for r in S.count_kinds(d).collect()}
    assert count == {(str(k), x[0]) for k, t in enumerate(texts) for x in S.spans(t)}
    found = S.find(d)
    assert "MapInPandas" not in found._jdf.queryExecution().executedPlan().toString() and {(r.path, r.kind) for r in found.collect()} == count
