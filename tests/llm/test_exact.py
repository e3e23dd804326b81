"""The training-data operators against brute force and exact round trips."""

import hashlib
import re
from collections import Counter
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import components as components_module
from lodestone.llm import hilbert, minhash, mixing, nndescent, pieces, pii, repetition
from lodestone.llm.common import DOCUMENTS
from tests.parity import compare, connect

SF = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCUMENTS)


# 1: mixing


def test_mixing_like_sql(spark, docs):
    assert compare(mixing.query(docs), connect(SF), mixing.ORACLE_SQL) == ""


def test_shortage_goes_to_siblings_first(spark):
    """The short source's rest goes to its sibling; the other language gets no more than its share."""
    rows = [(k, "w " * 10, "en", "a" if k < 2 else "b", 20) for k in range(42)] + [(100 + k, "w " * 10, "de", "a", 20) for k in range(40)]
    d = spark.createDataFrame(rows, DOCUMENTS)
    got = {(r.language, r.src): r.leaf_budget for r in mixing.mix(d, {}, {"en": 1, "de": 1}, {"a": 1, "b": 1}, 1, max_epochs=1, budget_percent=50).select("language", "src", "leaf_budget", "domain").distinct().collect()}
    total = floor(820 * 50 / 100)
    assert sum(got.values()) <= total and total - sum(got.values()) <= 6
    assert got["en", "a"] == 20 and got["en", "b"] > 100


def test_copies_fill_the_budget(spark, docs):
    m = mixing.query(docs)
    per = m.groupBy("domain", "language", "src").agg(F.first("leaf_budget").alias("b"), F.sum(F.col("tokens") * F.col("full_epochs") + F.col("tail_tokens")).alias("used")).collect()
    assert all(r.b == r.used for r in per)
    assert mixing.mixed_documents(docs).count() == m.agg(F.sum("copies")).first()[0]


# 2: Hilbert


def test_curve_visits_neighbours():
    side = 1 << 3
    at = {hilbert.curve_index([x, y, z], 3): (x, y, z) for x in range(side) for y in range(side) for z in range(side)}
    assert sorted(at) == list(range(side**3))
    assert all(sum(abs(a - b) for a, b in zip(at[k], at[k + 1], strict=True)) == 1 for k in range(side**3 - 1))


def test_shards(docs, texts):
    rows = hilbert.shard_hilbert(docs).collect()
    n = Counter(r.shard for r in rows)
    assert set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1 and len(rows) == len(texts)
    for s in range(8):
        own = sorted((r.slot, r.curve) for r in rows if r.shard == s)
        assert [x for x, _ in own] == list(range(len(own))) and [c for _, c in own] == sorted(c for _, c in own)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        import zlib

        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data) and r.grown_shard is None


def test_placement_by_brute_force(docs):
    """Every row's shard and slot, from the order of the cells and of the hashes within them."""
    hashes = {(r.doc_id, r.c): r.h & 0xFFFFFFFFFFFFFFFF for r in docs.select("doc_id", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("c")).withColumn("h", F.xxhash64("doc_id", "c")).collect()}
    rows = hilbert.shard_hilbert(docs, 7).collect()
    for r in rows:
        assert r.curve == hilbert.curve_index([r.q_lang, r.q_source, r.q_size], hilbert.BITS)
    order = sorted(rows, key=lambda r: (r.curve, hashes[r.doc_id, r.text_crc32] >> 64 - hilbert.HASH_BITS * hilbert.HASH_LEVELS, r.text_crc32, r.doc_id, r.size))
    small, more = divmod(len(rows), 7)
    places = [(s, k) for s in range(7) for k in range(small + (s < more))]
    assert [(r.shard, r.slot) for r in order] == places


def test_pruning_keeps_matches(spark, docs):
    placed = hilbert.shard_hilbert(docs)
    boxes = hilbert.manifest(placed)
    hit = {r.shard for r in hilbert.prune(boxes, lang="de", source="src1").collect()}
    true = {r.shard for r in placed.join(docs.filter("lang = 'de' and source = 'src1'"), "doc_id").select("shard").distinct().collect()}
    assert true <= hit and len(hit) < 8


# 3: repetition


def brute_repeats(words):
    n, best = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                best[i] = max(best[i], k)
    return best


def test_repeats_by_brute_force():
    rng = np.random.default_rng(1)
    docs = [" ".join(rng.choice(list("abc"), rng.integers(0, 60))) for _ in range(60)] + ["", " \n", "x " * 50, None, "a b c d e f g h i " * 3]
    got = repetition.measure([None if d is None else d.encode() for d in docs], 4)
    for k, d in enumerate(docs):
        words = SPLIT.findall(d or "")
        best = brute_repeats(words)
        covered = set()
        for i, b in enumerate(best):
            if b >= 4:
                covered |= set(range(i, i + b))
        assert (got["n_words"][k], got["n_repeat_words"][k], got["longest_repeat"][k]) == (len(words), len(covered), max(best, default=0)), d


def test_base_columns(docs, texts):
    for r in repetition.query(docs).collect():
        t = texts[r.doc_id] or ""
        words, lines = SPLIT.findall(t), [x for x in t.split("\n") if SPLIT.search(x)]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r.base_failed and r.kept)


# 5: NN-descent


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    rows = [(k, (base[k % 30] + rng.standard_normal(16) * 0.15).astype(np.float32).tolist()) for k in range(200)]
    rows += [(200, rows[0][1]), (201, None), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, []), (205, [1e30] * 16)]
    got = {r.vec_id: r for r in nndescent.query(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    ok = [(i, np.array(v, float)) for i, v in rows if v and np.isfinite(v).all() and np.any(v)]
    x = np.array([v / np.abs(v).max() for _, v in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    comp = {i: i for i, _ in rows}
    for _ in range(len(ok)):
        for a, b in zip(*np.nonzero(near), strict=True):
            comp[ok[a][0]] = min(comp[ok[a][0]], comp[ok[b][0]])
    n = dict(zip([i for i, _ in ok], near.sum(1).tolist(), strict=True))
    for i, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n.get(i, 0), comp[i], comp[i] == i)


def test_links_beyond_full_lists(spark):
    """Two tight groups of more than K_WIDE vectors whose cross cosines pass the threshold but lie below those inside."""
    rng = np.random.default_rng(5)
    a = np.zeros((2, 32))
    a[0, 0] = 1
    a[1, :2] = 0.93, np.sqrt(1 - 0.93**2)
    x = np.concatenate([c + rng.standard_normal((120, 32)) * 0.003 for c in a])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    assert s[:120, 120:].min() >= 0.9 and s[:120, 120:].max() < min(s[:120, :120].min(), s[120:, 120:].min())
    got = nndescent.query(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id, r.kept) for r in got} == {(239, 0, True), (239, 0, False)}


def test_exact_search_after_failed_audits(spark, monkeypatch):
    """Lists that find nothing: the last failed audit is followed by a search of all pairs."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((20, 16))
    rows = [(k, (base[k % 20] + rng.standard_normal(16) * 0.05).tolist()) for k in range(60)]
    empty = spark.createDataFrame([], nndescent.LISTS)
    monkeypatch.setattr(nndescent, "_tables", lambda *_: empty)
    got = {r.vec_id: r for r in nndescent.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all((got[k].n_links, got[k].component_id, got[k].audit_recall) == (2, k % 20, 1.0) for k in range(60))


def test_many_dimensions_and_balls(spark):
    """Vectors of 5,000 dimensions; a chain of tight groups, each with cross links to the next only."""
    rng = np.random.default_rng(7)
    rows = []
    for g in range(4):
        centre = np.zeros(5000)
        centre[0], centre[1] = np.cos(0.4 * g), np.sin(0.4 * g)
        rows += [(60 * g + k, (centre + rng.standard_normal(5000) * 0.0002).tolist()) for k in range(60)]
    rows += [(1000 + k, rng.standard_normal(5000).tolist()) for k in range(5)]
    got = {r.vec_id: r for r in nndescent.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all((got[k].component_id, got[k].n_links) == (0, 119 if k // 60 in (0, 3) else 179) for k in range(240)) and all(got[1000 + k].n_links == 0 for k in range(5))


# 6: pseudonyms


def test_values_that_end_before_their_match(spark):
    """A card or an account number followed by what its pattern takes in too, and a key in a text without digits."""
    values = ["4111111111111111", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "AKIA" + "ABCDEFGHIJKLMNOP", "Password: hunter2x", "4111 1111 1111 1111", "4111-1111-1111-1111"]
    tails = [" 12 items", " BIC COBADEFFXXX", " BIC COBADEFFXXX", " end", " end", " 0000 1234 99", " 2024"]
    rows = [(k, f"pay {v}{t}") for k, (v, t) in enumerate(zip(values, tails, strict=True))] + [(k + 10, f"pay {v}.") for k, v in enumerate(values)]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for k, (v, t) in enumerate(zip(values, tails, strict=True)):
        alone = got[k + 10].removeprefix("pay ").removesuffix(".")
        assert alone != v and got[k] == f"pay {alone}{t}"


def test_values_behind_other_numbers(spark):
    """A number is found whatever stands before it in its run, and other kinds within such a run too."""
    texts = ["12 4111111111111111", "1234 5678 4111 1111 1111 1111", "AB12 CDEF GHIJ KLMN DE89370400440532013000", "1234 5678 123-45-6789 0000", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15", "9" * 5000, "a@" + "b." * 5000 + "com"]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    alone = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(["4111111111111111", "4111 1111 1111 1111", "DE89370400440532013000", "123-45-6789"])), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert got[:4] == [f"12 {alone[0]}", f"1234 5678 {alone[1]}", f"AB12 CDEF GHIJ KLMN {alone[2]}", f"1234 5678 {alone[3]} 0000"] and got[4] == texts[4]


def brute_pseudonym(value, key, kind):
    """Letters and digits moved by the rounds of the network, one character at a time."""
    half = (len(value) + 1) // 2
    a, b = value[:half], value[half:]
    shape = "".join("0" if c.isdigit() else "a" if c.isalpha() else c for c in value.lower())

    def shifted(part, other, i):
        pad = hashlib.sha256(f"{key}|{kind}|{i}|{other}|{shape}".encode()).hexdigest()
        out = ""
        for k, c in enumerate(part):
            by = int(pad[k % 32 * 2 : k % 32 * 2 + 2], 16)
            low, n = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26) if c.isupper() else (0, 0)
            out += chr((ord(c) - low + by) % n + low) if n else c
        return out

    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            a = shifted(a, b, i)
        else:
            b = shifted(b, a, i)
    return a + b


def test_pseudonyms_by_brute_force(spark, docs, texts):
    """Mail addresses, keys and cards of all documents, as a plain program permutes them; all else in a text stays."""
    got = {r.doc_id: r.text for r in pii.query(docs, "k").collect()}
    mail = re.compile(pii.EMAIL)
    n = 0
    for k, text in texts.items():
        if text is None:
            assert got[k] is None
            continue
        old, new = mail.findall(text), mail.findall(got[k])
        n += len(old)
        for v, w in zip(old, new, strict=True):
            cut = len(v) - len(v.rsplit(".", 1)[1])
            assert w == brute_pseudonym(v[:cut], "k", "email") + v[cut:]
        form = lambda t: re.sub(r"[A-Za-z0-9]", "x", re.sub(pii.IP, "ip", t))
        assert form(got[k]) == form(text)
        if not re.search(r"[0-9@]|AKIA|(?i:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]", text):
            assert got[k] == text
    assert n >= 5
    cards = ["4111111111111111", "5500 0000 0000 0004", "378282246310005"]
    for v, r in zip(cards, pii.pseudonymise(spark.createDataFrame([(k, c) for k, c in enumerate(cards)], "doc_id long, text string"), "k").orderBy("doc_id").collect(), strict=True):
        d = v.replace(" ", "")
        body = d[0] + brute_pseudonym(d[1:-1], "k", "card")
        luhn = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        assert r.text.replace(" ", "") == body + str(-luhn % 10)


def test_clashing_columns_stay(spark):
    d = table(spark, [(1, "mail a.b@x.org"), (2, None)]).withColumns({c: F.lit(7) for c in ("__found", "found", "new", "row", "n_changed_", "_row", "_copies", "n_words", "kept")})
    out = pii.pseudonymise(d, "k", report=False)
    assert out.columns == d.columns and {r.found for r in out.collect()} == {7}
    got = repetition.filter_documents(table(spark, [(1, " ".join(f"w{k}" for k in range(40)))]).withColumns({c: F.lit(7) for c in ("n_words", "kept", "row")}))
    assert [(r.n_words, r.kept, r.row) for r in got.collect()] == [(7, 7, 7)]
    mixed = mixing.mixed_documents(d, budget_percent=200)
    assert mixed.columns == d.columns and {r._copies for r in mixed.collect()} == {7}


def test_permutation_is_one_to_one(spark):
    d = spark.range(10000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("v"))
    out = d.select(pii.permute_digits(F.col("v"), "k", "x").alias("p")).collect()
    assert len({r.p for r in out}) == 10000 and all(re.fullmatch(r"\d{4}", r.p) for r in out)
    days = spark.range(0, 73170, 7).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v")).select(pii.permute_date(F.col("v"), "k").alias("p"))
    n, distinct, least, most = days.agg(F.count("*"), F.count_distinct("p"), F.min("p"), F.max("p")).first()
    assert n == distinct and least >= "1900-01-01" and most <= "2100-05-01"


def test_values_keep_their_form(spark):
    card, iban = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    text = f"Card {card}, bad 4111 1111 1111 1112, iban {iban}, mail a.b@x.org or A.B@x.org, ip 10.0.0.1, ssn 123-45-6789, on 2024-02-29 and 31.12.1999, call +1 555-123-4567, no date 2023-02-30."
    rows = pii.query(table(spark, [(1, text), (2, f"again {card} and {iban}"), (3, None), (4, ""), (5, "nothing at all")]), "k").orderBy("doc_id").collect()
    out = rows[0].text
    new = re.search(r"Card ([\d ]+),", out)[1]
    digits = [int(c) for c in new if c != " "]
    assert new != card and sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0
    assert new in rows[1].text and "4111 1111 1111 1112" in out and "2023-02-30" in out
    got = re.search(r"iban ([A-Z0-9 ]+),", out)[1]
    moved = got.replace(" ", "")[4:] + got.replace(" ", "")[:4]
    assert got != iban and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 and got in rows[1].text
    for gone in ("a.b@x.org", "10.0.0.1", "123-45-6789", "2024-02-29", "31.12.1999", "555-123-4567"):
        assert gone not in out
    assert [r.text for r in rows[2:]] == [None, "", "nothing at all"] and [r.n_found for r in rows[2:]] == [0, 0, 0]
    assert rows[0].n_found - rows[0].n_changed == 2


def test_plain_plans(spark, docs):
    for q in (mixing.query, hilbert.shard_hilbert, lambda d: pii.query(d, "k")):
        assert not re.search("Python|Pandas|Arrow", q(docs)._jdf.queryExecution().executedPlan().toString())


# 7: pieces


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))


def test_pieces_like_the_library(library, texts):
    coder = pieces.coder_of(pieces.production_model())
    odd = ["", " ", "  a", "a  b   c ", "\n\n\n", "\t x", "▁▁x▁", "​zero", "日本語 テキスト", "😀👍🏽", "a\r\nb", "ﬁ ①", "x" * 3000, "   ", "é é", "�", "a\x00b", "1234567890 " * 50]
    rng = np.random.default_rng(5)
    odd += ["".join(rng.choice(list(" \nabtheing▁é0😀"), rng.integers(1, 80))) for _ in range(1500)]
    for t in [*odd, *[x or "" for x in texts.values()]]:
        ids = library.encode(t)
        assert coder.encode(t) == ids, t[:80]
        assert coder.decode(ids) == library.decode(ids), t[:80]


def test_decoding_of_broken_bytes(library):
    coder = pieces.coder_of(pieces.production_model())
    rng = np.random.default_rng(6)
    for _ in range(500):
        ids = rng.choice([*coder.byte.values(), 5000, 6000], 6).tolist()
        assert coder.decode(ids) == library.decode(ids)


def test_digests(docs, texts, library):
    for r in pieces.query(docs.limit(40)).collect():
        ids = library.encode(texts[r.doc_id] or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


# 8: MinHash


def shingles(text, width):
    words = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute_components(texts, width, percent):
    sets = {i: shingles(t, width) for i, t in texts}
    comp = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def mutated(seed, groups, copies):
    rng, out = np.random.default_rng(seed), []
    for g in range(groups):
        base = rng.integers(0, 3000, 60).tolist()
        for c in range(copies):
            w = list(base)
            for _ in range(rng.integers(0, 6) if c else 0):
                w[rng.integers(0, len(w))] = int(rng.integers(0, 3000))
            out.append((g * copies + c, " ".join(f"w{x}" for x in w)))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_groups_by_brute_force(spark, width, percent):
    rows = mutated(2, 12, 14) + [(1000, None), (1001, ""), (1002, "one two"), (1003, "ONE two"), (1004, "two one"), (1005, " \n ")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, rows), percent, width).collect()}
    assert got == brute_components(rows, width, percent)


def test_blocks_change_nothing(spark, monkeypatch):
    rows = mutated(4, 2, 90)
    want = brute_components(rows, 3, 85)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.query(table(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 90, 95, 100])
def test_bands_follow_the_threshold(percent):
    rows, bands = minhash.banding(percent)
    assert (1 - (percent / 100) ** rows) ** bands <= minhash.LOST and rows * bands >= minhash.BATCH * (percent < 100)


def test_left_out_members_are_linked(spark, monkeypatch):
    """A chain in one bucket's cluster, whose far ends neither a leader nor a block joins, in blocks of four."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 160])) for k in range(40)] + [(100 + k, " ".join([f"x{k}", *words[:160]])) for k in range(40)]
    want = brute_components(rows, 3, 85)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.query(table(spark, rows)).collect()}
    assert got == want and len({c for _, c in want.values()}) == 1


def test_filter_with_clashing_columns(spark):
    """Extra columns of any name pass through; of repeated rows with one id, one stays of each text."""
    rows = [*mutated(2, 3, 6), (100, "one two three"), (100, "one two three"), (100, "four five six"), (None, "one two three"), (None, None)]
    d = table(spark, rows).withColumns({c: F.lit(7) for c in ("__kept", "kept", "row", "maybe", "n", "id", "_bits", "node")})
    got = minhash.filter_documents(d)
    assert got.columns == d.columns
    comp = brute_components(rows[:18], 5, 80)
    out = Counter((r.doc_id, r.text) for r in got.collect())
    assert out == Counter([(k, t) for k, t in rows[:18] if comp[k][1] == k] + [(100, "one two three"), (100, "four five six"), (None, "one two three"), (None, None)])


def test_posterior_bound_keeps_links():
    """Of pairs at the threshold the batches rule out next to none, and unlike pairs go early."""
    rng, least = np.random.default_rng(8), minhash.least_matches(85)
    rows, bands = minhash.banding(85)
    for s, lost in ((0.85, 3), (0.3, 2000)):
        alike = rng.random((2000, rows * bands)) < s
        sig = np.vstack([np.zeros(rows * bands, np.uint8), np.where(alike, 0, 1).astype(np.uint8)])
        kept = minhash.likely(sig, 0, np.arange(1, 2001), least)
        assert (len(kept) >= 2000 - lost) if s > 0.5 else len(kept) == 0


@pytest.mark.parametrize("part", [7, 100_000])
def test_components(spark, monkeypatch, part):
    """Paths, stars and cycles, contracted in one partition or joined in steps."""
    rng = np.random.default_rng(9)
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 100 + k) for k in range(20)] + [(200 + k, 200 + (k + 1) % 9) for k in range(9)] + [(int(a), int(b)) for a, b in rng.integers(300, 360, (40, 2))]
    comp = {x: x for e in edges for x in e}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    alone = {x for x in comp if all(a == b for a, b in edges if x in (a, b))}
    monkeypatch.setattr(components_module, "PART", part)
    d = spark.createDataFrame(edges, "u long, v long").repartition(5)
    assert {r.node: r.root for r in components_module.components(d).collect()} == {k: v for k, v in comp.items() if k not in alone}
    assert components_module.components(d.limit(0)).count() == 0
