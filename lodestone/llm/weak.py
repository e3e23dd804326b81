"""Toxicity by weak supervision.

Voters are lexicon entries (whole words) and patterns (word beginnings of several lengths) that stand on toxic training
documents far more often than on others; labels only propose them and set the classes' shares. Entries are dealt by kind and
hash into ``GROUPS`` groups, and for each group several voters say whether a text has at least one, two or four words with an
entry of it; more voters look at how many words have an entry, and how large a part of the text. A generative label model then works from the votes alone: expectation maximisation estimates each voter's rates of
speaking given either class and, in the form of a tree of pairs, how voters depend on one another given the class (the
maximum spanning tree of their conditional mutual information). A logistic classifier on the entries and those patterns
(weights of 0 or more) is trained on the model's posterior labels and on nothing else, and it alone scores texts.

Bounds of the fit: ``LABELLED`` training documents of each class, ``UNLABELLED`` others, ``FEATURES`` entries. Counting features
and choosing entries is done where the texts are; the driver gets the numbers of the entries that a document has.

A null text is empty; an empty text gets the classifier's base rate. Without toxic training rows, or without entries, every
score is 0. Bytes that are not UTF-8 are read as U+FFFD. Repeated rows are scored alike, labels of one id are taken once
(the largest), texts are scored whole, empty tables give no rows, other columns are not read.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrow import texts_map
from lodestone.llm.common import clean_name, crc32_text, stage
from lodestone.llm.minhash import band_hashes, shingle_set, signatures
from lodestone.llm.sample import chosen_texts

LABELLED, UNLABELLED = 2500, 1500
PREFIXES = (4, 5, 6)
FEATURES, GROUPS, LEVELS = 20_000, 12, (1, 2, 4)
#: Patterns: so many different words with an entry; a word with an entry among so many.
MANY, AMONG = (2, 3, 4, 6), (400, 200, 100, 50, 25)
PATTERNS = [f"#{k}" for k in MANY] + [f"%{k}" for k in AMONG]
#: Least log likelihood ratio of an entry: of 100,000 features that say nothing, a few pass.
EVIDENCE = 9.0
TURNS = 30
#: Rows of a band and bands by which near copies are told from one another.
COPY_ROWS, COPY_BANDS = 3, 5
EDGE = b".,!?;:\"'()[]*#$%&|<>"
SCHEMA = T.StructType([T.StructField("score", T.DoubleType())])
HITS = T.StructType([T.StructField("entries", T.ArrayType(T.IntegerType())), T.StructField("patterns", T.ArrayType(T.StringType())), T.StructField("groups", T.ArrayType(T.IntegerType()))])
READ = T.StructType([T.StructField("features", T.ArrayType(T.StringType())), T.StructField("bands", T.ArrayType(T.LongType()))])


def word_set(text: bytes | None) -> set[bytes]:
    return set((text or b"").lower().split())


def features_of(word: bytes) -> list[str]:
    """The word itself and its beginnings by characters."""
    s = word.strip(EDGE).decode(errors="replace").lower()
    return [f"={s}", *(f"^{s[:n]}" for n in PREFIXES if len(s) > n)] if s else []


def read_texts(texts: list[bytes | None]) -> dict[str, list]:
    sets = [shingle_set(t) for t in texts]
    bands = iter(band_hashes(signatures(sets, COPY_ROWS * COPY_BANDS), COPY_ROWS, COPY_BANDS).tolist())
    features = [sorted({f for w in word_set(t) for f in features_of(w)}) for t in texts]
    return {"features": features, "bands": [next(bands) if len(s) else [] for s in sets]}


class Hits:
    """What a text has of the entries: their numbers, the patterns, and for each group the number of different words."""

    def __init__(self, entries: list[str]):
        self.number = {e: k for k, e in enumerate(entries)}
        self.group = [crc32(e.encode()) % (GROUPS // 2) + (GROUPS // 2) * (e[0] == "^") for e in entries]
        self.known = _Bounded()

    def of(self, word: bytes) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            got = self.known.put(word, tuple(n for f in features_of(word) if (n := self.number.get(f)) is not None))
        return got

    def __call__(self, text: bytes | None) -> tuple[list[int], list[str], list[int]]:
        words = (text or b"").lower().split()
        hit = [w for w in words if self.of(w)]
        kinds = set(hit)
        groups = [0] * GROUPS
        for w in kinds:
            for g in {self.group[n] for n in self.of(w)}:
                groups[g] += 1
        patterns = [f"#{k}" for k in MANY if len(kinds) >= k] + [f"%{k}" for k in AMONG if len(hit) * k >= len(words) and hit]
        return sorted({n for w in kinds for n in self.of(w)}), patterns, groups


class _Bounded(dict):
    """Word -> what it has; cleared when full, at some 10 MB. Long words are not kept."""

    def put(self, word: bytes, value: tuple) -> tuple:
        if len(word) <= 32:
            if len(self) >= 100_000:
                self.clear()
            self[word] = value
        return value


class LabelModel:
    """Two classes and binary voters that form a tree: each depends on the class and on one other voter. Fitted to votes
    alone by expectation maximisation, with the share of the class fixed."""

    def __init__(self, votes: np.ndarray, prior: float):
        """votes: documents x voters of 0 and 1."""
        n, v = votes.shape
        self.prior, self.parent = float(np.clip(prior, 1e-3, 0.999)), np.full(v, -1)
        # At first the documents with the most votes are taken for positive, in the share of the class. A vote weighs the more
        # the rarer it is, and in a second start the less the more others say the same; the likelier end counts.
        rare = 1 / (votes.mean(0) + 1 / n)
        with np.errstate(invalid="ignore"):
            alike = np.nan_to_num(np.corrcoef(votes.T).reshape(v, v)) ** 2
        best = -np.inf
        for weight in (rare, rare / np.maximum(1, alike.sum(1) ** 2)):
            heard = votes @ weight
            post = np.where((heard >= np.quantile(heard, 1 - self.prior)) & (heard > 0), 0.9, 0.1 * self.prior)
            for turn in range(TURNS):
                if turn in (0, 2, 6, 12):
                    self.parent = self._tree(votes, post)
                self.cells = self._cells(votes, post)
                post = self.posterior(votes)
            if (end := self.likelihood(votes)) > best:
                best, kept = end, (self.parent, self.cells)
        self.parent, self.cells = kept
        post = self.posterior(votes)
        rate = np.stack([(w @ votes + 0.5) / (w.sum() + 1) for w in (1 - post, post)])
        self.on = rate
        self.accuracy = self.prior * rate[1] / (self.prior * rate[1] + (1 - self.prior) * rate[0])

    def _tree(self, votes: np.ndarray, post: np.ndarray) -> np.ndarray:
        """The parents in the maximum spanning tree of the voters' mutual information given the class."""
        info = np.zeros((votes.shape[1],) * 2)
        for w in (1 - post, post):
            total = w.sum() + 1e-9
            p1 = (w @ votes + 1e-3) / (total + 2e-3)
            both = (votes.T @ (w[:, None] * votes)) / total
            for a in (0, 1):
                for b in (0, 1):
                    pa, pb = (p1 if a else 1 - p1), (p1 if b else 1 - p1)
                    pab = both if a and b else p1[:, None] - both if a else p1[None, :] - both if b else 1 - p1[:, None] - p1[None, :] + both
                    pab = np.maximum(pab, 1e-12)
                    info += total / len(post) * pab * np.log(pab / np.outer(pa, pb))
        v = len(info)
        parent, best, frm, inside = np.full(v, -1), np.full(v, -np.inf), np.full(v, -1), np.zeros(v, bool)
        at = 0
        for _ in range(v - 1):
            inside[at] = True
            nearer = ~inside & (info[at] > best)
            best[nearer], frm[nearer] = info[at][nearer], at
            at = int(np.argmax(np.where(inside, -np.inf, best)))
            parent[at] = frm[at]
        return parent

    def _cells(self, votes: np.ndarray, post: np.ndarray) -> np.ndarray:
        """cells[y, b, j]: P(voter j speaks | class y, its parent's vote b); the root has one for both b. Drawn towards the
        rate given the class alone."""
        out = np.empty((2, 2, votes.shape[1]))
        above = votes[:, self.parent] if len(self.parent) else votes
        for y, w in enumerate((1 - post, post)):
            rate = (w @ votes + 0.05) / (w.sum() + 1)
            for b in (0, 1):
                m = (above == b) * w[:, None]
                out[y, b] = np.where(self.parent < 0, rate, ((m * votes).sum(0) + 4 * rate) / (m.sum(0) + 4))
        return np.clip(out, 1e-4, 1 - 1e-4)

    def _joint(self, votes: np.ndarray) -> np.ndarray:
        """log P(class y, the document's votes), a row for each class."""
        above = np.where(self.parent < 0, 0, votes[:, self.parent]).astype(int)
        at = np.arange(votes.shape[1])
        out = []
        for y, share in ((0, 1 - self.prior), (1, self.prior)):
            p = self.cells[y][above, at]
            out.append(np.log(share) + np.log(np.where(votes > 0, p, 1 - p)).sum(1))
        return np.stack(out)

    def likelihood(self, votes: np.ndarray) -> float:
        return float(np.logaddexp(*self._joint(votes)).sum())

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        low, high = self._joint(votes)
        return 1 / (1 + np.exp(-np.clip(high - low, -30, 30)))


def _logistic(rows: list[np.ndarray], target: np.ndarray, n: int, steps: int = 500, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Full-batch Adam over sparse binary rows."""
    cols = np.concatenate(rows) if rows else np.empty(0, np.int64)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        z = np.bincount(at, w[cols], len(rows)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        g = np.append(np.bincount(cols, err[at], n) + decay * w / n**0.5, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = np.maximum(0, w - move[:n]), b - move[n]  # words can only speak for toxicity: else length would speak against it
    return w, float(b)


def label_and_learn(hits: list[tuple[list[int], list[str], list[int]]], entries: list[str], prior: float) -> dict:
    """hits: of each document. {"bias", "weights": entry or pattern -> weight, "posterior", "model"}."""
    counts = np.array([g for _, _, g in hits])
    patterns = np.array([[p in own for p in PATTERNS] for _, own, _ in hits], float)
    votes = np.concatenate([*((counts >= k).astype(float) for k in LEVELS), patterns], axis=1)
    model = LabelModel(votes[:, votes.min(0) != votes.max(0)], prior)
    target = model.posterior(votes[:, votes.min(0) != votes.max(0)])
    names = [*entries, *PATTERNS]
    at = {p: len(entries) + k for k, p in enumerate(PATTERNS)}
    rows = [np.array([*own, *(at[p] for p in pats)], np.int64) for own, pats, _ in hits]
    weights, bias = _logistic(rows, target, len(names))
    return {"bias": bias, "weights": {e: float(w) for e, w in zip(names, weights, strict=True) if w > 1e-4}, "entries": entries, "posterior": target, "model": model}


def _first_of_kind(bands: list[list[int]]) -> list[bool]:
    """Whether no document before shares a band."""
    seen: set[int] = set()
    out = []
    for own in bands:
        out.append(not seen.intersection(own))
        seen.update(own)
    return out


def fit(labelled: DataFrame, others: DataFrame, docs: DataFrame) -> dict:
    """labelled: doc_id, label; others: doc_id, label (-1); docs: doc_id, text."""
    none = {"bias": -30.0, "weights": {}}
    own, sizes = chosen_texts(labelled, docs, LABELLED, 2, "weak-labelled")
    if not sizes.get(1):
        return none
    more, _ = chosen_texts(others, docs, UNLABELLED, 1, "weak-others")
    texts = own if more is None else own.unionByName(more)
    read = stage(texts_map(texts, "text", lambda: read_texts, READ), "weak-read")
    # Near copies would count one chance many times: of those that share a band the first counts.
    seen = sorted(read.filter("label >= 0").select("doc_id", "label", "place", "bands").collect(), key=lambda r: (r["place"], r["label"]))
    new = [r for r, k in zip(seen, _first_of_kind([r["bands"] for r in seen]), strict=True) if k]
    d1, d0 = sum(r["label"] == 1 for r in new), sum(r["label"] == 0 for r in new)
    if not d1:
        return none
    counted = F.broadcast(docs.sparkSession.createDataFrame([(r["doc_id"],) for r in new], "doc_id long"))  # 2 * LABELLED rows
    k, n = F.col("own"), F.col("own") + F.col("other")
    share, p = d1 / (d1 + d0), (F.col("own") + 0.1) / (F.col("own") + F.col("other") + 0.2)
    lift = F.log((k + 0.5) / (d1 + 1)) - F.log((F.col("other") + 0.5) / (d0 + 1))
    # Log likelihood ratio of a feature's share of toxic documents against that of all; 0 if it is lower.
    evidence = k * F.log(p / share) + (n - k) * F.log((1 - p) / (1 - min(share, 1 - 1e-9)))
    counts = read.filter("label >= 0").join(counted, "doc_id", "left_semi").select("label", F.explode("features").alias("entry"))
    counts = counts.groupBy("entry").agg(F.sum("label").alias("own"), F.sum(1 - F.col("label")).alias("other"))
    able = counts.withColumns({"lift": lift, "evidence": F.when(p <= share, F.lit(0.0)).otherwise(evidence)}).filter((k >= 3) & (F.col("lift") > 1) & (F.col("evidence") >= EVIDENCE))
    entries = [r["entry"] for r in able.orderBy(F.desc("evidence"), "entry").limit(FEATURES).select("entry").collect()]
    if not entries:
        return none
    def make():
        of = Hits(entries)

        def work(texts: list[bytes | None]) -> dict[str, list]:
            return dict(zip(HITS.names, zip(*map(of, texts), strict=True), strict=True))

        return work

    every = sorted(texts_map(texts, "text", make, HITS).collect(), key=lambda r: (r["doc_id"], r["label"]))
    hits = [(r["entries"], r["patterns"], r["groups"]) for r in every]
    drawn = sum(r["label"] == 1 for r in every) / sum(r["label"] >= 0 for r in every)
    natural = sizes[1] / sum(sizes.values())
    part = sum(r["label"] >= 0 for r in every) / len(every)
    return label_and_learn(hits, entries, drawn * part + natural * (1 - part))


def score_documents(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """score in place of the text."""
    weights = model["weights"]
    # A word counts for the patterns with any entry, so all entries go out: FEATURES at most.
    entries = list(model.get("entries", ()))
    sent = docs.sparkSession.sparkContext.broadcast((model["bias"], entries, [weights.get(e, 0.0) for e in entries], {p: weights.get(p, 0.0) for p in PATTERNS}))

    def make():
        bias, names, of_entry, of_pattern = sent.value
        of = Hits(names)

        def work(texts: list[bytes | None]) -> dict[str, list]:
            out = []
            for t in texts:
                own, patterns, _ = of(t)
                z = bias + sum(of_entry[n] for n in own) + sum(of_pattern[p] for p in patterns)
                out.append(float(1 / (1 + np.exp(-min(30.0, max(-30.0, z))))))
            return {"score": out}

        return work

    return texts_map(docs, text, make, SCHEMA)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    d = clean_name(docs, "doc_id", "text").withColumn("held_out", crc32_text(F.col("doc_id")) % 5 == 0)
    learn = crc32_text(F.col("doc_id")) % 5 != 0
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).filter(learn & F.col("label").isin(0, 1))
    # Ids without a label: drawn among the ids alone, four times as many as are wanted, then those with a label go.
    ids = d.filter("doc_id is not null and not held_out").select("doc_id")
    share = min(1.0, 8 * (UNLABELLED + 20) / max(1, ids.count()))
    drawn = ids.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000)).distinct()
    others = drawn.join(marks, "doc_id", "left_anti").select("doc_id", F.lit(-1).alias("label"))
    model = fit(marks, others, d.select("doc_id", "text"))
    scored = score_documents(d.select("doc_id", "held_out", "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
