"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is a step of the chain, labelled good or bad. Its features are surface statistics
of the line and of the lines before and after it. The chain is trained on bounded samples whose lines
carry the label of their document at first; in later rounds the lines of bad documents take their own
marginals, scaled so that the worst line stays bad, since a bad document has good lines too. The marginals
of forward-backward, weighted with the lines' lengths, give a document's mean and worst share of bad text,
and a logistic fit on the training documents turns these into the score.

Bounds of the fit: ``DOCS`` training documents of each class. The chain learns from ``LINES`` lines at most of each of them,
in ``PARTS`` stretches from all over a longer text; the logistic fit, in which a class weighs what it does among all training
rows, learns from their whole texts. Scoring takes every line, of which a handful of numbers is kept.

Null, empty and wordless texts have no lines; their score is the share of good documents among the sampled training rows
without lines, drawn towards the share among all training rows by one row. Without training rows of both classes every score
is that share (0.5 without any). Repeated rows are scored alike, labels of one id are taken once (the smallest), texts are
scored whole, bytes that are not UTF-8 are bytes like others, empty tables give no rows, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrow import texts_map
from lodestone.llm.common import clean_name, crc32_text
from lodestone.llm.sample import chosen_texts

#: Training documents of each class, lines of each of them, and stretches in which they are taken.
DOCS, LINES, PARTS = 700, 60, 3
#: Bytes of a text whose lines are objects at once.
PIECE = 2 << 20
STEPS, ROUNDS = 100, 3
UPPER, LOWER, DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
MARKS, PIPES, BANG, STOPS = b"#*$%&<>=+~^\\", b"|", b"!", b".,;:?"
WHITE = b" \t\n\r\x0b\x0c"
SCHEMA = T.StructType([T.StructField("score", T.DoubleType())])


def line_features(line: bytes) -> list[float]:
    n = len(line)
    words = line.split()
    w = len(words)
    left = lambda chars: n - len(line.translate(None, chars))
    upper, lower = left(UPPER), left(LOWER)
    letters = max(1, upper + lower)
    runs = sum(map(bytes.__eq__, words[1:], words[:-1]))
    return [
        min(w, 100) / 50, upper / letters, min(1.0, left(MARKS) / w), min(1.0, left(PIPES) / w), min(1.0, left(BANG) / w), min(1.0, left(STOPS) / w),
        left(DIGIT) / n, 1 - len(set(words)) / w, runs / w, min(2.0, n / w / 10), float(line[-1:] in b".?!" and line[-1:] != b""), float(w < 4),
    ]


N_BASE = 12
N_FEATURES = 3 * N_BASE + 3


def line_blocks(text: bytes | None) -> Iterator[list[bytes]]:
    """The lines with a word, in pieces of about ``PIECE`` bytes of the text."""
    text, at = text or b"", 0
    while at < len(text):
        end = text.find(b"\n", at + PIECE)
        end = len(text) if end < 0 else end
        if lines := [s for line in text[at:end].split(b"\n") if (s := line.strip(WHITE))]:
            yield lines
        at = end + 1


def text_lines(text: bytes | None) -> list[bytes]:
    return [line for block in line_blocks(text) for line in block]


def own_features(lines: list[bytes]) -> np.ndarray:
    return np.array([line_features(x) for x in lines], np.float64).reshape(len(lines), N_BASE)


def chain(own: np.ndarray) -> np.ndarray:
    """Features of each line: its own, those of both neighbours, whether it has them, a constant."""
    out = np.zeros((len(own), N_FEATURES))
    out[:, :N_BASE] = own
    out[1:, N_BASE : 2 * N_BASE] = own[:-1]
    out[:-1, 2 * N_BASE : 3 * N_BASE] = own[1:]
    out[1:, -3] = out[:-1, -2] = out[:, -1] = 1
    return out


def stretches(lines: list[bytes]) -> list[np.ndarray]:
    """Chains to learn from: the whole text if it has ``LINES`` lines at most, or ``PARTS`` stretches, each from a place in its own
    part of the text that the crc32 of its first line gives."""
    n, size = len(lines), LINES // PARTS
    if n <= LINES:
        return [chain(own_features(lines))] if n else []
    out = []
    for k in range(PARTS):
        low, high = k * n // PARTS, (k + 1) * n // PARTS
        start = low + crc32(lines[low]) % (high - low - size + 1)
        first, last = max(0, start - 1), min(n, start + size + 1)  # with the neighbours, as in the whole chain
        out.append(chain(own_features(lines[first:last]))[start - first : start - first + size])
    return out


def potentials(text: bytes | None, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log potential of label bad and the length of each line. Features are made piece by piece and not kept."""
    parts = w[: 3 * N_BASE].reshape(3, N_BASE).T
    z, size = [], []
    for lines in line_blocks(text):
        z.append(own_features(lines) @ parts)
        size.append(np.fromiter(map(len, lines), np.float64, len(lines)))
    if not z:
        return np.empty(0), np.empty(0)
    own, before, after = np.concatenate(z).T
    out = own + w[-1]
    out[1:] += before[:-1] + w[-3]
    out[:-1] += after[1:] + w[-2]
    return out, np.concatenate(size)


def forward_backward(unary: np.ndarray, pair: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """unary: chains x steps x 2 log potentials, pair: 2 x 2. Returns marginals of label 1 (bad) and, summed over
    chains, the expected counts of the transitions."""
    c, s, _ = unary.shape
    alpha, beta = np.zeros((c, s, 2)), np.zeros((c, s, 2))
    alpha[:, 0] = unary[:, 0]
    for k in range(1, s):
        step = alpha[:, k - 1, :, None] + pair
        alpha[:, k] = np.logaddexp(step[:, 0], step[:, 1]) + unary[:, k]
    for k in range(s - 2, -1, -1):
        step = pair + (unary[:, k + 1] + beta[:, k + 1])[:, None, :]
        beta[:, k] = np.where((k + 1 < length)[:, None], np.logaddexp(step[:, :, 0], step[:, :, 1]), 0)
    both = alpha + beta
    total = np.logaddexp(both[:, :, 0], both[:, :, 1])
    marginal = np.exp(both[:, :, 1] - total)
    counts = np.zeros((2, 2))
    for k in range(1, s):
        p = np.exp(alpha[:, k - 1, :, None] + pair + (unary[:, k] + beta[:, k])[:, None, :] - total[:, k, None, None])
        counts += p[k < length].sum(0)
    return marginal, counts


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(x) for x in rows])
    out = np.zeros((len(rows), length.max(), *rows[0].shape[1:]))
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out, length


def marginals(rows: list[np.ndarray], model: dict) -> list[np.ndarray]:
    """P(bad) of every line, from the potentials. Chains of like length are done together, so padding at most doubles the memory."""
    out: list = [None] * len(rows)
    groups: dict[int, list[int]] = {}
    for k, x in enumerate(rows):
        groups.setdefault(len(x).bit_length(), []).append(k)
    for own in groups.values():
        z, length = _padded([rows[k] for k in own])
        m, _ = forward_backward(np.stack([np.zeros_like(z), z], 2), model["pair"], length)
        for row, k in zip(m, own, strict=True):
            out[k] = row[: len(rows[k])]
    return out


def _train(x: np.ndarray, length: np.ndarray, target: np.ndarray, mask: np.ndarray, model: dict) -> dict:
    """Gradient ascent on the likelihood of soft line labels; pairs of soft labels count by their product."""
    params = np.concatenate([model["w"], model["pair"].ravel()])
    m, v = np.zeros_like(params), np.zeros_like(params)
    soft = np.stack([1 - target, target], 2) * mask[:, :, None]
    want = np.einsum("cki,ckj->ij", soft[:, :-1], soft[:, 1:])
    n = mask.sum()
    for step in range(1, STEPS + 1):
        w, pair = params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2)
        z = x @ w
        got, counts = forward_backward(np.stack([np.zeros_like(z), z], 2), pair, length)
        g = np.concatenate([np.einsum("ck,ckf->f", (target - got) * mask, x), (want - counts).ravel()]) / n - 1e-4 * params
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params + 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {"w": params[:N_FEATURES], "pair": params[N_FEATURES:].reshape(2, 2)}


def document_inputs(size: np.ndarray, bad: np.ndarray) -> list[float]:
    """Length-weighted share of bad text, the worst line, the longest bad line's share, few words."""
    return [float((size * bad).sum() / size.sum()), float(bad.max()), float((size * (bad > 0.5)).max() / size.sum()), min(1.0, size.sum() / 200), 1.0]


def text_inputs(texts: list[bytes | None], model: dict) -> list[list[float] | None]:
    """document_inputs of each text, None of those without lines."""
    made = [potentials(t, model["w"]) for t in texts]
    has = [k for k, (z, _) in enumerate(made) if len(z)]
    out: list[list[float] | None] = [None] * len(texts)
    for k, bad in zip(has, marginals([made[k][0] for k in has], model) if has else [], strict=True):
        out[k] = document_inputs(made[k][1], bad)
    return out


def fit_chain(chains: list[np.ndarray], good: np.ndarray) -> dict:
    """chains: features of stretches of lines; good: the label of each one's document."""
    x, length = _padded(chains)
    mask = (np.arange(x.shape[1]) < length[:, None]).astype(float)
    bad_doc = 1.0 - good
    target = bad_doc[:, None] * mask
    model = {"w": np.zeros(N_FEATURES), "pair": np.zeros((2, 2))}
    for turn in range(ROUNDS):
        model = _train(x, length, target, mask, model)
        if turn < ROUNDS - 1:
            z = x @ model["w"]
            got, _ = forward_backward(np.stack([np.zeros_like(z), z], 2), model["pair"], length)
            worst = np.maximum((got * mask).max(1, keepdims=True), 1e-6)
            target = np.minimum(1.0, got / worst) * bad_doc[:, None] * mask
    return model


def fit_top(inputs: np.ndarray, good: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps of a weighted ridge logistic fit."""
    w = np.zeros(inputs.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(inputs @ w, -30, 30)))
        h = (inputs * (weight * p * (1 - p))[:, None]).T @ inputs + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(h, inputs.T @ (weight * (good - p)) - 1e-2 * w)
    return w


def fit(keys: DataFrame, docs: DataFrame) -> dict:
    """keys: doc_id, label (1 good, 0 bad); docs: doc_id, text. Texts stay with the executors, which send the features of the
    sampled lines (19 kB a document at most) and five numbers for each document."""
    chosen, sizes = chosen_texts(keys, docs, DOCS, 2, "crf-sample")
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.5
    model: dict = {"prior": prior, "empty": prior, "w": None}
    if len(sizes) < 2:
        return model
    of = T.StructType([T.StructField("chains", T.ArrayType(T.BinaryType()))])
    make = lambda: lambda texts: {"chains": [[c.astype(np.float64).tobytes() for c in stretches(text_lines(t))] for t in texts]}
    rows = sorted(texts_map(chosen, "text", make, of).collect(), key=lambda r: (r["label"], r["place"]))
    chains = [(np.frombuffer(bytes(c), np.float64).reshape(-1, N_FEATURES), r["label"]) for r in rows for c in r["chains"]]
    if len({y for _, y in chains}) < 2:
        return model
    model |= fit_chain([c for c, _ in chains], np.array([y for _, y in chains], float))
    make = lambda: lambda texts: {"inputs": text_inputs(texts, model)}
    rows = sorted(texts_map(chosen, "text", make, T.StructType([T.StructField("inputs", T.ArrayType(T.DoubleType()))])).collect(), key=lambda r: (r["label"], r["place"]))
    drawn = {y: sum(r["label"] == y for r in rows) for y in (0, 1)}
    weight = {y: sizes[y] / total * len(rows) / drawn[y] for y in (0, 1)}
    some, none = [r for r in rows if r["inputs"]], [r for r in rows if not r["inputs"]]
    model["top"] = fit_top(np.array([r["inputs"] for r in some]), np.array([r["label"] for r in some], float), np.array([weight[r["label"]] for r in some]))
    model["empty"] = (sum(weight[1] for r in none if r["label"]) + prior) / (sum(weight[r["label"]] for r in none) + 1)
    return model


def score_documents(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """score in place of the text."""

    def work(texts: list[bytes | None]) -> dict[str, list]:
        if model["w"] is None:
            return {"score": [model["prior"]] * len(texts)}
        inputs = text_inputs(texts, model)
        return {"score": [model["empty"] if x is None else float(1 / (1 + np.exp(-np.clip(np.dot(x, model["top"]), -30, 30)))) for x in inputs]}

    return texts_map(docs, text, lambda: work, SCHEMA)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    d = clean_name(docs, "doc_id", "text").withColumn("held_out", crc32_text(F.col("doc_id")) % 3 == 1)
    marks = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    model = fit(marks.filter(crc32_text(F.col("doc_id")) % 3 != 1), d.select("doc_id", "text"))
    scored = score_documents(d.select("doc_id", "held_out", "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
