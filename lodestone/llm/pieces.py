"""SentencePiece BPE by the table of prefix-final tokens.

The pieces of a merge-type model determine, for every prefix of a text, one last token of the prefix's
encoding. For each position the tokens that end there come from an Aho-Corasick automaton, longest first;
one is the last token if it forms a compatible pair with the last token of the rest, that is, if no merge
of higher priority would have joined across their border. The ids are recovered backwards from the end.

The model's pieces hold their white-space mark only at the front (verified when it is loaded), so the
encoding of a text is that of its stretches between blanks; the codes of stretches are kept in a bounded
cache for as long as a task lasts. Runs of blanks have pieces of equal score, to which the pair test doesn't apply: a stretch
that begins with more than one blank is merged step by step, in the library's order.

A null text is empty and has no ids. Bytes that are not UTF-8 are read as U+FFFD. Every character without a piece becomes its bytes. Empty tables
give no rows, repeated rows are coded alike, texts are coded whole whatever their length.
"""

from __future__ import annotations

import hashlib
import heapq
import struct

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrow import decoded, texts_map
from lodestone.llm.common import clean_name

MARK = "▁"
#: Entries of each cache of a task; a full one keeps its newer half. About 80 MB together, given back when the task ends.
CACHE = 300_000
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> list[tuple[int, int | bytes]]:
    at, out = 0, []
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            n, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + n], at + n
        out.append((tag >> 3, value))
    return out


class _Recent:
    """The last entries used: two generations, of which the older goes when the younger has half of CACHE."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= CACHE // 2:
            self.old, self.young = self.young, {}
        self.young[key] = value


_CODERS: dict[bytes, PieceCoder] = {}


def coder_of(model: bytes) -> PieceCoder:
    """The coder of a Python worker, whose tables are built once; its caches are empty when a task asks for it."""
    key = hashlib.sha256(model).digest()
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = PieceCoder(model)
    _CODERS[key].forget()
    return _CODERS[key]


class PieceCoder:
    """Codes and decodes with a serialized SentencePiece model of type BPE with byte fallback and identity normalisation."""

    def __init__(self, model: bytes):
        pieces, trainer, normal = [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                d = dict(_fields(value))
                pieces.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or normal.get(1) != b"identity" or normal.get(4, 1) or not normal.get(3, 1):
            raise ValueError("a BPE model with byte fallback, a dummy prefix and no normalisation is needed")
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a blank behind other characters")
        self.score = {i: pieces[i][1] for i in self.ids.values()}
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.is_byte = [kind == BYTE for _, _, kind in pieces]
        # Single characters come before all merges; merges rank by score. Runs of marks are never in the table.
        chars = [i for p, i in self.ids.items() if len(p) == 1]
        merges = sorted((i for p, i in self.ids.items() if len(p) > 1 and p.strip(MARK)), key=lambda i: (-self.score[i], i))
        self.rank = {i: k for k, i in enumerate(chars + merges)}
        self.by_rank = chars + merges
        self.first_merge = len(chars)
        self.parts: list[tuple[int, int]] = [(k, k) for k in range(len(chars))]
        self.pair: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for i in chars:
            self.automaton.add_word(pieces[i][0], (self.rank[i], 1))
        for i in merges:
            text = pieces[i][0]
            last = self._merge(text)
            if len(last) == 2:  # the two that the last merge joins; else the piece can't arise
                left, right = self.rank[last[0]], self.rank[last[1]]
                self.pair[left, right] = self.rank[i]
                self.automaton.add_word(text, (self.rank[i], len(text)))
                self.parts.append((left, right))
            else:
                self.parts.append((-1, -1))
        self.automaton.make_automaton()
        # Another split of a piece also merges to it when it meets in a text.
        for p, i in self.ids.items():
            if len(p) > 1 and p.strip(MARK):
                for cut in range(1, len(p)):
                    a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                    if a is not None and b is not None and a in self.rank and b in self.rank:
                        self.pair[self.rank[a], self.rank[b]] = self.rank[i]
        self.forget()

    def forget(self) -> None:
        self.plain, self.agree = _Recent(), _Recent()

    def _merge(self, text: str) -> list[int]:
        """Step-by-step merging, the best score first and the leftmost of equals; stops before the whole
        text is one piece when only the last merge is left. Characters without a piece are -1 - code point."""
        sym = [self.ids.get(c, -1 - ord(c)) for c in text]
        return self._run(text, sym, whole=False)

    def _run(self, text: str, sym: list[int], whole: bool) -> list[int]:
        n = len(text)
        start, end = list(range(n)), list(range(1, n + 1))
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        alive, left_over = [True] * n, n
        heap: list[tuple[float, int, int, int]] = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.ids.get(text[start[a] : end[b]])) is not None:
                heapq.heappush(heap, (-self.score[i], a, b, end[b]))

        for k in range(n - 1):
            push(k, k + 1)
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if not alive[a] or not alive[b] or right[a] != b or end[b] != stop or end[a] != start[b]:
                continue
            if left_over == 2 and not whole:
                break
            end[a], sym[a] = stop, self.ids[text[start[a] : stop]]
            alive[b] = False
            left_over -= 1
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            push(left[a], a)
            push(a, right[a])
        return [sym[k] for k in range(n) if alive[k]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether coding the two tokens' joint text gives just these two. Goes down the right edge of
        the one and the left edge of the other, in the order in which their merges happen."""
        limit, pair, parts = 1 << 60, self.pair, self.parts
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            if a > b:
                limit = a
                a = parts[a][1]
                if a == limit:
                    limit = b + 1
                    b = parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = parts[b][0]
                if b + 1 == limit:
                    limit = a
                    a = parts[a][1]
                    if a == limit:
                        return True

    def stretch(self, text: str) -> list[int]:
        """Ids of a stretch whose only mark, if any, is its first character."""
        n = len(text)
        last = [-1] * (n + 1)  # rank of the last token of each prefix; -1: a character without a piece
        size = [1] * (n + 1)
        known, done = self.agree, -1
        for at, (token, length) in self.automaton.iter(text):  # of those that end at one place, the longest first
            if at == done:
                continue
            start = at + 1 - length
            before = last[start]
            if start and before >= 0:
                fits = known.get(before << 20 | token)
                if fits is None:
                    known.put(before << 20 | token, fits := self.compatible(before, token))
                if not fits:
                    continue
            last[at + 1], size[at + 1], done = token, length, at
        out, at = [], n
        while at:
            if last[at] < 0:
                out.extend(self.byte[b] for b in reversed(text[at - 1].encode()))
            else:
                out.append(self.by_rank[last[at]])
            at -= size[at]
        out.reverse()
        return out

    def blanks(self, text: str) -> list[int]:
        """Ids of a stretch that begins with several marks, merged step by step."""
        out = []
        for s in self._run(text, [self.ids.get(c, -1 - ord(c)) for c in text], whole=True):
            out.extend([s] if s >= 0 else (self.byte[b] for b in chr(-1 - s).encode()))
        return out

    def of(self, text: str) -> tuple[int, ...]:
        got = self.plain.get(text)
        if got is None:
            got = tuple(self.blanks(text) if text[:2] == MARK * 2 else self.stretch(text))
            if len(text) <= 64:
                self.plain.put(text, got)
        return got

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        extend, of = out.extend, self.of
        newline = self.byte[10] if "\n" not in self.ids else None
        lines = (MARK + text.replace(" ", MARK)).split("\n") if newline is not None else [MARK + text.replace(" ", MARK)]
        for k, line in enumerate(lines):
            if k:
                out.append(newline)
            first, *words = line.split(MARK)
            if first:
                extend(self.plain.young.get(first) or of(first))
            run = 1
            for w in words:
                if w:
                    w = MARK * run + w
                    extend(self.plain.young.get(w) or of(w))
                    run = 1
                else:
                    run += 1
            if run > 1:
                extend(of(MARK * (run - 1)))
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library: bytes that form no character become U+FFFD each, and the blank that stands for the beginning goes."""
        raw = self.raw
        data = b"".join([raw[i] for i in ids])
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = self._mend(ids)
        return text[1:] if text[:1] == " " and not self.is_byte[ids[0]] else text

    def _mend(self, ids: list[int]) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if self.is_byte[i]:
                run += self.raw[i]
            else:
                flush()
                out.append(self.raw[i].decode())
        flush()
        return "".join(out)


SCHEMA = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def production_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """ids and the text decoded from them, in place of the text."""

    def make():
        coder = coder_of(model)

        def work(texts: list[bytes | None]) -> dict[str, list]:
            ids = [coder.encode(decoded(t)) for t in texts]
            return {"ids": ids, "decoded": [coder.decode(x) for x in ids]}

        work.close = coder.forget
        return work

    return texts_map(docs, text, make, IDS)


def digests(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """n_tokens and the hashes of the ids and of the decoded text, in place of the text."""

    def make():
        coder = coder_of(model)
        names = [str(i) for i in range(len(coder.raw))]

        def work(texts: list[bytes | None]) -> dict[str, list]:
            out: dict[str, list] = {n: [] for n in SCHEMA.names}
            for t in texts:
                ids = coder.encode(decoded(t))
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            return out

        work.close = coder.forget
        return work

    return texts_map(docs, text, make, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    return digests(clean_name(docs, "doc_id", "text"), production_model())


def pipeline_stage(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", F.col("text"))
    return digests(d, production_model())
