"""Language identification by compression.

For each language of the training rows a raw-content zstandard dictionary is put together from a bounded sample: of each
sampled text as many bytes, in pieces from all over it. A text is compressed, in blocks, with each of them; the language
with the smallest sum is chosen, and the answer counts as rejected when the margin over the second is narrow. Texts of
under ``SHORT`` bytes are also compressed in parts (halves and single words), since sizes are whole bytes.

Bounds of the fit: ``DOCS`` ids for a language, ``DICT`` bytes for its dictionary and ``TOTAL`` for all of them, which the
languages share evenly where they are many, and ``LANGS`` languages, more than there are.

A null text or one without a letter is ``und`` with score 0. Bytes that are not UTF-8 are read as U+FFFD. Equal texts are
treated alike; ties go to the more frequent language of the training rows. Without training rows every text is ``und``. Training
rows without an id teach nothing. Long texts are compressed whole, empty tables give no rows, other columns are not read.
"""

from __future__ import annotations

import math
from zlib import crc32

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrow import decoded, texts_map
from lodestone.llm.common import clean_name, crc32_text
from lodestone.llm.sample import chosen_texts

DOCS, DICT, TOTAL, LANGS = 400, 110_000, 44_000_000, 10_000
#: Bytes of a piece of a sampled text, and of all its pieces at most.
PIECE, SHARE = 100, 1_000
BLOCK, SHORT, LEVEL = 4096, 300, 5
MARGIN = 0.01
SCHEMA = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


#: Everything in ASCII but letters and digits is white space to the comparison.
_BLANK = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str) -> bytes:
    """Lower case, punctuation gone: what is written tells the language, not how it is set."""
    return b" ".join(text.lower().encode().translate(_BLANK).split())


def pieces(text: bytes, share: int) -> bytes:
    """About ``share`` bytes of a plain text in pieces from all over it, each from a place in its own part of the text that
    the text's crc32 gives, and between blanks."""
    if len(text) <= share:
        return text
    n = max(1, share // PIECE)
    out, seed = [], crc32(text)
    for k in range(n):
        low, high = k * len(text) // n, (k + 1) * len(text) // n
        at = low + (seed + k * 0x9E3779B1) % max(1, high - low - share // n)
        start = text.find(b" ", at, high) + 1 or at
        out.append(text[start : start + share // n].rsplit(b" ", 1)[0])
    return b" ".join(out)


def fit(docs: DataFrame) -> list[tuple[str, bytes]]:
    """docs: doc_id, text, lang. A dictionary for each language, the most frequent first."""
    d = docs.filter("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", F.col("lang").alias("label"))
    per_lang = lambda n: min(DOCS, max(20, TOTAL // n // PIECE))
    chosen, sizes = chosen_texts(d.select("doc_id", "label"), d, per_lang, LANGS, "ziplang-sample")
    if chosen is None:
        return []
    size = min(DICT, TOTAL // len(sizes))
    # What a text gives at most: more than its even part where texts are short or few.
    make = lambda: lambda texts: {"piece": [pieces(plain(decoded(t)), min(size, SHARE)) for t in texts]}
    got = texts_map(chosen.select("label", "place", "text"), "text", make, T.StructType([T.StructField("piece", T.BinaryType())]))
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for r in got.collect():
        texts.setdefault(r["label"], []).append((r["place"], bytes(r["piece"])))
    out = []
    for lang in sizes:
        own = [t for _, t in sorted(texts.get(lang, []))]
        out.append((lang, b" ".join(pieces(t, max(PIECE, size // max(1, len(own)))) for t in own)[:size]))
    return out


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        self.langs = [x for x, _ in dictionaries]
        self.zip = []
        for _, content in dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.zip.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: bytes | None) -> tuple[str, float, bool]:
        own = decoded(text)
        if not self.langs or not any(c.isalpha() for c in own):
            return "und", 0.0, True
        text = plain(own)
        if len(text) < SHORT:
            half = len(text) // 2
            parts = [b" " + text, text + b" ", text[:half], text[half:], *(b" " + w for w in text.split())]
        else:
            parts = [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]
        sizes = [sum(len(z.compress(p)) for p in parts) - 9 * len(parts) for z in self.zip]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for k, s in enumerate(sizes) if k != best]
        margin = (min(others) - sizes[best]) / max(1, min(others)) if others else 1.0
        return self.langs[best], 1 - 0.5 * math.exp(-max(0.0, margin) * 20), margin < MARGIN


def classify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text: str = "text") -> DataFrame:
    """lang_pred, score and rejected in place of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)  # TOTAL bytes at most

    def make():
        of = Classifier(sent.value)

        def work(texts: list[bytes | None]) -> dict[str, list]:
            got = [of(t) for t in texts]
            return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[2] for g in got]}

        return work

    return texts_map(docs, text, make, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    d = clean_name(docs, "doc_id", "text", "lang").withColumn("held_out", crc32_text(F.col("doc_id")) % 5 == 0)
    return classify(d.select("doc_id", "held_out", "text"), fit(d.filter("not held_out")))
