"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets are one node from the start. Banded signatures bring nodes into buckets.
Within a bucket the signatures of pairs are read batch by batch, and a pair is dropped as soon as the
posterior probability that its similarity reaches the threshold is below ``MISS``. What is left of a
bucket is reported as a spanning forest, never as pairs; the forests of all buckets make clusters, outside
of which no link can lie. Within a cluster the survivors of the same test are verified exactly on their
whole sets of 64-bit shingle hashes, and the verified links are again reported as forests.

A large bucket or cluster is dealt out in blocks. Each block is compared within itself and with a few leaders of its
group that stand in every block, which joins most members of a tight group at the cost of a row each. Only members that
this leaves outside their group's largest part are then compared with all other members, block against block: no
task holds a whole group, no pair that could add a link is skipped, and the work grows with the members times those left out.

The bands follow from the threshold: a pair that just reaches it shares no bucket with a probability of ``LOST``
at most; that and the Bayesian miss probability are the only ways to lose a link. Documents are picked out by bitmaps of
bounded size where they lie; texts are never shuffled but those of rows that a repeated or dropped id may have (``filter_documents``).

A null or empty text, or one without words, has an empty set and is linked with nothing. A null id never
names a component if another id does. Repeated rows are equal nodes and get a row each. Empty tables give
no rows, texts are shingled whole, other columns are not read. Bytes that are not UTF-8 count as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrow import by_group, texts_map
from lodestone.llm.common import aside, clean_name, maybe_member, member_bits, stage
from lodestone.llm.components import components, of_key

#: Probability that a pair at the threshold shares no bucket, at most.
LOST = 1.3e-5
BATCH, MISS = 16, 1e-7
#: Rows and bytes of a block.
BLOCK_ROWS, BLOCK_BYTES = 256, 16 << 20
#: Words whose hashes a Python worker keeps: about 6 MB.
CACHE = 50_000

SIGNATURE = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
SET = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("shingles", T.BinaryType())])
LINKS = T.StructType([T.StructField("u", T.BinaryType()), T.StructField("v", T.BinaryType())])


@lru_cache(8)
def banding(percent: int) -> tuple[int, int]:
    """Rows of a band and number of bands: so many rows that a pair at the threshold agrees in a band about two
    times in five, and so many bands that no more than ``LOST`` of such pairs agree in none."""
    t = percent / 100
    rows = min(12, ceil(-0.95 / log(t))) if t < 1 else 12
    return rows, ceil(log(LOST) / log(1 - t**rows)) if t < 1 else 1


class _Words(dict):
    """64-bit hashes of words; cleared when full. Long words are not kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= CACHE:
                self.clear()
            self[word] = h
        return h


_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_set(text: bytes | None, width: int = 3, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text whose A-Z are lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map((_Words() if known is None else known).__getitem__, words), np.uint64, len(words))
    short = len(w) < width
    if short:
        w = np.concatenate((w, np.zeros(width - len(w), np.uint64)))
    h = np.zeros(len(w) - width + 1, np.uint64)
    for k in range(width):
        x = w[k : len(w) - width + 1 + k]
        h = (h ^ x) * (_A if k % 2 else _B)
        h ^= h >> np.uint64(29)
    if short:
        h = h * _C + np.uint64(len(words))
    h *= _C
    h ^= h >> np.uint64(32)
    return np.unique(h)


@lru_cache(4)
def _permutations(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, hashes, np.uint64)


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """One row of 32-bit minima for each set that is not empty."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.empty((0, hashes), np.uint32)
    a, b = _permutations(hashes)
    out = np.empty((len(full), hashes), np.uint32)
    at = 0
    while at < len(full):  # so many values at a time stay in the cache
        end, size = at, 0
        while end < len(full) and (size < 30_000 or end == at):
            size += len(full[end])
            end += 1
        values = np.concatenate(full[at:end])
        first = np.concatenate(([0], np.cumsum([len(s) for s in full[at : end - 1]]))).astype(np.int64)
        for k in range(hashes):
            out[at:end, k] = np.minimum.reduceat((values * a[k] + b[k]) >> np.uint64(32), first)
        at = end
    return out


def _digest(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def band_hashes(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A 64-bit hash of each band and its number."""
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _C, parts.shape[:2]).copy()
    for r in range(rows):
        h = (h ^ parts[:, :, r]) * _A
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def _signed(width: int, rows: int, bands: int) -> Callable[[list[bytes | None]], dict[str, list]]:
    known = _Words()

    def work(texts: list[bytes | None]) -> dict[str, list]:
        sets = [shingle_set(t, width, known) for t in texts]
        sig = signatures(sets, rows * bands)
        hashes, low = iter(band_hashes(sig, rows, bands).tolist()), iter(sig.astype(np.uint8))
        return {
            "n_shingles": [len(s) for s in sets], "node": [_digest(s) for s in sets],
            "sig": [next(low).tobytes() if len(s) else None for s in sets], "bands": [next(hashes) if len(s) else None for s in sets],
        }

    return work


@lru_cache(8)
def least_matches(percent: int, miss: float = MISS, batch: int = BATCH) -> tuple[int, ...]:
    """For each batch the least number of agreeing hashes with which P(similarity >= threshold | matches)
    is not below ``miss``, under a uniform prior. By numerical integration of the Beta posterior. Only the low 8 bits of a
    hash are compared, so unequal ones agree once in 256 times, which can keep a pair but never drops one."""
    rows, bands = banding(percent)
    threshold, hashes = percent / 100, rows * bands
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(batch, hashes + 1, batch):
        for m in range(n + 1):
            logs = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(logs - logs.max())
            if p[s >= threshold].sum() / p.sum() >= miss:
                out.append(m)
                break
    return tuple(out)


def likely(sig: np.ndarray, x: int, others: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Those of ``others`` that no batch of hashes rules out as similar to x."""
    found = np.zeros(len(others), np.int64)
    for k, need in enumerate(least):
        cols = slice(k * BATCH, (k + 1) * BATCH)
        found += (sig[others, cols] == sig[x, cols]).sum(1)
        keep = found >= need
        others, found = others[keep], found[keep]
        if not len(others):
            break
    return others


def similar(sets: list[np.ndarray], x: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``others`` with 100 * intersection >= percent * union."""
    a, keep = sets[x], []
    for y in others.tolist():
        b = sets[y]
        small, large = (a, b) if len(a) < len(b) else (b, a)
        if 100 * len(small) < percent * len(large):
            continue
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        both = int((large[at] == small).sum())
        if 100 * both >= percent * (len(a) + len(b) - both):
            keep.append(y)
    return np.array(keep, np.int64)


def forest(sig: np.ndarray, least: tuple[int, ...], verify: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the graph of likely (and verified) pairs."""
    free, out = np.ones(len(sig), bool), []
    for start in range(len(sig)):
        if not free[start]:
            continue
        free[start], queue = False, [start]
        while queue:
            x = queue.pop()
            others = np.flatnonzero(free)
            if len(others):
                others = likely(sig, x, others, least)
                if verify is not None and len(others):
                    others = verify(x, others)
                free[others] = False
                more = others.tolist()
                queue.extend(more)
                out.extend((x, y) for y in more)
    return out


def joined(sig: np.ndarray, least: tuple[int, ...], part: np.ndarray, left_out: np.ndarray, verify: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links between the rows that were left out and the others that unite parts: one link for each two parts met."""
    part, other, out = part.copy(), np.flatnonzero(~left_out), []
    for x in np.flatnonzero(left_out).tolist():
        found = likely(sig, x, other[part[other] != part[x]], least)
        if verify is not None and len(found):
            found = verify(x, found)
        for y in found.tolist():
            if part[y] != part[x]:
                out.append((x, y))
                part[part == part[y]] = part[x]
    return out


def _work(percent: int, exact: bool, second: bool) -> Callable[[pa.Table], pa.RecordBatch | None]:
    least = least_matches(percent)

    def work(t: pa.Table) -> pa.RecordBatch | None:
        if t.num_rows < 2:
            return None
        node = t.column("node").combine_chunks()
        data = t.column("sig").to_pylist()
        sig = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
        verify = None
        if exact:
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            verify = lambda x, others: similar(sets, x, others, percent)
        if second:
            _, part = np.unique(np.array(t.column("root").to_pylist(), object), return_inverse=True)
            links = joined(sig, least, part, t.column("left_out").to_numpy(), verify)
        else:
            links = forest(sig, least, verify)
        if not links:
            return None
        a, b = (pa.array(x) for x in zip(*links, strict=True))
        return pa.RecordBatch.from_arrays([node.take(a).cast(pa.binary()), node.take(b).cast(pa.binary())], names=["u", "v"])

    return work


def _linked(members: DataFrame, group: str, size: Column, percent: int, exact: bool) -> DataFrame:
    """node, root: the components of the likely (or exact) links within each group. members: node, ``group``, sig,
    and shingles if links are verified."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(size) / BLOCK_BYTES)).cast("int")
    leaders = F.array(F.min("node"), F.max("node"), F.min_by("node", F.xxhash64("node")))
    large = stage(members.groupBy(group).agg(blocks.alias("blocks"), leaders.alias("leaders")).filter("blocks > 1"), "minhash-large")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.join(large, group, "left")
    places = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(F.array_contains("leaders", F.col("node")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    first = stage(by_group(dealt.withColumn("block", F.explode(places)).drop("blocks", "leaders"), [group, "block"], _work(percent, exact, False), LINKS), "minhash-links")
    roots = components(first)
    if large.isEmpty():
        return roots
    # What a large group's leaders and blocks have not joined to its largest part meets the whole group.
    inside = members.select("node", group).join(large.select(group, "blocks"), group).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    inside = stage(inside, "minhash-inside")
    parts = inside.groupBy(group, "root").agg(F.count("*").alias("n"))
    main = parts.groupBy(group).agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("n_out")).filter("n_out > 0")
    open_ = inside.join(main.select(group, "main", F.ceil(F.col("n_out") / BLOCK_ROWS).cast("int").alias("out_blocks")), group)
    open_ = stage(open_.withColumn("left_out", F.col("root") != F.col("main")).drop("main"), "minhash-open")
    if open_.isEmpty():
        return roots
    a = open_.withColumns({"i": own, "j": F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)), "left_out": F.lit(False)})
    b = open_.filter("left_out").withColumns({"j": F.pmod(F.xxhash64("node", F.lit(1)), F.col("out_blocks")).cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    met = a.unionByName(b).drop("blocks", "out_blocks").join(members, ["node", group])
    second = by_group(met, [group, "i", "j"], _work(percent, exact, True), LINKS)
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(second))


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """SET rows of the documents whose id may be among those of ``wanted`` (node, least_id) or is null."""
    bits = member_bits(wanted.filter("least_id is not null"), "least_id")
    some = maybe_member(docs, "doc_id", bits, "maybe").filter("maybe or doc_id is null").select("text")

    def make():
        known = _Words()

        def work(texts: list[bytes | None]) -> dict[str, list]:
            sets = [shingle_set(t, width, known) for t in texts]
            return {"node": [_digest(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

        return work

    return texts_map(some, "text", make, SET)


def near_duplicates(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs."""
    d = clean_name(docs, "doc_id", "text")
    rows, bands = banding(percent)
    signed = stage(texts_map(d, "text", lambda: _signed(width, rows, bands), SIGNATURE), "minhash-signed")
    first = F.first(F.struct("sig", "bands")).alias("x")
    nodes = stage(signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"), first).select("node", "least_id", "x.sig", "x.bands"), "minhash-nodes")
    keys = nodes.select("node", F.explode("bands").alias("bucket"))
    # A bucket is known by its number of members and the xor of their hashes; of buckets with equal members one is enough.
    full = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members")).filter("n > 1")
    full = stage(full.groupBy("n", "members").agg(F.min("bucket").alias("bucket")).select("bucket"), "minhash-full")
    some = maybe_member(keys, "bucket", member_bits(full, "bucket"), "maybe").filter("maybe").drop("maybe")
    buckets = some.join(full, "bucket", "left_semi")
    members = stage(buckets.join(nodes.select("node", "sig"), "node"), "minhash-members")
    near = stage(_linked(members, "bucket", F.octet_length("sig"), percent, exact=False), "minhash-near")
    # Only members of a cluster can be linked: their sets are made from one document each.
    wanted = stage(near.join(nodes.select("node", "least_id", "sig"), "node").withColumn("cluster", F.xxhash64("root")).drop("root"), "minhash-wanted")
    sets = _sets(d, wanted, width).join(wanted, "node").groupBy("node").agg(F.first(F.struct("cluster", "sig", "shingles")).alias("x"))
    clusters = stage(sets.select("node", "x.cluster", "x.sig", "x.shingles"), "minhash-sets")
    labels = _linked(clusters, "cluster", F.octet_length("shingles"), percent, exact=True)
    rooted = stage(nodes.select("node", "least_id").join(labels, "node"), "minhash-rooted")
    named = rooted.join(of_key(rooted, "root", component_id=F.min("least_id")), "root").select("node", "component_id")
    # A node without links has its least id for a name.
    named = nodes.select("node", "least_id").join(named, "node", "left").select("node", F.coalesce("component_id", "least_id").alias("component_id"))
    named = stage(named, "minhash-named")
    out = signed.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, 85, 3)


def filter_documents(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """One document of each group of near-duplicates (the smallest id), with all its columns, whatever they are called;
    documents without words and rows without an id all stay. Of repeated rows with one id, one stays of each text; an id of several texts stays
    if one of them stays. Only rows whose id may be dropped or repeated are shuffled."""
    ids = near_duplicates(docs, percent, width).filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    touched = stage(ids.filter("not kept or n > 1").select(F.col("doc_id").alias("id"), "kept"), "minhash-touched")
    rows = maybe_member(aside(docs, "doc_id", "text"), "doc_id", member_bits(touched, "id"), "maybe")
    maybe = rows.filter("maybe").join(touched, F.col("doc_id") == F.col("id"), "left").filter("kept or kept is null")
    # Of a repeated id one row stays for each text, known by its hash and length; other rows are groups of their own.
    own = F.when(F.col("kept").isNull(), F.monotonically_increasing_id()).alias("_own")
    one = maybe.groupBy("doc_id", F.xxhash64("text").alias("_h"), F.octet_length("text").alias("_n"), own).agg(F.first("row").alias("row")).select("row")
    return rows.filter("not maybe").select("row").union(one).select("row.*")
