"""Sharding by a Hilbert curve over quantised metadata [DataFrame functions only].

Every dimension is quantised to ``BITS`` bits (strings by hash, sizes by their logarithm), the cell's
index on the Hilbert curve orders the rows, and the order is cut into runs whose row counts differ by
one at most (law ``rows``). Neighbours on the curve are near in every dimension, so a file covers a
small box and a predicate on any dimension skips most files (:func:`prune`).

Nulls: a null string is a value of its own; a null text has size 1 and the crc32 of empty text; null
ids are placed by their text. Repeated rows take a slot each. An empty table gives no rows. Only the
named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import clean_name, crc32_text, stage
from lodestone.llm.prefix import before, hash_digits

BITS, DIMS = 4, 3
#: Digits of the hash that orders rows within a cell: 64 x 64 parts of each cell.
HASH_BITS, HASH_LEVELS = 6, 2


def curve_index(point: list[int], bits: int) -> int:
    """Index of a grid point on the Hilbert curve (Skilling's transposed form)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[i] ^ t) >> b & 1)
    return out


def quantise_string(col: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(col.cast("string"), F.lit("\x00"))), F.lit(1 << BITS)).cast("int")


def quantise_size(col: Column) -> Column:
    return F.least(F.lit((1 << BITS) - 1), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(col, F.lit(1))) - 3))).cast("int")


def hilbert(dims: list[Column]) -> Column:
    """Curve index of a cell. The table has 2**(BITS*DIMS) = 4,096 entries whatever the data; it is one
    constant of the plan, a string that is split when the query is planned."""
    side = 1 << BITS
    table = ",".join(str(curve_index([i // side**2, i // side % side, i % side], BITS)) for i in range(side**DIMS))
    cell = (dims[0] * side + dims[1]) * side + dims[2]
    return F.element_at(F.split(F.lit(table), ","), (cell + 1).cast("int")).cast("int")


def shard_hilbert(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under law ``rows``), and the curve
    index and quantised dimensions, of which a manifest is made. The texts are read once: what places a row
    is written to the shared folder first."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = clean_name(docs, "doc_id", "text", "lang", "source").select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        crc32_text(F.col("text")).alias("text_crc32"),
        quantise_string(F.col("lang")).alias("q_lang"),
        quantise_string(F.col("source")).alias("q_source"),
    )
    d = d.withColumn("q_size", quantise_size(F.col("size")))
    d = d.withColumn("curve", hilbert([F.col("q_lang"), F.col("q_source"), F.col("q_size")])).withColumn("one", F.lit(1))
    names = [f"h{k}" for k in range(HASH_LEVELS)]
    d = d.withColumns(dict(zip(names, hash_digits(F.xxhash64("doc_id", "text_crc32"), HASH_BITS, HASH_LEVELS), strict=True)))
    d = stage(d, "hilbert")
    ranked = before(d, ["curve"], names, ["text_crc32", "doc_id", "size"], "one", "inner")
    cells = d.groupBy("curve").agg(F.count("*").alias("n"))  # 4,096 rows at most
    cells = cells.select(
        "curve",
        F.coalesce(F.sum("n").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    at = ranked.join(F.broadcast(cells), "curve").withColumn("rank", F.col("start") + F.col("inner"))
    # The first (total mod shards) shards take one row more.
    small, more = F.expr(f"total div {shards}"), F.col("total") % shards
    long_part = more * (small + 1)
    shard = F.when(F.col("rank") < long_part, F.expr(f"rank div (total div {shards} + 1)")).otherwise(
        more + F.expr(f"(rank - (total % {shards}) * (total div {shards} + 1)) div greatest(1, total div {shards})")
    )
    at = at.withColumn("shard", shard.cast("int"))
    slot = F.col("rank") - F.col("shard") * small - F.least(F.col("shard"), more)
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve", "q_lang", "q_source", "q_size",
    )


def manifest(sharded: DataFrame) -> DataFrame:
    """One row per shard with the box of quantised values that it covers."""
    box = [f(F.col(q)).alias(f"{n}_{q}") for q in ("q_lang", "q_source", "q_size") for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), *box)


def prune(boxes: DataFrame, lang: str | None = None, source: str | None = None, size: int | None = None) -> DataFrame:
    """The shards that can hold rows of this language, source and size."""
    keep = F.lit(True)
    for q, value in (("q_lang", lang and quantise_string(F.lit(lang))), ("q_source", source and quantise_string(F.lit(source))), ("q_size", size and quantise_size(F.lit(size)))):
        if value is not None:
            keep = keep & value.between(F.col(f"min_{q}"), F.col(f"max_{q}"))
    return boxes.filter(keep).select("shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Whole documents, in one folder a shard, in curve order. A shard is written by one task for each
    run of slots, so files stay bounded; ids must be unique for this."""
    placed = shard_hilbert(docs, shards).select("doc_id", "shard", "slot")
    (docs.join(placed, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path))
