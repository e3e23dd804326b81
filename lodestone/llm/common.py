"""Pieces that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session in local mode that names none gets a temporary one; on a
    cluster there is no folder to fall back to, so that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows are written once to the shared folder as Parquet and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc32_text(col: Column) -> Column:
    """crc32 of the value written as text, as a long; a null counts as empty text."""
    return F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8"))


def pseudonym_key(spark: SparkSession) -> str:
    """The key of a session's pseudonyms. Tests over made-up documents may go without one, in local mode or on the tables'
    own made-up values; whoever runs over real documents sets it."""
    return spark.conf.get("spark.lodestone.pseudonymKey", "made-up documents need no secret")


def clean_name(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, so that no extra column can clash with one that an operator adds.
    A column that is not there counts as null."""
    there = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in there else F.lit(None).cast(DOCUMENTS[c].dataType).alias(c) for c in wanted])


def aside(docs: DataFrame, *columns: str) -> DataFrame:
    """All columns of each row in one struct ``row``, and these columns again beside it: whatever the columns are
    called, none clashes with one that an operator adds. ``select("row.*")`` restores the rows."""
    return docs.select(F.struct("*").alias("row"), *[F.col(f"`{c}`") for c in columns])


#: Bits of a :func:`member_bits` table: 4 MB in 1,024 rows at most, whatever the number of keys.
MEMBER_BITS = 1 << 25


def member_bits(keys: DataFrame, key: str) -> DataFrame:
    """A set of keys as a bitmap of their hashes: a table of bounded size, which may be broadcast."""
    bit = F.pmod(F.xxhash64(key), F.lit(MEMBER_BITS))
    dealt = keys.select(bit.alias("_bit")).withColumn("_bucket", F.bitmap_bucket_number("_bit")).repartition("_bucket")  # 16 bytes a key move, not bitmaps
    return dealt.groupBy("_bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits"))


def maybe_member(rows: DataFrame, key: str, bits: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: false only if the row's key is not in the set; true for all keys in it, and for others as often as
    their bit is set. Rows stay where they are."""
    bit = F.pmod(F.xxhash64(key), F.lit(MEMBER_BITS))
    at = F.bitmap_bit_position(bit)
    joined = rows.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bits), "_bucket", "left")
    byte = F.conv(F.hex(F.substr("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.withColumn(out, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")
