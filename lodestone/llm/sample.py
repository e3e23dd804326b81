"""Bounded samples for fitting: the same rows in every run, those with the smallest hashes of their ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stage


def chosen_texts(keys: DataFrame, docs: DataFrame, per_class: int | Callable[[int], int], max_classes: int, name: str) -> tuple[DataFrame | None, dict]:
    """The texts of ``per_class`` ids at most of each class (or of a number that follows from the number of classes), and the number of rows of each class. keys: doc_id (not null), label;
    docs: doc_id, text. Of more than ``max_classes`` classes the most frequent are taken.

    Ids are chosen without texts: those whose hash is small enough that 1.2 times as many and 20 more are expected, each
    once; of these, which are so few, the smallest. They are broadcast to the documents, and the texts (of repeated rows of an id
    the greatest) are written to the shared folder: doc_id, label, place (0, 1, … within the class), text. None without classes."""
    sizes = {r[0]: r[1] for r in keys.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_classes).collect()}
    if not sizes:
        return None, {}
    per_class = per_class if isinstance(per_class, int) else per_class(len(sizes))
    spark, kind = keys.sparkSession, keys.schema["label"].dataType.simpleString()
    least = [(c, min(1_000_000, int((1.2 * per_class + 20) / n * 1_000_000) + 1)) for c, n in sizes.items()]
    limits = F.broadcast(spark.createDataFrame(least, f"label {kind}, least int"))  # a row for each class
    low = keys.join(limits, "label").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("least"))
    found = low.select("label", "doc_id", F.xxhash64("doc_id").alias("order")).distinct().collect()
    taken: dict = {}
    ids = []
    for r in sorted(found, key=lambda r: (r["order"], r["doc_id"])):
        taken[r["label"]] = place = taken.get(r["label"], -1) + 1
        if place < per_class:
            ids.append((r["doc_id"], r["label"], place))
    wanted = F.broadcast(spark.createDataFrame(ids, f"doc_id long, label {kind}, place int"))  # per_class rows for each class at most
    on = ["doc_id", "label"] if "label" in docs.columns else ["doc_id"]
    texts = docs.join(wanted, on).groupBy("doc_id", "label", "place").agg(F.max("text").alias("text"))
    return stage(texts, name), sizes
