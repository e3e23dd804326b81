"""Keeping tables current from a stream of change events (ts, path, kind)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHANGE = "ts timestamp, path string, kind string"
FLUSH_MS = 600
IGNORE_FILES = (".gitignore",)


def change_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events as Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(CHANGE)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def coalesced(events: DataFrame) -> DataFrame:
    """The last kind of each path; of events at one time the greatest kind."""
    return events.groupBy("path").agg(F.max(F.struct("ts", "kind")).alias("x")).select("path", F.col("x.ts").alias("ts"), F.col("x.kind").alias("kind"))


def flushes(events: DataFrame, window_ms: int = FLUSH_MS, by: list[str] = ()) -> DataFrame:
    """Batch form of the flush rule: a flush comes ``window_ms`` after the first event that waits and takes what came
    until then; later events don't put it off. ``by``, flush (from 1), path, kind (the last one).

    A gap of more than ``window_ms`` ends every window, so the bursts between such gaps are folded by themselves. Gaps are
    found hour by hour, and between hours from a table with a row for each hour that has events, so a group is never
    in one task as a whole; a burst is, while it lasts."""
    wait, hour = window_ms * 1000, 3_600_000_000
    d = events.withColumns({"_t": F.unix_micros("ts"), "_hour": F.expr(f"unix_micros(ts) div {hour}L")})
    hours = d.groupBy(*by, "_hour").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    own = Window.partitionBy(*by).orderBy("_hour")
    hours = hours.withColumn("_prev", F.lag("_last").over(own)).select(*by, "_hour", "_prev")
    w = Window.partitionBy(*by, "_hour").orderBy("_t")
    d = d.withColumn("_near", F.lag("_t").over(w)).join(hours, [*by, "_hour"])
    opens = F.coalesce(F.col("_t") - F.coalesce("_near", "_prev") > wait, F.lit(True))
    d = d.withColumn("_opens", F.when(opens, F.col("_t")))
    # The burst of an event: the last opening before it in its hour, or the last of an earlier hour.
    d = d.withColumn("_burst", F.max("_opens").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    carried = d.groupBy(*by, "_hour").agg(F.max("_opens").alias("_o")).withColumn("_carried", F.max("_o").over(own.rowsBetween(Window.unboundedPreceding, -1))).drop("_o")
    d = d.join(carried, [*by, "_hour"]).withColumn("_burst", F.coalesce("_burst", "_carried"))
    keys = [*by, "_burst"]
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}

    def fold(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("_t", kind="stable")
        starts, first = [], None
        for t in b["_t"]:
            first = t if first is None or t > first + wait else first
            starts.append(first)
        return b.assign(_start=starts)[[*keys, "_t", "path", "kind", "_start"]]

    folded = d.select(*keys, "_t", "path", "kind").groupBy(*keys).applyInPandas(fold, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_t long, path string, kind string, _start long"]))
    last = folded.groupBy(*by, "_start", "path").agg(F.max(F.struct("_t", "kind")).alias("x"))
    # Windows are numbered hour by hour, too.
    starts = last.select(*by, "_start").distinct().withColumn("_hour", F.expr(f"_start div {hour}L"))
    counts = starts.groupBy(*by, "_hour").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*by, "_hour").orderBy("_start"))
    numbered = starts.withColumn("_k", place).join(counts, [*by, "_hour"]).select(*by, "_start", (F.col("_before") + F.col("_k")).cast("int").alias("flush"))
    return last.join(numbered, [*by, "_start"]).select(*by, "flush", "path", F.col("x.kind").alias("kind"))


def flush_processor(window_ms: int = FLUSH_MS):
    """The same rule with state and an event-time timer that the first waiting event sets, for transformWithStateInPandas."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Flush(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getMapState("waiting", "path string", "us long, kind string")

        def handleInputRows(self, key, rows, timers):
            empty = not self.waiting.exists()
            first = None
            for b in rows:
                for ts, path, kind in zip(b["ts"], b["path"], b["kind"], strict=True):
                    us = int(pd.Timestamp(ts).value // 1000)
                    first = us if first is None else min(first, us)
                    old = self.waiting.getValue((path,)) if self.waiting.containsKey((path,)) else None
                    if old is None or (old[0], old[1]) <= (us, kind):
                        self.waiting.updateValue((path,), (us, kind))
            if empty and first is not None:
                self.handle.registerTimer(first // 1000 + window_ms)
            return iter(())

        def handleExpiredTimer(self, key, timers, expired):
            rows = sorted((k[0], v[1]) for k, v in self.waiting.iterator())
            self.waiting.clear()
            self.handle.deleteTimer(expired.getExpiryTimeInMs())
            yield pd.DataFrame({"workspace": [key[0]] * len(rows), "path": [p for p, _ in rows], "kind": [k for _, k in rows]})

        def close(self):
            pass

    return Flush()


def flush_stream(events: DataFrame, window_ms: int = FLUSH_MS, late: str = "10 minutes") -> DataFrame:
    """events: workspace and CHANGE. workspace, path, kind as they are flushed; the watermark bounds the state."""
    return (
        events.withWatermark("ts", late).groupBy("workspace")
        .transformWithStateInPandas(flush_processor(window_ms), outputStructType="workspace string, path string, kind string", outputMode="Append", timeMode="EventTime")
    )


def needs_rescan(changes: DataFrame) -> bool:
    """Whether an ignore file changed: then everything is to be scanned anew."""
    return not changes.filter(F.substring_index("path", "/", -1).isin(*IGNORE_FILES)).isEmpty()


def apply_changes(changes: DataFrame, snapshot: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to upsert, paths to remove). Events only name paths: the state of the snapshot now decides, so a late
    delete of a file that is there again does no harm. snapshot: path, content_hash, …; index: path, content_hash."""
    keys = changes.select("path").distinct()
    now = snapshot.join(keys, "path", "left_semi")
    stale = now.join(index.select("path", F.col("content_hash").alias("_old")), "path", "left").filter(~F.col("_old").eqNullSafe(F.col("content_hash"))).drop("_old")
    gone = index.select("path").join(keys, "path", "left_semi").join(snapshot.select("path"), "path", "left_anti")
    return stale, gone


def run_index(events: DataFrame, checkpoint: str, snapshot: Callable[[], DataFrame], index: Callable[[], DataFrame], publish: Callable[[DataFrame, DataFrame], None], rescan: Callable[[], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """One writer that refreshes an index: each micro-batch is coalesced, compared with the files as they are, and
    published as a whole. Doing a batch twice gives the same index, so a restart from the checkpoint is safe."""

    def batch(df: DataFrame, batch_id: int) -> None:
        changes = coalesced(df)
        if rescan is not None and needs_rescan(changes):
            rescan()
            return
        publish(*apply_changes(changes, snapshot(), index()))

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def diff_index(files: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """files: path, content_hash; index: path, content_hash, transient_failure. path, action: reuse, reparse or removed."""
    f, i = files.select("path", F.col("content_hash").alias("now")), index.select("path", F.col("content_hash").alias("old"), F.coalesce("transient_failure", F.lit(False)).alias("retry"))
    same = F.col("now") == F.col("old")
    action = F.when(F.col("now").isNull(), "removed").when(F.lit(not force) & F.coalesce(same, F.lit(False)) & ~F.coalesce("retry", F.lit(False)), "reuse").otherwise("reparse")
    return f.join(i, "path", "full").select("path", action.alias("action"))


def status_counts(diff: DataFrame) -> DataFrame:
    """One row: total (files there now), reparsed, reused, removed."""
    return diff.agg(*[F.count_if(c).alias(n) for n, c in (("total", F.col("action") != "removed"), ("reparsed", F.col("action") == "reparse"), ("reused", F.col("action") == "reuse"), ("removed", F.col("action") == "removed"))])


def event_ranks(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("kind"))
    return events.withColumn("age", F.row_number().over(w))
