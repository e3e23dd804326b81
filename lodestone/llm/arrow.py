"""Arrow batches through Python, row groups of bounded size at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that are in Python objects at once; a longer text is alone.
CHUNK = 2 << 20


def decoded(text: bytes | None) -> str:
    """Bytes that are not UTF-8 become U+FFFD, so that no row stops a job."""
    return (text or b"").decode(errors="replace")


def texts_map(df: DataFrame, text: str, make: Callable[[], Callable[[list[bytes | None]], dict[str, list]]], schema: StructType) -> DataFrame:
    """Adds columns that Python computes from a text column, which itself is dropped.

    ``make`` is called once a task and gives a function from texts (UTF-8 bytes or None) to columns; its ``close``, if
    it has one, is called when the task has no more texts."""
    keep = [c for c in df.columns if c != text]
    out = StructType([df.schema[c] for c in keep] + list(schema))
    arrow = to_arrow_schema(out)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            column = batch.column(text).cast(pa.binary())
            at, n = 0, len(column)
            while at < n:
                end, size, part = at, 0, []
                while end < n and (size < CHUNK or end == at):
                    part.append(value := column[end].as_py())
                    size += len(value or b"")
                    end += 1
                made = work(part)
                arrays = [batch.column(c).slice(at, end - at) for c in keep] + [pa.array(made[c], arrow.field(c).type) for c in names]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)
                at = end
        # Workers are used again by later stages: what this task held goes back.
        if hasattr(work, "close"):
            work.close()
        del work
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, out)


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: StructType) -> DataFrame:
    """``work`` on all rows of each key. The keys' groups are of bounded size and stream through sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            cols = [t.column(k).to_numpy() for k in keys]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            start = 0
            for end in cut.tolist():
                if (out := work(t.slice(start, end - start))) is not None:
                    yield out
                start = end
            rest = t.slice(start).combine_chunks()
        if rest is not None and (out := work(rest)) is not None:
            yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
