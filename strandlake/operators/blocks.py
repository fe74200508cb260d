"""Work in exact blocks of consecutive reads, and the comparison of block sizes.

Spark's Arrow batches are cut by rows and by partitions, so their edges mean nothing. Here every read has its place in the
input's order, and a block is a run of so many places: tasks take whole blocks, and put them together from the batches that
they get. All blocks but the last have exactly the size asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import bytes_of
from .ranking import placed

#: Reads of a block, unless named.
BLOCK = 10_000
Kernel = Callable[[int, pa.Table], pa.RecordBatch]


def in_blocks(df: DataFrame, kernel: Kernel, schema: str, size: int = BLOCK, place: str | None = None) -> DataFrame:
    """kernel(number, rows) of every block of `size` rows by place, which is the order of the input unless a column is named."""
    if size < 1:
        raise ValueError("size must be at least 1")
    columns = [c for c in df.columns if c != place]
    known = placed(df, "_place") if place is None else df.withColumnRenamed(place, "_place")
    numbered = known.withColumn("_block", F.floor(F.col("_place") / size)).select("_block", "_place", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> pa.RecordBatch:
            return kernel(now, pa.Table.from_batches(held))

        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            own = batch.select(columns)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and block[a] != now:
                    yield done()
                    held = []
                now = int(block[a])
                held.append(own.slice(a, b - a))
        if held:
            yield done()

    return numbered.repartition("_block").sortWithinPartitions("_block", "_place").mapInArrow(run, schema)


COUNTS = "block long, reads long, total_bases long, count_gc long"
_GC = np.isin(np.arange(256), [ord(c) for c in "GCgc"])


def count_block(number: int, rows: pa.Table) -> pa.RecordBatch:
    """Reads, bases and G or C of one block."""
    data, _ = bytes_of(rows.column("sequence").combine_chunks())
    values = [number, rows.num_rows, len(data), int(np.count_nonzero(_GC[data]))]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in values], ["block", "reads", "total_bases", "count_gc"])


def block_sizes(df: DataFrame, sizes: list[int], place: str | None = None) -> DataFrame:
    """A row for each size: the totals of the blocks' results, how many blocks there are, and the least and greatest."""
    known = placed(df.select("sequence")) if place is None else df.select("sequence", F.col(place).alias("place"))
    out = None
    for size in sizes:
        counted = in_blocks(known, count_block, COUNTS, size, "place")
        row = counted.agg(
            F.count("*").alias("blocks"), F.min("reads").alias("least"), F.max("reads").alias("greatest"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("reads", "total_bases", "count_gc")],
        ).select(F.lit(size).cast("long").alias("size"), "*")
        out = row if out is None else out.unionByName(row)
    return out
