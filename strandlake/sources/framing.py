"""Which lines of a FASTQ file are records, found exactly on files that are read in splits.

A mode is a finite automaton over lines. Its state is the number of lines taken of the record that is open (0 to 3), or
STOPPED. A split is summed up by what it does to each state: its table `next`. Tables compose, so a prefix scan over the
splits of a file gives each split the state it starts in, whatever the lines before it hold. In the modes that take lines
in fours, the table is the count of lines, modulo four, and the scan is a sum of counts.

A split then frames its own lines from its start state. A record that goes over a split's edge is put together from the
summaries, which hold the first and last three lines of each split; the reads are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import checkpointed

MODES = ("FAILFAST", "DROPMALFORMED", "PERMISSIVE", "RESYNC")
#: The state behind the end of the records in PERMISSIVE mode, and the number of states.
STOPPED, STATES = 4, 5
#: Lines of a split's edges that a record over the edge may need.
EDGE = 3
_RUN = 64


def headers(lines: pa.Array, state: int, mode: str) -> tuple[np.ndarray, int]:
    """Places of the header lines of the records that begin in some lines, and the state after the lines."""
    n = len(lines)
    if state == STOPPED:
        return np.zeros(0, np.int64), STOPPED
    lead = -state % 4
    if mode == "RESYNC":
        return _resync(pc.fill_null(pc.starts_with(lines, "@"), False).to_numpy(zero_copy_only=False), lead)
    found = np.arange(lead, n, 4)
    if mode == "PERMISSIVE" and len(found):
        empty = np.flatnonzero(pc.equal(pc.binary_length(lines.take(pa.array(found))), 0).to_numpy(zero_copy_only=False))
        if len(empty):
            return found[: empty[0]], STOPPED
    return found, (state + n) % 4


def _resync(at: np.ndarray, place: int) -> tuple[np.ndarray, int]:
    """Headers where a line that is no header is skipped alone: runs of records in fours, then a search for the next header."""
    n, found, marks, run = len(at), [], None, _RUN
    while place < n:
        window = at[place : place + 4 * run : 4]
        wrong = np.flatnonzero(~window)
        good = int(wrong[0]) if len(wrong) else len(window)
        found.append(place + 4 * np.arange(good))
        place += 4 * good
        run = min(2 * run, 1 << 20) if not len(wrong) else _RUN
        if len(wrong):
            marks = np.flatnonzero(at) if marks is None else marks
            k = int(np.searchsorted(marks, place))
            place = int(marks[k]) if k < len(marks) else n
    return (np.concatenate(found) if found else np.zeros(0, np.int64)), (n - place) % 4


def plain(lines: pa.Array) -> pa.Array:
    """Lines without a carriage return at their end."""
    return pc.utf8_rtrim(lines, "\r") if pc.any(pc.ends_with(lines, "\r")).as_py() else lines


class Framer:
    """Turns the lines of one file, or of one split of it, into the four columns of whole records."""

    def __init__(self, mode: str, state: int = 0, before: int = 0):
        self.mode, self.held = mode, pa.array([], pa.string())
        self.skip = -state % 4 if state != STOPPED else 0
        self.stopped = state == STOPPED
        self.record = -(-before // 4)  # number of the next record, in the modes that take lines in fours

    def add(self, lines: pa.Array) -> tuple[list[pa.Array], int]:
        """Header, sequence, separator and quality lines of the records that are now whole, and the first one's number."""
        first = self.record
        if self.skip:
            skipped = min(self.skip, len(lines))
            self.skip -= skipped
            lines = lines.slice(skipped)
        if self.stopped:
            lines = lines.slice(0, 0)
        held = pa.concat_arrays([self.held, plain(lines)]) if len(self.held) else plain(lines)
        starts, state = headers(held, 0, self.mode)
        self.stopped = self.stopped or state == STOPPED
        whole = starts[starts + 4 <= len(held)]
        self.held = held.slice(int(starts[len(whole)])) if len(whole) < len(starts) else held.slice(0, 0)
        self.record += len(whole)
        return [held.take(pa.array(whole + k)) for k in range(4)], first

    def rest(self) -> list[str]:
        """The lines of a record that is not whole."""
        return self.held.to_pylist()


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and the split it is from: file, block and size, with one number `split` that names all three."""
    named = {"file": "file_path", "block": "file_block_start", "size": "file_block_length"}
    lines = spark.read.option("lineSep", "\n").text(path).select("value", *[F.col(f"_metadata.{x}").alias(k) for k, x in named.items()])
    return lines.withColumn("split", F.xxhash64(*named))


def runs(batches: Iterator[pa.RecordBatch], split: int = 1) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Batches cut where the column `split` changes, with whether a piece begins a split."""
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(split).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a), key[a] != now
            now = key[a]


_SUMMARY = "file string, block long, split long, n long, next array<int>, head array<string>, tail array<string>"


def summaries(lines: DataFrame, mode: str) -> DataFrame:
    """One row for each split: its count of lines, its table of states, and the lines at its edges."""
    states = range(STATES) if mode in ("PERMISSIVE", "RESYNC") else ()

    class Split:
        def __init__(self, file: str, block: int, split: int):
            self.key, self.n, self.next, self.head, self.tail = (file, block, split), 0, list(states), [], []

        def add(self, lines: pa.Array) -> None:
            lines = plain(lines)
            if len(self.head) < EDGE:
                self.head += lines.slice(0, EDGE - len(self.head)).to_pylist()
            self.tail = [*self.tail, *lines.slice(max(0, len(lines) - EDGE)).to_pylist()][-EDGE:]
            self.n += len(lines)
            seen = {s: headers(lines, s, mode)[1] for s in set(self.next)}
            self.next = [seen[s] for s in self.next]

        def row(self) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()))
            values = (*self.key, self.n, self.next or [(s + self.n) % 4 for s in range(4)] + [STOPPED], self.head, self.tail)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["file", "block", "split", "n", "next", "head", "tail"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Split | None = None
        for piece, fresh in runs(batches):
            if fresh:
                if now:
                    yield now.row()
                now = Split(piece.column(2)[0].as_py(), piece.column(3)[0].as_py(), piece.column(1)[0].as_py())
            now.add(piece.column(0))
        if now:
            yield now.row()

    return lines.select("value", "split", "file", "block").mapInArrow(run, _SUMMARY)


def starts(found: DataFrame, mode: str) -> DataFrame:
    """file, block, split, state and line number at the start of each split; the scan is over one small row for each split."""
    if mode in ("FAILFAST", "DROPMALFORMED"):
        before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return found.select("file", "block", "split", before.alias("before")).withColumn("state", F.pmod("before", F.lit(4)).cast("int"))

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        state, out, n, before = 0, [], 0, []
        for step, lines in zip(table.column("next").to_pylist(), table.column("n").to_pylist(), strict=True):
            out.append(state)
            before.append(n)
            state, n = step[state], n + lines
        return table.select(["file", "block", "split"]).append_column("before", pa.array(before, pa.int64())).append_column("state", pa.array(out, pa.int32()))

    return found.select("file", "block", "split", "next", "n").groupBy("file").applyInArrow(compose, "file string, block long, split long, before long, state int")


def crossing(found: DataFrame, at: DataFrame) -> DataFrame:
    """file, record and the four lines of each record over the edges of splits; missing lines are null.

    A split that leaves a record open opens a group; the splits after it add lines until the record is whole, which is
    after three splits at most.
    """
    state = F.col("state")
    rows = found.select("split", "n", "next", "head", "tail").join(at, "split")
    lead = F.when(state.between(1, 3), F.least(4 - state, F.col("n").cast("int"))).otherwise(0)
    end = F.get("next", state)
    opens = end.between(1, 3) & (F.col("n") > lead)
    parts = rows.select("file", "block", "before", "n", end.alias("_end"), F.slice("head", F.lit(1), lead).alias("_lead"), F.when(opens, F.slice("tail", -end, end)).alias("_tail"), opens.alias("_opens"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("_opens"), F.col("block")), ignorenulls=True).over(earlier)
    added = parts.select("file", "block", F.lit(None).cast("long").alias("_at"), owner.alias("_owner"), F.col("_lead").alias("_lines")).where(F.size("_lines") > 0)
    opened = parts.where("_opens").select("file", "block", (F.col("before") + F.col("n") - F.col("_end")).alias("_at"), F.col("block").alias("_owner"), F.col("_tail").alias("_lines"))
    whole = opened.unionByName(added).groupBy("file", "_owner").agg(F.max("_at").alias("_at"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "_lines"))), lambda x: x["_lines"])).alias("_l"))
    return whole.select("file", F.floor(F.col("_at") / 4).alias("record"), *[F.get("_l", F.lit(k)).alias(c) for k, c in enumerate(LINES)])


LINES = ("header", "sequence", "separator", "quality")
#: Makes output batches of (first record's number, file, the four columns).
Finish = Callable[[list[pa.Array], int, str], pa.RecordBatch]


def unsplit(lines: DataFrame) -> bool:
    """Whether every file under a path is gzip by its name, which Spark reads whole; the names are those of its own listing."""
    return all(name.endswith(".gz") for name in lines.inputFiles())


def framed_files(spark: SparkSession, path: str, mode: str, finish: Finish, schema: str, cut_short: Callable[[list[str], int, str], pa.RecordBatch | None]) -> tuple[DataFrame, DataFrame | None]:
    """What `finish` makes of the records inside splits, and the records over their edges (None where files aren't split).

    A file that can't be split is framed in one pass, and its last record, where it is not whole, goes to `cut_short`. For
    others the summaries are checkpointed first, as a CSV reader infers its schema: one pass over the lines, which leaves
    one row for each split.
    """
    lines = text_lines(spark, path)
    whole_files = unsplit(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        framer, file = None, ""

        def end() -> Iterator[pa.RecordBatch]:
            if framer and whole_files and framer.rest() and (last := cut_short(framer.rest(), framer.record, file)) is not None:
                yield last

        for piece, fresh in runs(batches):
            if fresh:
                yield from end()
                file = piece.column(2)[0].as_py()
                state = piece.column(3)[0].as_py()
                if state is None:
                    raise ValueError(f"the splits of {file} are not those that were summed up; read the file again")
                framer = Framer(mode, state, piece.column(4)[0].as_py())
            columns, first = framer.add(piece.column(0))
            if len(columns[0]):
                yield finish(columns, first, file)
        yield from end()

    if whole_files:
        return lines.select("value", "split", "file", F.lit(0).alias("state"), F.lit(0).cast("long").alias("before")).mapInArrow(run, schema), None
    found = checkpointed(summaries(lines, mode))
    at = checkpointed(starts(found, mode))
    known = lines.join(F.broadcast(at.select("split", "state", "before")), "split", "left")
    return known.select("value", "split", "file", "state", "before").mapInArrow(run, schema), crossing(found, at)
