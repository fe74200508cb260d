"""Importance resampling towards a target distribution, over hashed word runs.

A feature is a run of 1 to LONGEST words, joined by one space; its bucket is the CRC-32 of its bytes modulo BUCKETS. All
documents (the source) and all target texts are counted by bucket; a bucket's gain is the logarithm of the ratio of its
smoothed shares. A document's weight is the mean gain of its features, and a Gumbel draw by a hash of seed and doc_id on
top of the weight makes the highest scores a sample without replacement in proportion to the importance weights.

CRC-32 is linear: the checksum of a span is the XOR of what each byte gives by its distance from the span's end, and of a
constant of the length. These contributions are precomputed in a table of position and byte; all spans of a batch
are then one gather and one `bitwise_xor.reduceat`. Spans longer than the table fold blockwise: blocks counted from the
end, each by the same table, are moved on by the blocks behind them and XORed, in as many steps as a count of blocks has bits.

Counts leave a task as one row for each bucket and corpus; gains (one number for each of BUCKETS buckets, a fixed size)
are broadcast. Scores are small rows, checkpointed, and ranked over ranges with counts, so no task orders all of them.

Words are runs of ASCII letters, digits and all other code points from 128 on, with A-Z lower-cased. Defined results: a
null or empty text has no features and weight 0; a null doc_id is drawn as the empty string and ranks before others;
repeated rows are documents of their own, each drawn for itself, that tie; ties of score go to the smaller doc_id; empty
tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import before, ranged
from .common import LOWER, Words, buffer_of, checkpointed, documents

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
#: Per cent of the documents of at least LEAST_WORDS words that are drawn.
PERCENT, LEAST_WORDS = 10, 20
#: Distances from the end that the table holds.
DISTANCES = 32
_ROWS, _BYTES = 1024, 1 << 22

#: Bytes between words: all of ASCII but letters and digits.
BLANK = np.zeros(256, bool)
BLANK[[b for b in range(128) if not chr(b).isalnum()]] = True


def _step_table() -> np.ndarray:
    """The register after one byte, by the low byte of the register before."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> 1 ^ np.uint32(0xEDB88320), x >> 1).astype(np.uint32)
    return x


_STEP = _step_table()


def _advance(x: np.ndarray, n: int = 1) -> np.ndarray:
    """Registers after n more zero bytes."""
    for _ in range(n):
        x = x >> np.uint32(8) ^ _STEP[x & np.uint32(255)]
    return x


def position_table(distances: int) -> np.ndarray:
    """Row d: what each byte value gives to the checksum at distance d from the end."""
    rows = [_STEP]
    for _ in range(distances - 1):
        rows.append(_advance(rows[-1]))
    return np.stack(rows)


class Crc:
    """Checksums of many spans at once. A plain table that Spark ships; immutable."""

    def __init__(self, distances: int = DISTANCES):
        self.distances = distances
        self.table = position_table(distances).reshape(-1)
        self.moves: list[np.ndarray] = []  # by the power of two of blocks: four tables of 256, one for each byte of a register

    def _move(self, power: int, x: np.ndarray) -> np.ndarray:
        """Registers after 2**power blocks of zero bytes."""
        while len(self.moves) <= power:
            if not self.moves:
                bytes_ = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
                self.moves.append(_advance(bytes_, self.distances))
            else:
                self.moves.append(self._moved(self.moves[-1], self.moves[-1]))
        return self._moved(self.moves[power], x)

    @staticmethod
    def _moved(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
        return tables[0][x & np.uint32(255)] ^ tables[1][x >> np.uint32(8) & np.uint32(255)] ^ tables[2][x >> np.uint32(16) & np.uint32(255)] ^ tables[3][x >> np.uint32(24)]

    def constants(self, lengths: np.ndarray) -> np.ndarray:
        """The checksum of so many zero bytes, which holds the first and last inversion."""
        if not len(lengths):
            return np.zeros(0, np.uint32)
        found, back = np.unique(lengths, return_inverse=True)
        out = np.full(len(found), 0xFFFFFFFF, np.uint32)
        blocks, rest = found // self.distances, found % self.distances
        for power in range(int(blocks.max()).bit_length()):
            has = (blocks >> power & 1).astype(bool)
            out[has] = self._move(power, out[has])
        for k in range(int(rest.max())):
            out = np.where(rest > k, _advance(out), out)
        return (out ^ np.uint32(0xFFFFFFFF))[back]

    def short(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The linear part of spans of 1 to `distances` bytes; spans may overlap."""
        size = end - start
        first = np.r_[0, np.cumsum(size)[:-1]]
        every = np.arange(int(size.sum())) - np.repeat(first, size)  # place in its span
        byte = data[np.repeat(start, size) + every]
        distance = np.repeat(size, size) - 1 - every
        return np.bitwise_xor.reduceat(self.table[distance * 256 + byte], first)

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """CRC-32 of data[start:end] for each span; an empty span has 0."""
        size = end - start
        out = np.zeros(len(size), np.uint32)
        small = (size > 0) & (size <= self.distances)
        large = size > self.distances
        if small.any():
            out[small] = self.short(data, start[small], end[small])
        if large.any():
            out[large] = self.long(data, start[large], end[large])
        return out ^ self.constants(size)

    def long(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The linear part of spans of any length: blocks counted from the end, each moved on by the blocks behind it.

        A block's number is taken bit by bit, so all blocks of all spans move together, once for each bit.
        """
        count = -(-(end - start) // self.distances)
        first = np.r_[0, np.cumsum(count)[:-1]]
        number = np.arange(int(count.sum())) - np.repeat(first, count)
        ends = np.repeat(end, count) - number * self.distances
        blocks = self.short(data, np.maximum(ends - self.distances, np.repeat(start, count)), ends)
        for power in range(int(count.max()).bit_length()):
            has = (number >> power & 1).astype(bool)
            blocks[has] = self._move(power, blocks[has])
        return np.bitwise_xor.reduceat(blocks, first)


def words(column: pa.Array) -> tuple[np.ndarray, Words]:
    """Lower-cased bytes of a text column, and its words' places; hashes aren't needed here."""
    data, at = buffer_of(column)
    x = LOWER[data]
    inside = ~BLANK[x]
    opens, closes = inside.copy(), inside.copy()
    if len(x):
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        border = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(x))]
        opens[border] = inside[border]
        closes[border - 1] = inside[border - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, at, "left")
    return x, Words(np.zeros(0, np.uint64), start, end, np.repeat(np.arange(len(at) - 1), np.diff(first)), first)


def features(column: pa.Array, crc: Crc, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every feature of a text column, by row, and the words of each row."""
    x, w = words(column)
    n_words = np.diff(w.first)
    if longest == 1:
        return crc.of(x, w.start, w.end).astype(np.int64) % buckets, w.row, n_words
    # Words joined by one space, so that a run of words is a span.
    size = w.end - w.start
    begin = np.r_[0, np.cumsum(size + 1)]
    joined = np.full(int(begin[-1]), 0x20, np.uint8)
    every = np.arange(int(size.sum())) - np.repeat(np.r_[0, np.cumsum(size)[:-1]][: len(size)], size)
    joined[np.repeat(begin[:-1], size) + every] = x[np.repeat(w.start, size) + every]
    found, rows = [], []
    for n in range(1, longest + 1):
        k = np.arange(max(0, len(size) - n + 1))
        k = k[w.row[k] == w.row[k + n - 1]]
        found.append(crc.of(joined, begin[k], begin[k + n] - 1).astype(np.int64) % buckets)
        rows.append(w.row[k])
    bucket, row = np.concatenate(found), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return bucket[order], row[order], n_words


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of bounded rows and bytes; a longer text is a slice of its own."""
    _, at = buffer_of(batch.column(text))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, min(a + _ROWS, int(np.searchsorted(at, at[a] + _BYTES, "right")) - 1))
        yield batch.slice(a, b - a)
        a = b


def bucket_counts(texts: DataFrame, corpus: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """corpus, bucket, n over a text column: one row for each bucket leaves a task."""
    crc = Crc()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in _parts(batch, 0):
                total += np.bincount(features(part.column(0), crc, longest, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return counted.select(F.lit(corpus).alias("corpus"), "bucket", "n")


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths; at most two rows for each bucket reach the driver."""
    counts = {"source": np.zeros(buckets), "target": np.zeros(buckets)}
    both = bucket_counts(docs.select("text"), "source", longest, buckets).unionByName(bucket_counts(target.select("text"), "target", longest, buckets))
    for r in both.toLocalIterator():
        counts[r["corpus"]][r["bucket"]] = r["n"]
    s, t = counts["source"], counts["target"]
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def draw(doc_id: int | None, seed: int) -> int:
    """A document's Gumbel number in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score for every row."""
    shared, crc = docs.sparkSession.sparkContext.broadcast(gain), Crc()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1):
                bucket, row, n_words = features(part.column(1), crc, longest, len(shared.value))
                n = np.bincount(row, minlength=part.num_rows)
                total = np.zeros(len(bucket) + 1, np.int64)
                np.cumsum(shared.value[bucket], out=total[1:])
                end = np.cumsum(n)
                weight = (total[end] - total[end - n]) // np.maximum(n, 1)
                luck = np.array([draw(i, seed) for i in part.column(0).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words), pa.array(n), pa.array(weight), pa.array(weight + luck)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(scores: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """Adds rank: 1, 2, 3 ... over the drawn share of the eligible rows, by descending score and ascending doc_id; else null."""
    ranges = ranged(scores.withColumn("_fit", eligible), [F.col("_fit").desc(), F.col("score").desc(), F.col("doc_id").asc()])
    fit = F.col("_fit").cast("long")
    starts = before(ranges, [], _before=F.lit(1))
    drawn = ranges.agg(F.floor(F.coalesce(F.sum(fit), F.lit(0)) * percent / 100).alias("_drawn"))
    rank = F.col("_before") + F.col("_in") + 1
    placed = ranges.join(F.broadcast(starts), "_range").join(F.broadcast(drawn))
    return placed.select(*scores.columns, F.when(F.col("_fit") & (rank <= F.col("_drawn")), rank).cast("long").alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every document; a rank says that it is drawn."""
    scores = checkpointed(scored(docs, gains(docs, target, longest, buckets), longest, seed))
    return ranked(scores, F.col("n_words") >= least_words, percent)


def selected(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The drawn documents with all their columns, one row for each drawn doc_id's rows."""
    drawn = resampled(docs, target, **options).where("rank is not null").select("doc_id").distinct()
    return docs.join(drawn, "doc_id", "left_semi").select(*docs.columns)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
