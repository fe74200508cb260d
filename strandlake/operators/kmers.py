"""k-mers, sketches and their similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import sequence as S
from ..functions.vectors import bytes_of
from ..schema import KMER, SKETCH_K, SKETCH_SIZE


def _check(k: int) -> None:
    if not 3 <= k <= 31:
        raise ValueError("k must be from 3 to 31")


#: Windows put into one batch.
_WINDOWS = 1 << 16


def kmer_extraction(df: DataFrame, k: int = KMER, deduplicate: bool = False) -> DataFrame:
    """A row for every window of A, C, G, T: id_kmer_<i>, the k-mer and its quality, which ends where the read's ends.

    Deduplication keeps the first occurrence in each read. Windows are cut out of the bytes of a batch, without a shuffle.
    """
    _check(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = 0
            _, starts = bytes_of(batch.column(1))
            while a < batch.num_rows:  # pieces of bounded output; a longer read is a piece of its own
                b = max(a + 1, int(np.searchsorted(starts, starts[a] + _WINDOWS, "right")) - 1)
                yield from _extracted(batch.slice(a, b - a), k, deduplicate)
                a = b

    return df.select("id", "sequence", "quality").mapInArrow(run, "id string, sequence string, quality string")


def _extracted(reads: pa.RecordBatch, k: int, deduplicate: bool) -> Iterator[pa.RecordBatch]:
    ids, sequences, qualities = reads.columns
    data, ends = bytes_of(sequences)
    _, at = hashing.kmer_hashes(np.insert(data, ends[:-1], 0), k)
    row = np.searchsorted(ends[:-1] + np.arange(len(sequences)), at, "right") - 1
    at = at - row - 1
    if deduplicate and len(at):
        letters = np.ascontiguousarray(data[at[:, None] + np.arange(k)]).view(f"S{k}").ravel()
        order = np.lexsort((at, letters, row))
        first = np.r_[True, (letters[order][1:] != letters[order][:-1]) | (row[order][1:] != row[order][:-1])]
        kept = np.sort(order[first])
        at, row = at[kept], row[kept]
    more = np.r_[0, np.cumsum((data & 0xC0) == 0x80)]  # bytes that begin no character
    place = at - ends[row] - (more[at] - more[ends[row]])
    for a in range(0, len(at), _WINDOWS):
        p, r, i = at[a : a + _WINDOWS], row[a : a + _WINDOWS], place[a : a + _WINDOWS]
        letters = data[p[:, None] + np.arange(k)]
        kmers = pa.StringArray.from_buffers(len(p), pa.py_buffer(np.arange(0, k * len(p) + 1, k, dtype=np.int32)), pa.py_buffer(letters.tobytes()))
        names = pc.binary_join_element_wise(ids.take(pa.array(r)), pa.array(i).cast(pa.string()), "_kmer_")
        yield pa.RecordBatch.from_arrays([names, kmers, _slices(qualities, r, i, k)], ["id", "sequence", "quality"])


def _slices(qualities: pa.Array, row: np.ndarray, place: np.ndarray, k: int) -> pa.Array:
    """Characters place to place + k of the qualities of rows, as far as they go; null without a quality."""
    data, starts = bytes_of(qualities)
    taken = qualities.take(pa.array(row))
    if len(data) and data.max() >= 128:
        return pa.array([None if q is None else q[i : i + k] for q, i in zip(taken.to_pylist(), place.tolist(), strict=True)], pa.string())
    size = np.clip(np.diff(starts)[row] - place, 0, k)
    offsets = np.r_[0, np.cumsum(size)]
    cut = data[np.repeat(starts[row] + place - offsets[:-1], size) + np.arange(int(offsets[-1]))]
    out = pa.StringArray.from_buffers(len(row), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(cut.tobytes()))
    return pc.if_else(taken.is_valid(), out, None) if qualities.null_count else out


def kmer_rows(df: DataFrame, k: int) -> DataFrame:
    return df.select(F.explode(S.kmers(F.col("sequence"), k)).alias("kmer"))


def kmer_counting(df: DataFrame, k: int = KMER, canonical: bool = False) -> DataFrame:
    """Rows of k-mer and count over all reads.

    K-mers are numbers of two bits a letter, counted in each batch; a row for each of a batch is what Spark sums up, before
    and after the shuffle. Only its letters are text.
    """
    _check(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = bytes_of(batch.column(0))
            codes, n = np.unique(hashing.kmer_codes(np.insert(data, starts[:-1], 0), k, canonical), return_counts=True)
            for a in range(0, len(codes), _WINDOWS):
                yield pa.RecordBatch.from_arrays([hashing.kmer_texts(codes[a : a + _WINDOWS], k), pa.array(n[a : a + _WINDOWS])], ["kmer", "n"])

    return df.select("sequence").mapInArrow(run, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("count"))


def kmer_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_kmers"), F.count("*").alias("unique_kmers"))


def kmer_distinct(df: DataFrame, k: int = 5) -> DataFrame:
    """Distinct windows, whatever their letters."""
    return kmer_rows(df, k).agg(F.countDistinct("kmer").alias("distinct_kmers"))


def adapter_presence(df: DataFrame, adapter: str) -> DataFrame:
    """Reads that contain the whole adapter."""
    return df.agg(F.count("*").alias("total_sequences"), F.count_if(F.contains("sequence", F.lit(adapter))).alias("with_adapter"))


def minhash_sketching(df: DataFrame, k: int = SKETCH_K, size: int = SKETCH_SIZE) -> DataFrame:
    """The `size` smallest FNV-1a hashes of each read's k-mers, repeats kept."""
    _check(k)
    sketched = df.select(F.col("id").alias("sequence_id"), hashing.sketch(F.col("sequence"), k, size).alias("sketch"))
    return sketched.select("sequence_id", "sketch", F.size("sketch").alias("sketch_size"), F.lit(k).alias("k"))


def jaccard_similarity(sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Similarity of the sketches named by pairs (a, b): shared over all hashes, both counted with repeats; 0 for an empty one."""
    s = lambda side: sketches.select(F.col("sequence_id").alias(side), hashing.packed(F.col("sketch")).alias(f"_{side}"))
    # Spark takes sketches for small, by the size of the files that they are made from, and would broadcast them.
    both = pairs.join(s("a").hint("merge"), "a").join(s("b").hint("merge"), "b")
    return both.select("a", "b", hashing.packed_similarity(F.col("_a"), F.col("_b")).alias("similarity"))
