"""FNV-1a over k-mers, vectorised: unsigned 64-bit arithmetic that wraps isn't available as a Spark expression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import bytes_of

#: FNV-1a, 64 bits. Fixed values.
OFFSET, PRIME = 14695981039346656037, 1099511628211

_CLEAN = np.zeros(256, bool)
_CLEAN[[ord(c) for c in "ACGT"]] = True


def kmer_hashes(sequence: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of A, C, G, T only, and where each starts, in order."""
    n = len(sequence) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    clean = np.cumsum(np.r_[0, _CLEAN[sequence]])
    at = np.flatnonzero(clean[k:] - clean[:-k] == k)
    h = np.full(len(at), OFFSET, np.uint64)
    for i in range(k):
        h = (h ^ sequence[at + i]) * np.uint64(PRIME)
    return h, at


_TWO_BITS = np.zeros(256, np.uint64)
_TWO_BITS[list(b"ACGT")] = range(4)


def kmer_codes(sequence: np.ndarray, k: int, canonical: bool = False) -> np.ndarray:
    """The clean k-mers of a text as numbers of two bits a letter, k up to 31; canonical: the lesser of it and its reverse complement."""
    n = len(sequence) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    clean = np.cumsum(np.r_[0, _CLEAN[sequence]])
    at = np.flatnonzero(clean[k:] - clean[:-k] == k)
    letters, code, turned = _TWO_BITS[sequence], np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for i in range(k):
        x = letters[at + i]
        code = code << np.uint64(2) | x
        if canonical:
            turned |= (np.uint64(3) - x) << np.uint64(2 * i)
    return np.minimum(code, turned) if canonical else code


def kmer_texts(codes: np.ndarray, k: int) -> pa.Array:
    """The letters of k-mers in two bits."""
    shifts = np.arange(2 * (k - 1), -1, -2, dtype=np.uint64)
    letters = np.frombuffer(b"ACGT", np.uint8)[(codes[:, None] >> shifts & np.uint64(3)).astype(np.int64)]
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(np.arange(0, k * len(codes) + 1, k, dtype=np.int32)), pa.py_buffer(letters.tobytes()))


def sketch(sequence: Column, k: int, size: int) -> Column:
    """The `size` smallest k-mer hashes with repeats, ascending, as DECIMAL(20,0). A batch is hashed as one text."""

    @F.arrow_udf("array<decimal(20,0)>")
    def run(sequences: pa.Array) -> pa.Array:
        data, ends = bytes_of(sequences)
        # A letter between the texts keeps k-mers from crossing them.
        starts = ends[:-1]
        hashes, at = kmer_hashes(np.insert(data, starts, 0), k)
        row = np.searchsorted(starts + np.arange(len(starts)), at, "right") - 1
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        first = np.searchsorted(row, np.arange(len(sequences) + 1))
        kept = np.arange(len(row)) - first[row] < size
        counts = np.minimum(np.diff(first), size)
        values = pa.array(hashes[kept]).cast(pa.decimal128(20, 0))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), values)

    return run(sequence)


def _flat(sketches: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a column of sketches as unsigned integers, and the row of each."""
    sizes = np.diff(sketches.offsets.to_numpy())
    values = sketches.flatten()
    # A decimal is 16 bytes; a hash fits into the lower eight.
    low = np.frombuffer(values.buffers()[1], np.uint64)[2 * values.offset : 2 * (values.offset + len(values)) : 2] if len(values) else np.zeros(0, np.uint64)
    return low, np.repeat(np.arange(len(sketches)), sizes)


def packed(sketch: Column) -> Column:
    """A sketch's hashes in eight bytes each, a third of what rows of decimals take in a shuffle; empty for a missing one."""

    @F.arrow_udf("binary")
    def run(sketches: pa.Array) -> pa.Array:
        hashes, row = _flat(sketches.fill_null([]) if sketches.null_count else sketches)
        starts = np.r_[0, 8 * np.cumsum(np.bincount(row, minlength=len(sketches)))]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sketches), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(hashes.tobytes())]).cast(pa.binary())

    return run(sketch)


def _unpacked(sketches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a column of packed sketches, and the row of each."""
    held = sketches.fill_null(b"").cast(pa.large_binary())
    starts = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    return np.frombuffer((held.buffers()[2] or b"")[int(starts[0]) : int(starts[-1])], np.uint64), np.repeat(np.arange(len(sketches)), np.diff(starts) // 8)


def similarity(a: Column, b: Column) -> Column:
    """Shared over all hashes of two sketches, with repeats, as multisets; 0 where one is empty or missing."""
    return packed_similarity(packed(a), packed(b))


def packed_similarity(a: Column, b: Column) -> Column:
    """`similarity` of packed sketches.

    All pairs of a batch are merged at once: hashes of both sides are sorted by pair, hash and the number of the repeat, so
    a shared one stands beside its match. The work is that of a sort, whatever the sketches' size.
    """

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        n = len(a)
        parts = []
        for column in (a, b):
            hashes, row = _unpacked(column)
            order = np.lexsort((hashes, row))
            hashes, row = hashes[order], row[order]
            opens = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, np.int64)
            repeat = np.arange(len(row)) - np.repeat(opens, np.diff(np.r_[opens, len(row)]))
            parts.append((hashes, row, repeat))
        hashes, row, repeat = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((repeat, hashes, row))
        hashes, row, repeat = hashes[order], row[order], repeat[order]
        met = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]) & (repeat[1:] == repeat[:-1])
        shared = np.bincount(row[1:][met], minlength=n)
        every = np.bincount(row, minlength=n) - shared
        return pa.array(shared / np.maximum(every, 1))

    return run(a, b)
