"""Byte-wise work over whole Arrow columns: letter counts and translation. Text is taken as single bytes.

Spark's `translate` and per-letter expressions walk a read once for every letter class; here a batch is one byte array,
counted or looked up in a single pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import AMINO_ACIDS

_ORDER = "TCAG"
_CODE = np.full(256, 4, np.int64)
_CODE[[ord(c) for c in _ORDER]] = range(4)
#: The amino acid of three letter codes, 4 standing for any other letter.
_TABLE = np.full((5, 5, 5), ord("X"), np.uint8)
_TABLE[:4, :4, :4] = np.frombuffer(AMINO_ACIDS.encode(), np.uint8).reshape(4, 4, 4)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row starts, one entry more than rows; nulls are empty."""
    texts = column.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def byte_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows (byte, n): how often each byte occurs in a text column, one row for each byte and batch, to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.bincount(bytes_of(batch.column(0))[0], minlength=256) if batch.num_rows else np.zeros(256, np.int64)
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at].astype(np.int64))], ["byte", "n"])

    return df.select(column).mapInArrow(run, "byte int, n long")


#: Cells of a table of positions and bytes that a batch is counted in; longer texts are counted by sorting.
_CELLS = 1 << 22


def position_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows (pos, q, n): how often each character code occurs at each position, from 0, one row for each and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = bytes_of(batch.column(0))
            if len(data) and data.max() >= 128:  # characters beyond ASCII are rare and taken one by one
                seen = Counter((i, ord(c)) for t in batch.column(0).to_pylist() if t for i, c in enumerate(t))
                pos, q, n = (np.array(x, np.int64) for x in zip(*((i, c, k) for (i, c), k in seen.items()), strict=True))
            else:
                size = np.diff(starts)
                key = 256 * (np.arange(len(data)) - np.repeat(starts[:-1], size)) + data
                cells = 256 * int(size.max()) if len(size) else 0
                if cells <= _CELLS:
                    table = np.bincount(key, minlength=cells)
                    found = np.flatnonzero(table)
                    n = table[found]
                else:
                    found, n = np.unique(key, return_counts=True)
                pos, q = found // 256, found % 256
            yield pa.RecordBatch.from_arrays([pa.array(pos.astype(np.int32)), pa.array(q.astype(np.int32)), pa.array(n.astype(np.int64))], ["pos", "q", "n"])

    return df.select(column).mapInArrow(run, "pos int, q int, n long")


def count_among(letters: str | None) -> Column:
    """The sum of byte counts whose byte is a letter in either case; of all, without letters."""
    n = F.col("n") if letters is None else F.when(F.col("byte").isin(*sorted({ord(c) for c in letters.upper() + letters.lower()})), F.col("n"))
    return F.coalesce(F.sum(n), F.lit(0)).cast("long")


def mean_bytes(texts: pa.Array) -> pa.Array:
    """The mean byte value of each text; 0 for an empty one, null for a missing one."""
    data, starts = bytes_of(texts)
    n, total = np.diff(starts), np.zeros(len(texts), np.int64)
    filled = np.flatnonzero(n)
    if len(filled):
        total[filled] = np.add.reduceat(data, starts[:-1][filled], dtype=np.int64)
    return pa.array(total / np.maximum(n, 1), mask=texts.is_null().to_numpy(zero_copy_only=False) if texts.null_count else None)


def mean_byte(text: Column) -> Column:
    return F.arrow_udf(mean_bytes, "double")(text)


def translated(sequence: Column, frame: int) -> Column:
    """Protein up to the first stop; an unknown codon is X; an incomplete last codon is left out."""

    @F.arrow_udf("string")
    def run(sequences: pa.Array) -> pa.Array:
        data, starts = bytes_of(sequences)
        n = np.maximum(0, np.diff(starts) - frame) // 3
        first = np.cumsum(n) - n
        codon = np.repeat(starts[:-1] + frame - 3 * first, n) + 3 * np.arange(n.sum())
        code = _CODE[data]
        letters = _TABLE[code[codon], code[codon + 1], code[codon + 2]]
        # The first stop of each row, or its end.
        stops = np.flatnonzero(letters == ord("*"))
        place = np.searchsorted(stops, first)
        stop = np.r_[stops, len(letters)][place]
        size = np.minimum(stop - first, n)
        kept = letters[np.arange(len(letters)) - np.repeat(first, n) < np.repeat(size, n)]
        offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
        texts = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(kept.tobytes())).cast(pa.string())
        return texts if not sequences.null_count else pc.if_else(sequences.is_valid(), texts, None)

    return run(sequence)


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As `bytes_of`, with one byte for each character: of those beyond ASCII only the first."""
    data, starts = bytes_of(texts)
    more = (data & 0xC0) == 0x80
    if more.any():
        starts = np.r_[0, np.cumsum(~more)][starts]
        data = data[~more]
    return data, starts


def _texts(data: np.ndarray, starts: np.ndarray, like: pa.Array) -> pa.Array:
    """A text column of ASCII bytes, null where another column is."""
    texts = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data.tobytes())).cast(pa.string())
    return pc.if_else(like.is_valid(), texts, None) if like.null_count else texts


#: The complement of each byte; N for what has none.
_COMPLEMENT = np.full(256, ord("N"), np.uint8)
_COMPLEMENT[list(b"ACGTNacgtn")] = list(b"TGCANtgcan")


def reverse_complemented(sequences: pa.Array) -> pa.Array:
    data, starts = _characters(sequences)
    place = np.repeat(starts[:-1] + starts[1:] - 1, np.diff(starts)) - np.arange(len(data))
    return _texts(_COMPLEMENT[data[place]], starts, sequences)


def reverse_complement(sequence: Column) -> Column:
    """Case is kept; whatever isn't A, C, G, T or N becomes N."""
    return F.arrow_udf(reverse_complemented, "string")(sequence)


def masked(sequence: Column, quality: Column, below: int) -> Column:
    """N where the quality byte is below the threshold; unchanged without quality; an error where the lengths differ."""

    @F.arrow_udf("string")
    def run(sequences: pa.Array, qualities: pa.Array) -> pa.Array:
        (data, starts), (scores, ends) = bytes_of(sequences), _characters(qualities)
        if len(data) and data.max() >= 128:  # letters beyond ASCII are rare and taken one by one
            return pa.array([_masked(s, q, below) for s, q in zip(sequences.to_pylist(), qualities.to_pylist(), strict=True)], pa.string())
        n, own = np.diff(starts), np.diff(ends)
        known = qualities.is_valid().to_numpy(zero_copy_only=False) & sequences.is_valid().to_numpy(zero_copy_only=False)
        if (own[known] != n[known]).any():
            raise ValueError("sequence and quality differ in length")
        low = np.zeros(len(data), bool)
        low[np.repeat(known, n)] = scores[np.repeat(known, own)] < below
        return _texts(np.where(low, np.uint8(ord("N")), data), starts, sequences)

    return run(sequence, quality)


def _masked(sequence: str | None, quality: str | None, below: int) -> str | None:
    if sequence is None or quality is None:
        return sequence
    if len(sequence) != len(quality):
        raise ValueError("sequence and quality differ in length")
    return "".join("N" if ord(q) < below else c for c, q in zip(sequence, quality, strict=True))


def distinct_characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct code points and length of each text, a batch at a time; only texts beyond ASCII are looked at one by one."""
    data, starts = bytes_of(texts)
    n = np.diff(starts)
    row = np.repeat(np.arange(len(n)), n)
    seen = np.zeros(256 * len(n), bool)
    seen[256 * row + data] = True
    distinct, length = seen.reshape(-1, 256).sum(1), n.copy()
    for i in np.unique(row[data >= 128]).tolist():
        text = data[starts[i] : starts[i + 1]].tobytes().decode(errors="replace")
        distinct[i], length[i] = len(set(text)), len(text)
    return distinct, length


def complexities(texts: pa.Array) -> pa.Array:
    """Distinct characters over the lesser of length and 4; 0 for an empty text, null for a missing one."""
    distinct, length = distinct_characters(texts)
    found = distinct / np.maximum(np.minimum(length, 4), 1)
    return pa.array(found, mask=texts.is_null().to_numpy(zero_copy_only=False) if texts.null_count else None)


def complexity(text: Column) -> Column:
    return F.arrow_udf(complexities, "double")(text)


#: Sums of a batch of reads: names of the columns that `read_sums` yields.
READ_SUMS = ("num_sequences", "total", "min_length", "max_length", "low", "q", "nq")


def read_sums(df: DataFrame, classes: dict[str, str], low: float = 0.4) -> DataFrame:
    """One row for each batch of reads: READ_SUMS, and the bytes among the letters of each class, in either case.

    One pass over the bytes of sequence and quality; `low` bounds the complexity that counts as low.
    """
    names = [*READ_SUMS, *classes]
    tables = {k: np.isin(np.arange(256), [ord(c) for c in letters.upper() + letters.lower()]) for k, letters in classes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, quality = batch.columns
            if not len(sequence):
                continue
            data, starts = bytes_of(sequence)
            seen = np.bincount(data, minlength=256)
            n = np.diff(starts)[sequence.is_valid().to_numpy(zero_copy_only=False)]
            scores = pc.less(complexities(sequence), low)
            q, nq = bytes_of(quality)[0], pc.sum(pc.utf8_length(quality)).as_py() or 0
            values = [len(sequence), len(data), int(n.min()) if len(n) else None, int(n.max()) if len(n) else None, pc.sum(scores).as_py() or 0, int(q.sum(dtype=np.int64)), nq]
            values += [int(seen[t].sum()) for t in tables.values()]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in values], names)

    return df.select("sequence", "quality").mapInArrow(run, ", ".join(f"{n} long" for n in names))
