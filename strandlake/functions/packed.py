"""Two-bit sequences as packed bytes: A 00, C 01, G 10, T 11, most significant first, padded with zero bits.

A packed sequence is a struct of `data` and `length`. Everything is arithmetic on the bytes of a whole Arrow column: counting
looks a byte up in a table of 256 entries for each letter and takes the padding off; the complement is an exclusive or
under a mask of the padding; the reverse complement looks up the reversed byte and shifts over byte edges. No letter is
unpacked but by `decode` and `get`. A null gives null. Letters other than A, C, G, T, in either case, are packed as A.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import bytes_of

LETTERS = "ACGT"
PACKED = "struct<data:binary,length:int>"
_KIND = pa.struct([("data", pa.binary()), ("length", pa.int32())])

_CODE = np.zeros(256, np.uint8)
for _i, _c in enumerate(LETTERS):
    _CODE[[ord(_c), ord(_c.lower())]] = _i
#: The four values in each byte.
_VALUES = np.stack([np.arange(256) >> shift & 3 for shift in (6, 4, 2, 0)], 1).astype(np.uint8)
_UNPACKED = np.frombuffer(LETTERS.encode(), np.uint8)[_VALUES]
#: How often each letter occurs in each byte.
_COUNTS = np.stack([(_VALUES == v).sum(1) for v in range(4)]).astype(np.int64)
#: Bytes with their four values in reverse order, complemented.
_REVERSED = ((3 - _VALUES[:, ::-1]).astype(np.uint8) << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)


def _rows(packed: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, where each row's bytes start, and the lengths; a null row has none."""
    data = packed.field("data").fill_null(b"").cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return raw, ends - ends[0], packed.field("length").fill_null(0).to_numpy().astype(np.int64)


def _binary(data: np.ndarray, starts: np.ndarray, nulls: np.ndarray | None) -> pa.Array:
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data.tobytes())]).cast(pa.binary())
    return out if nulls is None else pa.array(out.to_pylist(), pa.binary(), mask=nulls)


def _struct(data: pa.Array, lengths: np.ndarray, nulls: np.ndarray | None) -> pa.StructArray:
    return pa.StructArray.from_arrays([data, pa.array(lengths.astype(np.int32))], fields=list(_KIND), mask=None if nulls is None else pa.array(nulls))


def _nulls(column: pa.Array) -> np.ndarray | None:
    return column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None


def _mask(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A byte of ones for each packed byte, with zeros where a row's last byte is padded."""
    mask = np.full(int(starts[-1]), 0xFF, np.uint8)
    short = np.flatnonzero(lengths % 4)
    mask[starts[short + 1] - 1] = (0xFF << 2 * (4 - lengths[short] % 4)) & 0xFF
    return mask


def pack(sequences: pa.Array) -> pa.StructArray:
    letters, at = bytes_of(sequences)
    more = (letters & 0xC0) == 0x80
    if more.any():  # a code point of several bytes is one letter
        at = np.r_[0, np.cumsum(~more)][at]
        letters = letters[~more]
    n = np.diff(at)
    starts = np.r_[0, np.cumsum(-(-n // 4))]
    codes = np.zeros(4 * int(starts[-1]), np.uint8)
    codes[np.arange(len(letters)) + np.repeat(4 * starts[:-1] - at[:-1], n)] = _CODE[letters]
    quads = codes.reshape(-1, 4)
    data = quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]
    nulls = _nulls(sequences)
    return _struct(_binary(data, starts, None), n, nulls)


def unpack(packed: pa.StructArray) -> pa.Array:
    data, starts, n = _rows(packed)
    letters = _UNPACKED[data].reshape(-1)
    ends = np.r_[0, np.cumsum(n)]
    kept = letters[np.arange(int(ends[-1])) + np.repeat(4 * starts[:-1] - ends[:-1], n)]
    out = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept.tobytes())).cast(pa.string())
    nulls = _nulls(packed)
    return out if nulls is None else pa.array(out.to_pylist(), pa.string(), mask=nulls)


def counts(packed: pa.StructArray) -> np.ndarray:
    """A row of counts of A, C, G, T for each sequence."""
    data, starts, n = _rows(packed)
    found = np.zeros((len(n), 4), np.int64)
    filled = np.flatnonzero(np.diff(starts))
    if len(filled):
        for v in range(4):
            found[filled, v] = np.add.reduceat(_COUNTS[v][data], starts[:-1][filled])
    found[:, 0] -= 4 * np.diff(starts) - n  # padding looks like A
    return found


def complemented(packed: pa.StructArray) -> pa.StructArray:
    data, starts, n = _rows(packed)
    nulls = _nulls(packed)
    return _struct(_binary((data ^ 0xFF) & _mask(starts, n), starts, None), n, nulls)


def reverse_complemented(packed: pa.StructArray) -> pa.StructArray:
    data, starts, n = _rows(packed)
    size = np.diff(starts)
    # The bytes of each row from its last to its first; the padding is now in front and is shifted out.
    place = np.arange(int(starts[-1]))
    turned = _REVERSED[data[np.repeat(starts[:-1] + starts[1:] - 1, size) - place]] if len(place) else data
    shift = np.repeat((2 * (4 * size - n)).astype(np.uint16), size)
    following = np.r_[turned[1:], np.zeros(min(1, len(turned)), np.uint8)].astype(np.uint16)
    last = starts[1:][size > 0] - 1
    following[last] = 0
    moved = ((turned.astype(np.uint16) << shift) | (following >> (8 - shift))) & 0xFF
    nulls = _nulls(packed)
    return _struct(_binary(moved.astype(np.uint8), starts, None), n, nulls)


def over_column(work: Callable[[pa.Array], pa.Array], kind: str) -> Callable[[Column], Column]:
    """An Arrow function over columns, of one over arrays."""

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        return work(column)

    return run


def encode(sequence: Column) -> Column:
    """A struct of packed bytes and length."""
    return over_column(pack, PACKED)(sequence)


def decode(packed: Column) -> Column:
    """The letters, in upper case."""
    return over_column(unpack, "string")(packed)


def complement(packed: Column) -> Column:
    """Complement of the letters; padding stays zero, so equal letters stay equal values."""
    return over_column(complemented, PACKED)(packed)


def reverse_complement(packed: Column) -> Column:
    return over_column(reverse_complemented, PACKED)(packed)


def letter_counts(packed: Column) -> Column:
    """A struct of the counts a, c, g, t."""
    names = [c.lower() for c in LETTERS]

    def work(column: pa.Array) -> pa.Array:
        found, nulls = counts(column), _nulls(column)
        return pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(4)], fields=[pa.field(x, pa.int64()) for x in names], mask=None if nulls is None else pa.array(nulls))

    return over_column(work, f"struct<{','.join(f'{x}:bigint' for x in names)}>")(packed)


def get(packed: Column, index: Column) -> Column:
    """The letter at a 0-based index, null outside; only its byte is looked at."""
    inside = (index >= 0) & (index < packed["length"])
    byte = F.conv(F.hex(F.substring(packed["data"], F.floor(index / 4).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    value = F.floor(byte / F.pow(F.lit(4), 3 - F.pmod(index, F.lit(4)))).cast("int") % 4
    return F.when(inside, F.get(F.array(*map(F.lit, LETTERS)), value))
