"""Helpers shared by the operators: whole Arrow text columns as numpy arrays of words, 64-bit mixing, and checkpoints.

Words are runs of bytes that are not 0x20 or 0x09-0x0D. A word's hash depends on its bytes alone, so equal words get
equal hashes in every task, and a column is hashed without making a Python object for each word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; longer only where one word is longer.
PIECE = 1 << 19

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Words for fuzzy comparison end at ASCII punctuation too.
WHITE_OR_PUNCTUATION = WHITE.copy()
WHITE_OR_PUNCTUATION[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit values that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Values of the bytes in the two independent hashes.
_BYTES = [mix(np.arange(1, 257, dtype=_U) * _U(_BASE) + _U(k << 32)) for k in range(2)]
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(n, base & _MASK, _U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=_U)
    return _powers["up"][:n], _powers["down"][:n]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of a text column in reading order: hash, first byte, byte after the last, row."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # index of each row's first word, one entry more than rows


def words_of(column: pa.Array, white: np.ndarray = WHITE, fold: np.ndarray = SAME, values: int = 0) -> Words:
    """Splits and hashes every row of a text column; fold maps bytes before hashing; values names one of two hashes."""
    data, at = buffer_of(column)
    hashes, starts, ends, a, value_of = [], [], [], 0, _BYTES[values][fold]
    while a < len(data):
        b = _cut(data, at, a, white)
        x = data[a:b]
        blank = white[x]
        borders = at[np.searchsorted(at, a, "right") : np.searchsorted(at, b, "left")] - a
        opens, closes = ~blank, ~blank
        opens[1:] &= blank[:-1]
        closes[:-1] &= blank[1:]
        opens[borders] = ~blank[borders]
        closes[borders - 1] = ~blank[borders - 1]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        up, down = powers(len(x) + 1)
        total = np.zeros(len(x) + 1, _U)
        np.cumsum(value_of[x] * up[:-1], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)))
        starts.append(s + a)
        ends.append(e + a)
        a = b
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    first = np.searchsorted(start, at, "left")
    return Words(
        np.concatenate(hashes) if hashes else np.zeros(0, _U),
        start,
        np.concatenate(ends) if ends else np.zeros(0, np.int64),
        np.repeat(np.arange(len(at) - 1), np.diff(first)),
        first,
    )


def _cut(data: np.ndarray, at: np.ndarray, a: int, white: np.ndarray) -> int:
    """Where the piece that starts at a ends: at white space or between rows, so that no word is split."""
    size = PIECE
    while a + size < len(data):
        blank = np.flatnonzero(white[data[a + max(1, size - 4096) : a + size]])
        row = at[np.searchsorted(at, a + size, "right") - 1]
        best = max(int(row), a + max(1, size - 4096) + int(blank[-1]) if len(blank) else 0)
        if best > a:
            return best
        size *= 2
    return len(data)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Total UTF-8 bytes of a column: one number, summed on the executors."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def blocks_for(total: int, block: int) -> int:
    """How many blocks of about the given size hold the total; grows with the data, so a block doesn't."""
    return max(1, -(-total // block))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder named by spark.checkpoint.dir; sets a folder only where none is named."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's setting, or a folder beside the warehouse for single-machine tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
