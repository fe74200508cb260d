"""The operators in SQL: scalar functions, and table functions that take a table.

`register(session)` makes them temporary functions of a session. Scalar functions are the library's own Column expressions
or Arrow functions under a name; a table function is a Python UDTF over Arrow batches, called as `kmers(TABLE(reads), 21)`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from . import packed
from .hashing import kmer_hashes
from .vectors import bytes_of, mean_bytes

#: SQL functions with a body in SQL, so that the optimizer sees through them: name, parameters, result, body.
BODIES = [
    ("reverse_complement", "s STRING", "STRING", "reverse(translate(regexp_replace(s, '[^ACGTNacgtn]', 'N'), 'ACGTacgt', 'TGCAtgca'))"),
    ("count_letters", "s STRING, letters STRING", "BIGINT", "length(s) - length(translate(s, concat(upper(letters), lower(letters)), ''))"),
    ("gc_percent", "s STRING", "DOUBLE", "CASE WHEN s IS NOT NULL THEN coalesce(try_divide((length(s) - length(translate(s, 'GCgc', ''))) * 100.0D, length(translate(s, 'Nn', ''))), 0.0D) END"),
    ("complexity", "s STRING", "DOUBLE", "CASE WHEN length(s) = 0 THEN 0.0D ELSE size(array_distinct(split(s, ''))) / least(length(s), 4) END"),
    ("adapter_position", "s STRING, adapter STRING", "INT", "instr(s, adapter)"),
]


def _windows(sequences: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, places in the batch's bytes, rows, and places in the read of the clean k-mers of a batch."""
    data, ends = bytes_of(sequences)
    starts = ends[:-1]
    hashes, at = kmer_hashes(np.insert(data, starts, 0), k)  # a byte between the reads keeps k-mers from crossing them
    row = np.searchsorted(starts + np.arange(len(starts)), at, "right") - 1
    return hashes, at - row - 1, row, at - row - 1 - starts[row]


def _k(k: pa.Array) -> int:
    size = k[0].as_py()
    if size is None or not 3 <= size <= 31:
        raise ValueError("k must be from 3 to 31")
    return size


@arrow_udtf(returnType="id string, place bigint, kmer string")
class Kmers:
    """(id, place, kmer) of every window of A, C, G, T of the reads."""

    def eval(self, reads: pa.RecordBatch, k: pa.Array) -> Iterator[pa.Table]:
        if not reads.num_rows:
            return
        size = _k(k)
        sequences = reads.column("sequence")
        data, _ = bytes_of(sequences)
        _, at, row, place = _windows(sequences, size)
        letters = data[at[:, None] + np.arange(size)] if len(at) else np.zeros((0, size), np.uint8)
        offsets = np.arange(0, size * len(at) + 1, size, dtype=np.int32)
        kmers = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(letters.tobytes()))
        yield pa.table({"id": reads.column("id").take(pa.array(row)), "place": pa.array(place.astype(np.int64)), "kmer": kmers})


@arrow_udtf(returnType="id string, hash string")
class LeastHashes:
    """(id, hash): the least hash of the clean k-mers of each read, as text; reads without one are left out."""

    def eval(self, reads: pa.RecordBatch, k: pa.Array) -> Iterator[pa.Table]:
        if not reads.num_rows:
            return
        hashes, _, row, _ = _windows(reads.column("sequence"), _k(k))
        order = np.lexsort((hashes, row))
        first = order[np.r_[True, row[order][1:] != row[order][:-1]]] if len(order) else order
        yield pa.table({"id": reads.column("id").take(pa.array(row[first])), "hash": pa.array(hashes[first]).cast(pa.string())})


def register(session: SparkSession) -> None:
    """Registers every function in a session."""
    for name, parameters, result, body in BODIES:
        session.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    session.udf.register("mean_quality", F.arrow_udf(mean_bytes, "double"))
    for name, work, kind in (("encode_2bit", packed.pack, packed.PACKED), ("decode_2bit", packed.unpack, "string"), ("reverse_complement_2bit", packed.reverse_complemented, packed.PACKED)):
        session.udf.register(name, packed.over_column(work, kind))
    session.udtf.register("kmers", Kmers)
    session.udtf.register("least_hashes", LeastHashes)
