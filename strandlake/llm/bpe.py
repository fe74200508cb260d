"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split by the tokenizer's pattern. Tier one: a minimal perfect hash over the vocabulary resolves a pre-token
that is itself a token. Tier two, for the rest: merges by a heap of adjacent pairs over doubly linked bytes, which
stays near-linear for very long pre-tokens. Results of recent pre-tokens are kept in a bounded memo on each worker.
The vocabulary file is read on the driver from a path given as a parameter, and its tables (a size fixed by the
vocabulary) are broadcast. No shuffle takes place.

Defined results: a null text is empty, with no ids; repeated rows are encoded alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens that a worker's memo holds, and the longest kept.
MEMO, MEMO_CHARS = 400_000, 48
_ROWS = 512


class PerfectHash:
    """Minimal perfect hash by displacement: one table of displacements, one slot for each key, keys verified on lookup."""

    def __init__(self, keys: list[bytes]):
        self.n = max(1, len(keys))
        self.buckets = max(1, self.n // 3)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(i)
        self.displacement = [0] * self.buckets
        self.slot_key = [-1] * self.n
        for bucket, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            d = 0
            while True:
                places = {self._place(hashes[i], d) for i in members}
                if len(places) == len(members) and all(self.slot_key[p] < 0 for p in places):
                    break
                d += 1
            self.displacement[bucket] = d
            for i in members:
                self.slot_key[self._place(hashes[i], d)] = i
        self.keys = keys

    def _place(self, h: int, d: int) -> int:
        return ((h >> 20) ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFF)) % self.n

    def find(self, key: bytes) -> int:
        """Index of the key, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        i = self.slot_key[self._place(h, self.displacement[h % self.buckets])]
        return i if i >= 0 and self.keys[i] == key else -1


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as lines:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines) if a]


class Codec:
    """Encoder and decoder for one vocabulary; a plain value that Spark can ship."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        self.tokens = [token for token, _ in ranks]
        self.ids = [rank for _, rank in ranks]
        self.hash = PerfectHash(self.tokens)
        self.pattern = pattern

    def start(self) -> Codec:
        """What a worker process derives for itself, once; its memo serves all its tasks."""
        if hasattr(self, "memo"):
            return self
        self.split = regex.compile(self.pattern).findall
        self.rank_of = dict(zip(self.tokens, self.ids, strict=True))
        self.token_of = dict(zip(self.ids, self.tokens, strict=True))
        self.memo = Memo(self)
        return self

    def pre_token(self, piece: bytes) -> list[int]:
        i = self.hash.find(piece)
        return [self.ids[i]] if i >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merges the lowest-ranked adjacent pair, the leftmost of equals, until none is in the vocabulary."""
        rank_of, n = self.rank_of, len(piece)
        get, bits = rank_of.get, n.bit_length() + 1
        low = (1 << bits) - 1
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is merged into the part before
        back = list(range(-1, n - 1))  # where the part before starts
        heap = []  # rank, start and end of a pair, in one integer
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                heap.append((r << bits | i) << bits | i + 2)
        heapify(heap)
        while heap:
            x = heappop(heap)
            stop, a = x & low, x >> bits & low
            b = end[a]
            if not b or b >= n or end[b] != stop:
                continue
            end[b] = 0
            end[a] = stop
            if stop < n:
                back[stop] = a
                e = end[stop]
                r = get(piece[a:e])
                if r is not None:
                    heappush(heap, (r << bits | a) << bits | e)
            p = back[a]
            if p >= 0:
                r = get(piece[p:stop])
                if r is not None:
                    heappush(heap, (r << bits | p) << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(rank_of[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        packed = b"".join(map(self.memo.__getitem__, self.split(text)))
        for piece in self.memo.long:
            del self.memo[piece]
        self.memo.long.clear()
        return packed

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.token_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class Memo(dict):
    """Packed ids of pre-tokens, computed at the first use; the caller drops long ones and bounds the rest."""

    def __init__(self, codec: Codec):
        self.codec, self.long = codec, []

    def __missing__(self, piece: str) -> bytes:
        ids = self.codec.pre_token(piece.encode())
        self[piece] = packed = pack(f"<{len(ids)}I", *ids)
        if len(piece) > MEMO_CHARS:
            self.long.append(piece)
        return packed


def load_codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, _ROWS):
            yield batch.slice(a, _ROWS)


def encode(df: DataFrame, codec: Codec, text: str = "text") -> DataFrame:
    """doc_id and the ids of every whole text, as a binary column of little-endian unsigned 32-bit integers."""
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = shared.value.start()
        for batch in _batches(batches):
            ids = [worker.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return df.select("doc_id", text).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, codec: Codec) -> DataFrame:
    """doc_id and the text that the ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = shared.value.start()
        for batch in _batches(batches):
            texts = [worker.decode(x or b"").decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(df: DataFrame, codec: Codec, text: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: token count and digests of the ids and of the decoded bytes."""
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def digest(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = shared.value.start()
        for batch in _batches(batches):
            counts, ids, decoded = [], [], []
            for t in batch.column(1).to_pylist():
                packed = worker.encode(t or "")
                counts.append(len(packed) // 4)
                ids.append(digest(packed))
                decoded.append(digest(worker.decode(packed)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_codec() -> Codec:
    import public_tokenizers

    return load_codec(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import documents

    return round_trip(documents(spark, sf_dir), public_codec())
