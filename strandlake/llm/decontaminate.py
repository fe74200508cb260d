"""Benchmark decontamination with SimHash windows.

An item of n shingles is looked for in every window of n shingles of every document (the whole document, where that is
shorter). A window's 640-bit SimHash is looked up in a multi-index of twenty blocks of 32 bits: two fingerprints within
RADIUS = 139 bits differ by at most 6 bits in some block, so the items whose block is that near, checked by the whole
distance, are all items within the radius. An unrelated block is that near once in 3700, so a lookup's candidates are about
one in two hundred of the items (128 bits in blocks of 16 would select a quarter of them). Candidates are confirmed by the
exact similarity of the weighted (counted) shingles of window and item. Windows at the least similarity of 0.8 share eight
ninths of their shingles; their fingerprints then differ by 95 bits on average with a deviation of 9, so the radius misses
less than one in a million.

Not all windows are hashed, but none is lost by that: the lesser counts of a window's shingles sum up to at least
SIMILARITY * n, and every one of them is a position of the window at which a shingle of the item starts. So a window with
fewer such positions can't reach the similarity. Positions are found in one sorted table of the items' shingles, counted
by differences of ranks, and only windows with enough of them are fingerprinted, by rolling votes.

Items are cut into blocks of about BLOCK_BYTES of text, whatever their number. CHUNK blocks at a time are indexed and
broadcast, and their matches are written before the next ones are read. Documents are never shuffled.

Words are lower-cased (A-Z) and end at white space and ASCII punctuation. Shingles have SHINGLE words, or all words of a
shorter item. Defined results: null or empty items and texts match nothing; equal items each match; of several windows
that match an item, the most similar counts, the first of equals; repeated rows are judged alike; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WHITE_OR_PUNCTUATION, blocks_for, checkpointed, documents, mix, text_bytes, words_of

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of a fingerprint, bits of a block, greatest distance of fingerprints, and of blocks of which one is that near.
BITS, PART, RADIUS = 640, 32, 139
NEAR = RADIUS // (BITS // PART)
BLOCK_BYTES, CHUNK = 2 << 20, 8
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SIEVE = 20
_ROWS, _WINDOWS = 1024, 2048

LEAKS = "array<struct<item_id:bigint,similarity:double,start_word:bigint,n_words:bigint>>"


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the shingle that starts at each word, rows not considered."""
    n = max(0, len(hashes) - size + 1)
    out = hashes[:n]
    for k in range(1, size):
        out = mix(out * _STEP + hashes[k : n + k])
    return out


def _votes(hashes: np.ndarray) -> np.ndarray:
    """Each shingle's bits, a row of 0 and 1."""
    words = mix(hashes[:, None] + np.arange(BITS // 64, dtype=np.uint64) * _STEP)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int32)


def fingerprints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of windows of `size` shingles as rows of 32-bit blocks, by rolling votes: a bit is set where more than
    half of the shingles, counted with their repeats, have it set."""
    total = np.zeros((len(hashes) + 1, BITS), np.int32)
    np.cumsum(_votes(hashes), 0, out=total[1:])
    end = np.minimum(starts + size, len(hashes))
    bits = (total[end] - total[starts]) * 2 > (end - starts)[:, None]
    return np.packbits(bits, 1).view(np.uint32)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the lesser over sum of the greater counts of each shingle."""
    found, counts = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(counts[: len(a)], minlength=len(found)), np.bincount(counts[len(a) :], minlength=len(found))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Index:
    """The items of a block: shingles, fingerprints and the multi-index over them."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        self.similarity = similarity
        words = words_of(pa.array([t for _, t in items], pa.string()), WHITE_OR_PUNCTUATION, LOWER)
        self.ids, self.sizes, self.own, by_size = [], [], [], {}
        for i, (item_id, _) in enumerate(items):
            own = words.hash[words.first[i] : words.first[i + 1]]
            if len(own):
                size = min(SHINGLE, len(own))
                by_size.setdefault(size, []).append(len(self.ids))
                self.ids.append(item_id), self.sizes.append(len(own)), self.own.append(shingles(own, size))
        self.prints = np.concatenate([fingerprints(x, np.zeros(1, np.int64), len(x)) for x in self.own]) if self.own else np.zeros((0, BITS // PART), np.uint32)
        # For each block, the values that occur, and the items that have each.
        self.blocks = []
        for b in range(BITS // PART):
            order = np.argsort(self.prints[:, b], kind="stable")
            found, first = np.unique(self.prints[order, b], return_index=True)
            self.blocks.append((found, np.split(order, first[1:])))
        self.tables = {}
        for size, members in by_size.items():
            every = np.concatenate([self.own[i] for i in members])
            item = np.repeat(members, [len(self.own[i]) for i in members])
            once = np.unique(np.stack([every, item.astype(np.uint64)]), axis=1)
            every, item = once[0], once[1].astype(np.int64)
            sieve = np.zeros(1 << _SIEVE, bool)
            sieve[every >> np.uint64(64 - _SIEVE)] = True
            self.tables[size] = (every, item, sieve)

    def lookup(self, fingerprint: np.ndarray) -> list[int]:
        """All items within RADIUS bits."""
        candidates = self.selected(fingerprint)
        return candidates[np.bitwise_count(self.prints[candidates] ^ fingerprint).sum(1) <= RADIUS].tolist() if len(candidates) else []

    def selected(self, fingerprint: np.ndarray) -> np.ndarray:
        """The items that have a block within NEAR bits."""
        near = [items[k] for (found, items), x in zip(self.blocks, fingerprint, strict=True) for k in np.flatnonzero(np.bitwise_count(found ^ x) <= NEAR)]
        return np.unique(np.concatenate(near)) if near else np.zeros(0, np.int64)

    def _starts(self, hits: np.ndarray, n: int, last: int) -> np.ndarray:
        """Windows of n shingles in which a share of the similarity of positions is among the hits."""
        starts = np.arange(max(0, hits[0] - n + 1), min(hits[-1], max(0, last - n)) + 1)
        inside = np.searchsorted(hits, starts + n) - np.searchsorted(hits, starts)
        return starts[inside >= self.similarity * n - 1e-9]

    def _found(self, every: np.ndarray, starts: np.ndarray, n: int, best: dict[int, tuple[float, int, int]]) -> None:
        """Looks up the fingerprints of a text's windows of n shingles; keeps the best window of each item of that size."""
        for a in range(0, len(starts), _WINDOWS):
            some = starts[a : a + _WINDOWS]
            for lot in np.split(some, np.flatnonzero(np.diff(some) > n) + 1):
                low = int(lot[0])
                for start, print_ in zip(lot.tolist(), fingerprints(every[low : int(lot[-1]) + n], lot - low, n), strict=True):
                    window = every[start : start + n]
                    for i in self.lookup(print_):
                        if len(self.own[i]) == n and best.get(i, (0.0,))[0] < 1.0:
                            s = weighted_similarity(window, self.own[i])
                            if s >= self.similarity and s > best.get(i, (0.0,))[0]:
                                best[i] = (s, start, len(window))

    def leaks(self, texts: pa.Array) -> list[list[dict]]:
        """For each text, the items found in it."""
        words = words_of(texts, WHITE_OR_PUNCTUATION, LOWER)
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(len(texts))]
        for size, (keys, items, sieve) in self.tables.items():
            every = shingles(words.hash, size)
            hit = np.flatnonzero(sieve[every >> np.uint64(64 - _SIEVE)])
            hit = hit[words.row[hit] == words.row[hit + size - 1]]
            low, high = np.searchsorted(keys, every[hit]), np.searchsorted(keys, every[hit], "right")
            hit, low, n = hit[high > low], low[high > low], (high - low)[high > low]
            if not len(hit):
                continue
            posting = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            at, item = np.repeat(hit, n), items[posting]
            # Distinct positions of each text and item, and the pairs that have enough of them.
            order = np.lexsort((at, item, words.row[at]))
            at, item = at[order], item[order]
            row = words.row[at]
            fresh = np.r_[True, (at[1:] != at[:-1]) | (item[1:] != item[:-1])]
            at, item, row = at[fresh], item[fresh], row[fresh]
            opens = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])])
            wanted: dict[tuple[int, int], list[np.ndarray]] = {}
            for a, b in zip(opens.tolist(), [*opens[1:].tolist(), len(at)], strict=True):
                n, r = len(self.own[item[a]]), int(row[a])
                if b - a >= self.similarity * n - 1e-9:
                    first, last = int(words.first[r]), int(words.first[r + 1]) - size + 1
                    wanted.setdefault((r, n), []).append(self._starts(at[a:b] - first, n, last - first))
            for (r, n), starts in wanted.items():
                text = every[int(words.first[r]) : int(words.first[r + 1]) - size + 1]
                found: dict[int, tuple[float, int, int]] = {}
                self._found(text, np.unique(np.concatenate(starts)), n, found)
                best[r].update({i: (s, start, k + size - 1) for i, (s, start, k) in found.items() if min(SHINGLE, self.sizes[i]) == size})
        return [[{"item_id": self.ids[i], "similarity": s, "start_word": a, "n_words": n} for i, (s, a, n) in sorted(x.items())] for x in best]


def indexes(items: DataFrame, similarity: float = SIMILARITY) -> Iterator[list[Index]]:
    """Indexes over the items (item_id, text), CHUNK blocks of about BLOCK_BYTES at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length("text") > 0)
    blocks = blocks_for(text_bytes(rows), BLOCK_BYTES)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))

    def one(b: int) -> Index:
        return Index([(r["item_id"], r["text"]) for r in rows.where(part == b).orderBy("item_id", "text").toLocalIterator()], similarity)

    for a in range(0, blocks, CHUNK):
        yield [one(b) for b in range(a, min(a + CHUNK, blocks))]


def leaks(found: list[Index], text: Column, spark: SparkSession) -> Column:
    """An array column of the items that a text contains."""

    def one(index: Index) -> Column:
        shared = spark.sparkContext.broadcast(index)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())]))

        @F.arrow_udf(LEAKS)
        def run(texts: pa.Array) -> pa.Array:
            out = []
            for a in range(0, len(texts), _ROWS):
                out += shared.value.leaks(texts.slice(a, _ROWS))
            return pa.array(out, kind)

        return run(text)

    return F.concat(*map(one, found)) if found else F.expr(f"cast(array() as {LEAKS})")


def _matches(docs: DataFrame, found: list[Index]) -> DataFrame:
    matched = docs.select("doc_id", "text").select("doc_id", F.explode(leaks(found, F.col("text"), docs.sparkSession)).alias("_l"))
    return matched.select("doc_id", "_l.*")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words for every item found in a document."""
    parts = []
    for found in indexes(items):
        if parts:
            parts[-1] = checkpointed(parts[-1])  # so that no index outlives its chunk
        parts.append(_matches(docs, found))
    return reduce(DataFrame.union, parts)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any item, with all their columns."""
    out = None
    for found in indexes(items):
        out = (docs if out is None else checkpointed(out)).where(F.size(leaks(found, F.col("text"), docs.sparkSession)) == 0)
    return out


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
