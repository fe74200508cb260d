"""Pairwise distances in tiles, and their summaries.

Reads are packed where they lie into blocks of up to TILE, a row for each, and the blocks are stored once. Two parts of a
few blocks meet in one task, which reads them from the store: what is written grows with the reads, not with the pairs, no
task holds more than its two parts, and no row is made for a pair that isn't asked for. The work is that of all pairs,
spread out.

Pairs within a distance, and the least and the greatest distance, come from one matrix product for two blocks. A letter's
bits, and the products of its bits, are signs, so that equal letters add 2^k - 1 and others -1; a number of the product
holds the counts of equal places of several pairs side by side, each with a bit that is set from the count that is asked
for. For a lower bound of distances two bits of a letter are enough, which some letters share; pairs that pass are counted
in full. Where too many pass, all pairs are counted in full. How many pairs there are and the sum of their distances need
no pairs: they come from counts of letters at places.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..schema import EDIT_MAX
from ..storage import checkpointed

TILE = 4096
#: Blocks in a part.
_BLOCKS = 16
#: Distances that are counted at once; few enough to stay in a processor's cache.
_PIECE = 1 << 14
#: Rows of a product made at once, so that it stays in a processor's cache.
_HIGH = 192
#: Share of a product's pairs that may pass to be counted one by one; beyond, counting all at once costs less.
_PASSING = 1 / 16
#: Most bits of a letter in a product, which has 2^k - 1 signs for each place.
_BITS = 3
#: Letters of a block whose places are counted, and pairs of equal keys between two blocks that are taken off sums.
_LETTERS, _EQUAL = 64, 1 << 20
#: Pairs of blocks from which the search for the least and the greatest distance starts.
_STARTS = (4, 64)


def first_reads(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first n reads."""
    return df.orderBy(order).limit(n)


_BLOCK = "size int, ords binary, letters array<int>, counts binary, planes binary"


def _planes(texts: list[str], size: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The letters of texts of one size, how often each stands at each place (if they are few), and bit k of the letters'
    numbers at [k, w], in words of 64 places, a word for each text."""
    numbers = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), size)
    letters = np.unique(numbers).tolist()
    words = -(-size // 64)
    out = np.zeros((max(letters, default=0).bit_length(), words, len(texts)), np.uint64)
    for k in range(len(out)):
        bits = np.zeros((len(texts), 64 * words), bool)
        bits[:, :size] = numbers >> k & 1
        out[k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T
    counts = np.array([(numbers == x).sum(0) for x in letters] if len(letters) <= _LETTERS else [], np.int32)
    return letters, counts, out


def _telling(letters: set[int]) -> list[int]:
    """A few bits that tell the letters apart."""
    kept = list(range(max(letters, default=0).bit_length()))
    for k in reversed(tuple(kept)):
        mask = sum(1 << x for x in kept if x != k)
        if len({x & mask for x in letters}) == len(letters):
            kept.remove(k)
    return kept


def _apart(a: np.ndarray, b: np.ndarray, size: int, room: np.ndarray) -> np.ndarray:
    """Hamming distances of all texts of a and b by their planes: places in which some bit differs; room is overwritten."""
    out = np.zeros((a.shape[2], b.shape[2]), np.uint8 if size < 256 else np.int64)
    differs, bit = room[:, : a.shape[2], : b.shape[2]]
    for w in range(a.shape[1]):
        differs[:] = 0
        for k in range(len(a)):
            np.bitwise_xor(a[k, w][:, None], b[k, w][None, :], out=bit)
            np.bitwise_or(differs, bit, out=differs)
        out += np.bitwise_count(differs)
    return out


def _packed(df: DataFrame, order: str, tile: int) -> DataFrame:
    """A row for each block of up to `tile` reads of one task."""

    def row(ords: list[int], texts: list[str]) -> pa.RecordBatch:
        sizes = {len(s) for s in texts}
        if len(sizes) > 1:
            raise ValueError("reads differ in length")
        letters, counts, planes = _planes(texts, min(sizes))
        values = (min(sizes), np.array(ords, np.int64).tobytes(), letters, counts.tobytes(), planes.tobytes())
        kinds = (pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["size", "ords", "letters", "counts", "planes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ords, texts = [], []
        for batch in batches:
            ords += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
            while len(ords) >= tile:
                yield row(ords[:tile], texts[:tile])
                ords, texts = ords[tile:], texts[tile:]
        if ords:
            yield row(ords, texts)

    return df.select(F.col(order).cast("long").alias("ord"), "sequence").mapInArrow(run, _BLOCK)


def _parts(df: DataFrame, order: str, tile: int, least: int) -> DataFrame:
    """Numbered blocks in parts, stored; at least so many parts if there are blocks for them."""
    found = checkpointed(_packed(df, order, tile)).withColumn("number", F.monotonically_increasing_id())
    n = found.count()
    return checkpointed(found.repartition(max(1, -(-n // _BLOCKS), min(n, least))))


def _signs(planes: np.ndarray, places: int) -> np.ndarray:
    """A row for each text, at each place a sign for each set of its bits but the empty one: the product of its bits' signs.
    Rows multiply to 2^k - 1 for equal places, and -1 for others. A last column of 1 takes up what a product adds."""
    k, _, n = planes.shape
    bits = [1.0 - 2.0 * np.unpackbits(np.ascontiguousarray(x.T).view(np.uint8), axis=1, bitorder="little")[:, :places] for x in planes]
    sets = [np.prod([bits[i] for i in some], axis=0) for size in range(1, k + 1) for some in combinations(range(k), size)]
    return np.hstack([*sets, np.ones((n, 1))])


class Fields:
    """The other side of a product: several texts in a column, a field of bits for each. In the product, a field's highest bit
    says that a pair has at least `need` equal places (far: different ones) of so many.

    All sums on the way to a number are integers between -2^52 and 2^53, which a double holds exactly; as 2^52 is added, the
    number is the last bits of the double.
    """

    def __init__(self, signs: np.ndarray, k: int, places: int, need: int, far: bool):
        half = 1 << max(places - need, need - 1, 0).bit_length()
        width, self.n = half.bit_length(), len(signs)
        # A field, times 2^k: half a step up or down for each sign, and what makes a count of `need` half its range.
        added = ((2**k - 1) * places if far else places) + 2**k * (half - need)
        most = (2**k - 1) * places + abs(added)
        fields = max(n for n in range(1, 52) if n == 1 or most * sum(1 << width * f for f in range(n)) < 2**52)
        self.columns = -(-self.n // fields)
        weights = 2.0 ** (width * np.arange(fields))
        at = np.minimum(np.arange(fields * self.columns), self.n - 1)
        table = np.tensordot(-weights if far else weights, signs[at].reshape(fields, self.columns, -1), 1).T
        table[-1] = added * weights.sum() + 2.0**52
        self.table = np.ascontiguousarray(table)
        self.places = [np.uint64(width * (f + 1) - 1 + k) for f in range(fields)]
        self.mask = np.uint64(sum(1 << int(x) for x in self.places))

    def found(self, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Index pairs with the bit set; none where too many have it."""
        found, n = [], 0
        room = np.empty((min(len(signs), _HIGH), self.columns))
        for x in range(0, len(signs), _HIGH):
            bits = np.dot(signs[x : x + _HIGH], self.table, out=room[: min(_HIGH, len(signs) - x)]).view(np.uint64)
            bits &= self.mask
            at = np.flatnonzero(bits != 0)
            found.append((at + x * self.columns, bits.ravel()[at]))
            n += int(np.bitwise_count(found[-1][1]).sum())
            if n > _PASSING * (x + len(bits)) * self.n:
                return None
        at, bits = (np.concatenate(c) for c in zip(*found, strict=True))
        x, y = np.divmod(at, self.columns)
        out = []
        for f, place in enumerate(self.places):
            own = (bits >> place & np.uint64(1) != 0) & (y + f * self.columns < self.n)
            out.append((x[own], y[own] + f * self.columns))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Meeting:
    """Two blocks: the keys i and j of their texts, the planes p and q of the bits that tell their letters apart."""

    def __init__(self, row: dict, once: bool, kept: dict):
        if row["size_a"] != row["size_b"]:
            raise ValueError("reads differ in length")
        self.size, self.kept = row["size_a"], kept
        self.numbers = row["number_a"], row["number_b"]
        self.same = once and row["number_a"] == row["number_b"]
        self.letters = row["letters_a"], row["letters_b"]
        self.counts = [np.frombuffer(row[f"counts_{s}"], np.int32).reshape(-1, self.size) if self.size else None for s in "ab"]
        self.bits = _telling({*row["letters_a"], *row["letters_b"]})
        (self.i, self.p), (self.j, self.q) = (self._block(row, s) for s in "ab")

    def _block(self, row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
        ords, words = np.frombuffer(row[f"ords_{side}"], np.int64), -(-self.size // 64)
        held = np.frombuffer(row[f"planes_{side}"], np.uint64).reshape(max(row[f"letters_{side}"], default=0).bit_length(), words, len(ords))
        none = np.zeros(held.shape[1:], np.uint64)
        return ords, np.array([held[k] if k < len(held) else none for k in self.bits], np.uint64).reshape(len(self.bits), words, len(ords))

    def wanted(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which index pairs count."""
        return self.i[x] < self.j[y] if self.same else self.i[x] != self.j[y]

    def pieces(self) -> Iterator[Piece]:
        """All pairs."""
        met = np.isin(self.i, self.j)
        wide = min(len(self.j), _PIECE)
        high = _PIECE // wide
        room = np.empty((2, high, wide), np.uint64)
        for x in range(0, len(self.i), high):
            low = self.i[x : x + high, None]
            for y in range(0, len(self.j), wide):
                other = self.j[None, y : y + wide]
                wanted = low < other if self.same else low != other if met[x : x + high].any() else None
                yield low[:, 0], other[0], _apart(self.p[:, :, x : x + high], self.q[:, :, y : y + wide], self.size, room), wanted

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of index pairs."""
        out = np.zeros(len(x), np.int64)
        for w in range(self.p.shape[1]):
            differs = np.zeros(len(x), np.uint64)
            for a, b in zip(self.p, self.q, strict=True):
                differs |= a[w][x] ^ b[w][y]
            out += np.bitwise_count(differs)
        return out

    def _held(self, key: tuple, make: Callable) -> np.ndarray | Fields:
        """What several meetings of a task ask for."""
        if key not in self.kept:
            if len(self.kept) > 2 * _BLOCKS:
                self.kept.pop(next(iter(self.kept)))
            self.kept[key] = make()
        return self.kept[key]

    def _scanned(self, chosen: list[int], places: int, need: int, far: bool) -> tuple[np.ndarray, np.ndarray] | None:
        at, key = [self.bits.index(k) for k in chosen], (tuple(chosen), places)
        a = self._held(("a", self.numbers[0], *key), lambda: _signs(self.p[at], places))
        b = self._held(("b", self.numbers[1], *key, need, far), lambda: Fields(_signs(self.q[at], places), len(chosen), places, need, far))
        return b.found(a)

    def _coarse(self) -> tuple[list[int], float]:
        """Two bits by which letters, as often as they are there, look equal the least, and the share of pairs that do."""
        often = Counter()
        for letters, counts in zip(self.letters, self.counts, strict=True):
            often.update(dict(zip(letters, counts.sum(1).tolist(), strict=True)) if len(counts) else dict.fromkeys(letters, 1))

        def alike(bits: tuple[int, ...]) -> float:
            groups = Counter()
            for x, n in often.items():
                groups[tuple(x >> k & 1 for k in bits)] += n
            return sum(n * n for n in groups.values()) / often.total() ** 2

        best = min(combinations(self.bits, 2), key=alike) if len(self.bits) > 2 else tuple(self.bits)
        return list(best), alike(best)

    def within(self, most: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Index pairs that count and have at most so large a distance, with it; none where a product doesn't tell. Short:
        the first places may tell already, which is so where few pairs are expected."""
        if not self.bits:
            return None
        chosen, alike = self._coarse()
        enough = [p for p in range(8, self.size, 4) if p - most >= alike * p + 3.5 * (p * alike * (1 - alike)) ** 0.5] if short else []
        tries = [(chosen, p) for p in (*enough[:1], self.size)] + [(self.bits, self.size)] * (2 < len(self.bits) <= _BITS)
        for bits, places in tries:
            found = self._scanned(bits, places, places - most, False) if places > most else None
            if found is not None:
                d = self.apart(*found)
                kept = (d <= most) & self.wanted(*found)
                return found[0][kept], found[1][kept], d[kept]
        return None

    def beyond(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Index pairs that count and have at least so large a distance, with it; none where a product doesn't tell."""
        if not 0 < len(self.bits) <= _BITS or not 0 < least <= self.size:
            return None
        found = self._scanned(self.bits, self.size, least, True)
        if found is None:
            return None
        kept = self.wanted(*found)
        x, y = found[0][kept], found[1][kept]
        return x, y, self.apart(x, y)

    def totals(self) -> tuple[int, int] | None:
        """The number of pairs that count and the sum of their distances, from counts of letters at places; none where
        letters are many or keys repeat a lot."""
        if not self.size or not all(map(len, self.counts)):
            return None
        order = np.argsort(self.j, kind="stable")
        first, last = (np.searchsorted(self.j[order], self.i, side) for side in ("left", "right"))
        if (last - first).sum() > _EQUAL:
            return None
        x = np.repeat(np.arange(len(self.i)), last - first)
        y = order[np.arange(len(x)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)]
        b = dict(zip(self.letters[1], self.counts[1].astype(np.int64), strict=True))
        equal = sum(int(c.astype(np.int64) @ b[k]) for k, c in zip(self.letters[0], self.counts[0], strict=True) if k in b)
        n = len(self.i) * len(self.j)
        n, total = n - len(x), n * self.size - equal - int(self.apart(x, y).sum())
        return (n // 2, total // 2) if self.same else (n, total)


def _sides(left: DataFrame, right: DataFrame, order: str, tile: int, once: bool) -> tuple[DataFrame, DataFrame]:
    b = _parts(right, order, tile, right.sparkSession.sparkContext.defaultParallelism)
    a = b if once else _parts(left, order, tile, 1)
    return tuple(x.select(*[F.col(c).alias(f"{c}_{side}") for c in x.columns]) for x, side in ((a, "a"), (b, "b")))


def _met(pairs: DataFrame, reducer: Callable, schema: str, once: bool) -> DataFrame:
    """reducer()(meeting) of every two blocks, one reducer for a task; once: the sides are the same, and only i < j counts."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reduce, kept = reducer(), {}
        for batch in batches:
            for k in range(batch.num_rows):
                for columns in reduce(Meeting(batch.slice(k, 1).to_pylist()[0], once, kept)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return (pairs.where("number_a <= number_b") if once else pairs).mapInArrow(run, schema)


def _crossed(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.hint("shuffle_replicate_nl").crossJoin(b)


#: Keys of some reads of each side, their distances, and which of them count (None: all).
Piece = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]
#: Rows made at once.
_ROWS = 1 << 20


def _listed(most: int | None, swap: bool) -> Callable:
    def run(two: Meeting) -> Iterator[tuple[np.ndarray, ...]]:
        known = None if most is None else two.within(most)
        if known is not None:
            for at in range(0, len(known[0]), _ROWS):
                x, y, d = (c[at : at + _ROWS] for c in known)
                yield _joined([(two.i[x], two.j[y], d)], swap)
            return
        held, n = [], 0
        for i, j, d, wanted in two.pieces():
            kept = np.ones(d.shape, bool) if most is None else d <= most
            at = np.flatnonzero(kept if wanted is None else kept & wanted)
            if len(at):
                x, y = np.divmod(at, len(j))
                held.append((i[x], j[y], d[x, y].astype(np.int64)))
                n += len(x)
            if n >= _ROWS:
                yield _joined(held, swap)
                held, n = [], 0
        if held:
            yield _joined(held, swap)

    return lambda: run


def _joined(held: list[tuple[np.ndarray, ...]], swap: bool) -> tuple[np.ndarray, ...]:
    i, j, d = (np.concatenate(c) for c in zip(*held, strict=True))
    return (np.minimum(i, j), np.maximum(i, j), d) if swap else (i, j, d)


def _counted(two: Meeting) -> Iterator[tuple[list[int], ...]]:
    """One row for two blocks: pairs, the sum of their distances, the least and the greatest, all pairs counted."""
    n, total, low, high = 0, 0, None, None
    for _, _, d, wanted in two.pieces():
        some = d if wanted is None else d[wanted]
        if some.size:
            n, total = n + some.size, total + int(some.sum(dtype=np.int64))
            a, b = int(some.min()), int(some.max())
            low, high = a if low is None else min(low, a), b if high is None else max(high, b)
    if n:
        yield [n], [total], [low], [high]


def _summed(low: int | None, high: int | None) -> Callable:
    """As _counted, but distances of pairs are looked for only below the least and above the greatest one that the task knows,
    so a row's bounds are those of some pairs that include all such."""

    def reducer() -> Callable:
        bounds = [low, high]

        def run(two: Meeting) -> Iterator[tuple[list[int], ...]]:
            known = two.totals() if bounds[0] is not None else None
            near = two.within(bounds[0] - 1, True) if known and bounds[0] > 0 else ()
            far = two.beyond(bounds[1] + 1) if known and near is not None and bounds[1] < two.size else ()
            if known is None or near is None or far is None:
                rows = list(_counted(two))
                for _, _, a, b in rows:
                    bounds[:] = (a[0], b[0]) if bounds[0] is None else (min(bounds[0], a[0]), max(bounds[1], b[0]))
                yield from rows
                return
            if near and len(near[2]):
                bounds[0] = int(near[2].min())
            if far and len(far[2]):
                bounds[1] = int(far[2].max())
            if known[0]:
                yield [known[0]], [known[1]], [bounds[0]], [bounds[1]]

        return run

    return reducer


def _started(a: DataFrame, b: DataFrame, once: bool) -> tuple[int | None, int | None]:
    """The least and the greatest distance of some pairs of blocks; more of them as long as no pair differs at all places."""
    low = high = None
    n = b.count()
    for most in _STARTS:
        if n <= most:
            break
        some = _crossed(a.limit(1), b.limit(most)).repartition(most)
        low, high, size = _met(some, lambda: _counted, _TOTALS, once).agg(F.min("low"), F.max("high")).crossJoin(b.agg(F.max("size_b"))).first()
        if high == size:
            break
    return low, high


_PAIRS, _TOTALS = "i long, j long, distance long", "n long, total long, low long, high long"


def hamming_distance(df: DataFrame, order: str = "ord", most: int | None = None, tile: int = TILE) -> DataFrame:
    """(i, j, distance) for i < j, all pairs or those within a distance; reads of different lengths are an error."""
    return _met(_crossed(*_sides(df, df, order, tile, True)), _listed(most, True), _PAIRS, True)


def hamming_search(queries: DataFrame, df: DataFrame, most: int | None = None, order: str = "ord", tile: int = TILE) -> DataFrame:
    """(i, j, distance) of every query i and every other read j within a distance."""
    return _met(_crossed(*_sides(queries, df, order, tile, False)), _listed(most, False), _PAIRS, False)


def hamming_summary(df: DataFrame, queries: DataFrame | None = None, order: str = "ord", tile: int = TILE) -> DataFrame:
    """Number, least, greatest and mean distance of all pairs, or of queries with all other reads; a row for each two
    blocks is all that is summed up. Mean 0.0 and null bounds without pairs."""
    once = queries is None
    sides = _sides(df if once else queries, df, order, tile, once)
    parts = _met(_crossed(*sides), _summed(*_started(*sides, once)), _TOTALS, once)
    t = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num_pairs"), F.min("low").alias("min_distance"), F.max("high").alias("max_distance"), F.sum("total").alias("_total"))
    return t.select("num_pairs", "min_distance", "max_distance", S.mean(F.col("_total"), F.col("num_pairs")).alias("mean_distance"))


def edit_distance(df: DataFrame, most: int = EDIT_MAX, order: str = "ord") -> DataFrame:
    """(i, j, distance) of the first `most` reads, insertions, deletions and substitutions costing 1.

    The bound is the operator's own; the reads that it lets through are few, so one side of the pairs is broadcast.
    """
    some = first_reads(df, most, order)
    a = some.select(F.col(order).alias("i"), F.col("sequence").alias("_a"))
    b = some.select(F.col(order).alias("j"), F.col("sequence").alias("_b"))
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).select("i", "j", F.levenshtein("_a", "_b").cast("long").alias("distance"))


def distance_summary(distances: DataFrame) -> DataFrame:
    """Mean 0.0 and null bounds without pairs."""
    return distances.agg(F.count("*").alias("num_pairs"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"), F.coalesce(F.avg("distance"), F.lit(0.0)).alias("mean_distance"))


def distance_of(distances: DataFrame, i: int, j: int) -> DataFrame:
    a, b = sorted((i, j))
    return distances.where((F.col("i") == a) & (F.col("j") == b))
