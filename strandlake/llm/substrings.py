"""Substring dedup by recompression.

A document's words are compressed in rounds. A round first replaces every run of one symbol by a symbol for the run, then
every pair of neighbours whose names fall in the round's left and right halves by a symbol for the pair. A new symbol's
name is made from the names of what it stands for, so names agree in all documents, and equal passages get equal symbols
but for a few at their edges. Every symbol carries the range of words that decided it, its evidence; wherever the same
words occur, the same symbol does. A third round's evidence would be longer than a window, so there are two (LEVELS).

A window of WINDOW words is anchored by the symbol of the highest level whose evidence lies inside the window, the least
by hash of several, so equal windows have equal anchors. Successive windows with one anchor form a span. Three rounds in
Spark bring the same names of the whole corpus together:

1. level 1: blocks send the anchors of all windows; they learn which ones another document has. A window whose anchor no
   other document has is done with; the others are open.
2. level 2: blocks send the spans of open windows, each with its anchor; they learn the smallest document of each. Where
   that is another one, all windows of the span are repeats. Windows that are equal have equal anchors, so where all spans
   of an anchor are equal, that settles them.
3. windows: where an anchor has several spans (at the edges of passages), the smallest document of each span sends its
   windows one by one. The smallest document that has a window is always among them, since no smaller one has its span.

Names of spans and windows are 128-bit fingerprints of all their words (two independent 64-bit polynomial hashes over
bytes), so a match verifies every word, up to chances of 2**-128 for a pair. A block is told a place where it has a
repeat, and finds its other places by comparing the words one by one.

Documents are dealt into blocks of about BLOCK_BYTES of text by hash, whatever their number. A block sends each name
once, however often it has it, as plain rows; all the rest is Spark's windows over these rows, which spill, so no task
holds more than one block. A name that is everywhere has one row for each block. Texts are shuffled once and read
again from that shuffle.

Defined results: a null text has no words; a document with fewer than WINDOW words loses none; a null doc_id counts as
larger than all others; rows with the same doc_id don't remove each other's words; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SAME, WHITE, Words, blocks_for, buffer_of, documents, mix, powers, text_bytes, words_of

WINDOW = 13
LEVELS = 2
BLOCK_BYTES = 2 << 20
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_NONE = _U((1 << 64) - 1)
_LAST = (1 << 63) - 1


class Symbols:
    """Symbols of one level in reading order: name, row, and evidence [low, high)."""

    def __init__(self, name: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.name, self.row, self.low, self.high = name, row, low, high

    def __len__(self) -> int:
        return len(self.name)


def _before(values: np.ndarray, row: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """The value of the symbol before, or that of `outside` at a row's start."""
    out = outside.copy()
    inner = np.flatnonzero(row[1:] == row[:-1]) + 1
    out[inner] = values[inner - 1]
    return out


def _after(values: np.ndarray, row: np.ndarray, outside: np.ndarray) -> np.ndarray:
    out = outside.copy()
    inner = np.flatnonzero(row[1:] == row[:-1])
    out[inner] = values[inner + 1]
    return out


def _runs(s: Symbols, first: np.ndarray) -> Symbols:
    """A run is known when its symbols and those on both sides are."""
    if not len(s):
        return s
    opens = np.r_[True, (s.name[1:] != s.name[:-1]) | (s.row[1:] != s.row[:-1])]
    at = np.flatnonzero(opens)
    n = np.diff(np.r_[at, len(s)])
    name = np.where(n == 1, s.name[at], mix(s.name[at] * _STEP + n.astype(_U) + _U(1)))
    row, low, high = s.row[at], np.minimum.reduceat(s.low, at), np.maximum.reduceat(s.high, at)
    outer_low, outer_high = first[s.row] - 1, first[s.row + 1] + 1
    # Neighbours as they were before this step: what else their own runs hold doesn't matter here.
    around_low = np.minimum(_before(s.low, s.row, outer_low)[at], _after(s.low, s.row, outer_low)[at + n - 1])
    around_high = np.maximum(_before(s.high, s.row, outer_high)[at], _after(s.high, s.row, outer_high)[at + n - 1])
    return Symbols(name, row, np.minimum(low, around_low), np.maximum(high, around_high))


def _pairs(s: Symbols, first: np.ndarray, salt: int) -> Symbols:
    """A pair is known from itself; a symbol left alone is known when the neighbour that it didn't pair with is."""
    if not len(s):
        return s
    left = mix(s.name + _U(salt)) & _U(1) == 0
    pair = np.zeros(len(s), bool)
    pair[:-1] = left[:-1] & ~left[1:] & (s.row[1:] == s.row[:-1])
    second = np.r_[False, pair[:-1]]
    low, high = s.low.copy(), s.high.copy()
    alone_left, alone_right = left & ~pair, ~left & ~second
    outer_low, outer_high = first[s.row] - 1, first[s.row + 1] + 1
    low[alone_left] = np.minimum(low, _after(s.low, s.row, outer_low))[alone_left]
    high[alone_left] = np.maximum(high, _after(s.high, s.row, outer_high))[alone_left]
    low[alone_right] = np.minimum(low, _before(s.low, s.row, outer_low))[alone_right]
    high[alone_right] = np.maximum(high, _before(s.high, s.row, outer_high))[alone_right]
    name = s.name.copy()
    at = np.flatnonzero(pair)
    name[at] = mix(s.name[at] * _STEP + mix(s.name[at + 1] + _U(2)))
    high[at] = np.maximum(s.high[at], s.high[at + 1])
    low[at] = np.minimum(s.low[at], s.low[at + 1])
    keep = ~second
    return Symbols(name[keep], s.row[keep], low[keep], high[keep])


def levels(words: Words, rounds: int = LEVELS) -> list[Symbols]:
    """The words, and the symbols after each round."""
    at = np.arange(len(words.hash))
    out = [Symbols(words.hash, words.row, at, at + 1)]
    for r in range(rounds):
        out.append(_pairs(_runs(out[-1], words.first), words.first, 1000 + r))
    return out


def _totals(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * powers(len(hashes) + 1)[0][:-1], out=total[1:])
    return total


def windows(words: Words, size: int = WINDOW) -> np.ndarray:
    """Indexes of the words that start a window."""
    n = max(0, len(words.hash) - size + 1)
    return np.flatnonzero(words.row[:n] == words.row[size - 1 : size - 1 + n]) if n else np.zeros(0, np.int64)


def range_hashes(words: Words, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of the words [low, high)."""
    total, down = _totals(words.hash), powers(len(words.hash) + 1)[1]
    return mix((total[high] - total[low]) * down[low] + (high - low).astype(_U) * _STEP)


def anchors(words: Words, starts: np.ndarray, highest: int = LEVELS, size: int = WINDOW) -> np.ndarray:
    """The anchor of each window among the levels up to the highest: a hash of its level and of the words of its evidence."""
    n = len(words.hash)
    out = np.full(len(starts), _NONE)
    total, down = _totals(words.hash), powers(n + 1)[1]
    found = levels(words, highest)
    for level in range(len(found) - 1, -1, -1):
        missing = np.flatnonzero(out == _NONE)
        if not len(missing):
            break
        s = found[level]
        fits = (s.low >= words.first[s.row]) & (s.high <= words.first[s.row + 1]) & (s.high - s.low <= size)
        name, low, high = s.name[fits], s.low[fits], s.high[fits]
        value = np.minimum(mix(mix((total[high] - total[low]) * down[low] + (high - low).astype(_U)) + name + _U(level)), _NONE - _U(1))
        # Of symbols whose evidence starts at one word, the one with the shortest counts: if a window doesn't hold that,
        # it holds none of them.
        at, end = np.full(n + size, _NONE), np.full(n + size, n + 2 * size)
        np.minimum.at(end, low, high)
        shortest = high == end[low]
        np.minimum.at(at, low[shortest], value[shortest])
        if len(missing) * 3 > n:  # all windows, by slices
            place, best, from_ = np.arange(size, n + size), np.full(n, _NONE), starts[missing]
            for o in range(size):
                np.minimum(best, np.where(end[o : o + n] <= place, at[o : o + n], _NONE), out=best)
            out[missing] = best[from_]
        else:
            begin, best = starts[missing], np.full(len(missing), _NONE)
            for o in range(size):
                np.minimum(best, np.where(end[begin + o] <= begin + size, at[begin + o], _NONE), out=best)
            out[missing] = best
    return out


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(_LAST).to_numpy()


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, the first of them before the others, and where each group opens."""
    order = np.lexsort(keys[::-1])
    opens = np.zeros(len(order), bool)
    opens[:1] = True
    for k in keys:
        x = k[order]
        opens[1:] |= x[1:] != x[:-1]
    return order, np.flatnonzero(opens)


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each value is among the keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    keys = np.sort(keys)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


class Block:
    """The words and windows of a block of documents, in an order that doesn't depend on how the rows came."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.words = words_of(self.table.column("text"))
        self.starts = windows(self.words)
        self.ids = self.table.column("doc_id").fill_null(_LAST).to_numpy()[self.words.row[self.starts]]
        self.number = table.column("_block")[0].as_py()

    def sent(self, low: np.ndarray, high: np.ndarray, first: np.ndarray, anchor: np.ndarray | None = None) -> pa.Table:
        """The distinct ranges of words [low, high) that start at the windows `first`: names, least and greatest document,
        and the first place of the least one."""
        again = words_of(self.table.column("text"), WHITE, SAME, 1)
        names = (range_hashes(self.words, low, high), range_hashes(again, low, high))
        order, at = _groups(*names)
        ids = self.ids[first][order]
        lead = np.minimum.reduceat(ids, at) if len(at) else ids
        group = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(order)]))
        place = np.where(ids == lead[group], first[order], _LAST)
        pos = np.minimum.reduceat(place, at) if len(at) else place
        one = order[at]
        long = lambda x: pa.array(x.view(np.int64))
        columns = {"_block": pa.array(np.full(len(at), self.number, np.int32))}
        if anchor is not None:
            columns["name"] = long(anchor[one])
        columns |= {"key": long(names[0][one]), "more": long(names[1][one]), "low": long(lead), "high": long(np.maximum.reduceat(ids, at) if len(at) else ids)}
        return pa.table(columns | {"pos": pa.array(pos.astype(np.int32)), "n": pa.array((high - low)[one].astype(np.int32) - WINDOW + 1)})


def _empty(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))})


_ANCHORS = "_block int, name long, several boolean"
_SPANS = "_block int, name long, key long, more long, low long, high long, pos int, n int"
_WINDOWS = "_block int, key long, more long, low long, high long, pos int, n int"


def _first_round(table: pa.Table) -> pa.Table:
    """The anchors of level 1, and whether two documents of the block have one."""
    block = Block(table)
    found = anchors(block.words, block.starts, 1)
    change = np.r_[True, (found[1:] != found[:-1]) | (block.ids[1:] != block.ids[:-1])] if len(found) else np.zeros(0, bool)
    found, ids = found[change], block.ids[change]
    order, at = _groups(found, ids)
    found, ids = found[order], ids[order]
    first = at[np.r_[True, found[at][1:] != found[at][:-1]]] if len(at) else at
    several = np.maximum.reduceat(ids, first) > ids[first] if len(first) else np.zeros(0, bool)
    return pa.table({"_block": pa.array(np.full(len(first), block.number, np.int32)), "name": pa.array(found[first].view(np.int64)), "several": pa.array(several)})


def _second_round(table: pa.Table, shared: pa.Table) -> pa.Table:
    """The spans of open windows: successive ones with one anchor."""
    if not len(table) or not len(shared):
        return _empty(_SPANS)
    block = Block(table)
    open_ = np.flatnonzero(_among(anchors(block.words, block.starts, 1), shared.column("name").to_numpy().view(_U)))
    starts = block.starts[open_]
    found = anchors(block.words, starts)
    opens = np.r_[True, (found[1:] != found[:-1]) | (starts[1:] != starts[:-1] + 1)] if len(found) else np.zeros(0, bool)
    begin = np.flatnonzero(opens)
    end = np.r_[begin[1:], len(found)][: len(begin)]
    return block.sent(starts[begin], starts[end - 1] + WINDOW, open_[begin], found[begin])


def _third_round(table: pa.Table, contested: pa.Table) -> pa.Table:
    """The windows of the spans that share their anchor with another span."""
    if not len(table) or not len(contested):
        return _empty(_WINDOWS)
    block = Block(table)
    pos, n = (contested.column(c).to_numpy().astype(np.int64) for c in ("pos", "n"))
    at = np.repeat(pos - np.cumsum(n) + n, n) + np.arange(n.sum())
    return block.sent(block.starts[at], block.starts[at] + WINDOW, at)


def _covered(block: Block, told: pa.Table) -> np.ndarray:
    """The indexes of the words under a range that a smaller document has; told: a place of each range in the block."""
    words = block.words
    gone = np.zeros(len(words.hash) + 1, np.int32)
    if len(told):
        pos, n, least = (told.column(c).to_numpy().astype(np.int64) for c in ("pos", "n", "least"))
        every = range_hashes(words, block.starts, block.starts + WINDOW)
        order = np.argsort(every[pos], kind="stable")
        keys = every[pos][order]
        some = np.flatnonzero(_among(every, keys))
        low, high = np.searchsorted(keys, every[some]), np.searchsorted(keys, every[some], "right")
        count = high - low
        place, which = np.repeat(some, count), order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
        x, y, size = block.starts[place], block.starts[pos[which]], n[which] + WINDOW - 1
        equal = (block.ids[place] > least[which]) & (x + size <= words.first[words.row[x] + 1])
        x, y, size = x[equal], y[equal], size[equal]
        for o in range(int(size.max()) if len(size) else 0):
            here = np.minimum(o, size - 1)
            same = words.hash[x + here] == words.hash[y + here]
            if not same.all():
                x, y, size = x[same], y[same], size[same]
        np.add.at(gone, x, 1)
        np.add.at(gone, x + size, -1)
    return np.flatnonzero(np.cumsum(gone)[:-1] > 0)


def _last_pass(table: pa.Table, told: pa.Table) -> pa.Table:
    if not len(table):
        return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "n_words": pa.array([], pa.int64()), "removed": pa.array([], pa.list_(pa.int32()))})
    block = Block(table)
    words, covered = block.words, _covered(block, told)
    local = covered - words.first[words.row[covered]]
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(covered, words.first), pa.int32()), pa.array(local, pa.int32()))
    return pa.table({"doc_id": block.table.column("doc_id"), "text": block.table.column("text"), "n_words": pa.array(np.diff(words.first), pa.int64()), "removed": lists})


def removed_words(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, n_words, removed (indexes of the removed words) of every row."""
    blocks = blocks_for(text_bytes(df), block_bytes)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("_block"))
    by_block, same = docs.groupBy("_block"), W.partitionBy("name")

    sent = by_block.applyInArrow(_first_round, _ANCHORS)
    shared = sent.withColumn("_known", (F.count("*").over(same) > 1) | F.max("several").over(same)).where("_known").select("_block", "name")

    # Dealt by anchor here, so that both uses share one shuffle; an anchor's rows hold all of each of its spans.
    spans = by_block.cogroup(shared.groupBy("_block")).applyInArrow(_second_round, _SPANS).repartition("name")
    several = (F.min("key").over(same) != F.max("key").over(same)) | (F.min("more").over(same) != F.max("more").over(same))
    judged = spans.withColumn("least", F.min("low").over(W.partitionBy("name", "key", "more"))).withColumn("_contested", several & (F.col("low") == F.col("least")))
    judged = judged.where("least < high or _contested")

    # Asks for `high` too, so that both uses need the same columns.
    contested = judged.where("_contested and high >= low").select("_block", "pos", "n")
    found = by_block.cogroup(contested.groupBy("_block")).applyInArrow(_third_round, _WINDOWS)
    rest = found.withColumn("least", F.min("low").over(W.partitionBy("key", "more"))).where("least < high").select("_block", "pos", "n", "least")

    told = judged.where("least < high").select("_block", "pos", "n", "least").union(rest)
    return by_block.cogroup(told.groupBy("_block")).applyInArrow(_last_pass, "doc_id long, text string, n_words long, removed array<int>")


def kept_text(text: bytes, removed: np.ndarray) -> bytes:
    """The words that stay, joined by one blank."""
    words = text.split()
    if len(removed):
        stays = np.ones(len(words), bool)
        stays[removed] = False
        words = list(compress(words, stays.tolist()))
    return b" ".join(words)


def deduplicated(df: DataFrame) -> DataFrame:
    """doc_id and the text without the removed words, for every row with text."""
    return _finished(df, lambda kept: [k.decode(errors="replace") for k in kept], "text string").drop("n_words", "n_removed")


def _finished(df: DataFrame, shape, field: str) -> DataFrame:
    name = field.split()[0]

    def run(batches):
        for batch in batches:
            data, at = buffer_of(batch.column(1))
            removed = batch.column(3)
            gone = removed.flatten().to_numpy()
            sizes = np.diff(removed.offsets.to_numpy())
            ends = np.cumsum(sizes)
            kept = [kept_text(data[at[i] : at[i + 1]].tobytes(), gone[ends[i] - sizes[i] : ends[i]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(shape(kept), pa.string())], ["doc_id", "n_words", "n_removed", name])

    return removed_words(df).select("doc_id", "text", "n_words", "removed").mapInArrow(run, f"doc_id long, n_words long, n_removed long, {field}")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(documents(spark, sf_dir), lambda kept: [hashlib.sha256(k).hexdigest() for k in kept], "kept_sha256 string")
