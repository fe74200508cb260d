"""Fill-in-middle transformation with piece tables.

A document is a list of descriptors (buffer, start, length) over two immutable buffers: its own bytes and the sentinels.
Cutting splits a descriptor, an arrangement permutes the parts and puts sentinel descriptors before them, the inverse
permutation restores the order, and a digest streams over the descriptors; no text is copied until someone asks for it.
Rows are judged one by one, in Arrow batches, without a shuffle.

The cuts fall between units, which are lines, and are drawn by a hash of seed and doc_id, so a task that runs again makes
the same cuts, and a document's form depends on nothing else.

Defined results: a null text is empty; an empty text and one that holds a sentinel stay plain (its output is the text
itself); a null doc_id is drawn as the empty string; repeated rows are transformed alike; very long texts are whole, held
once as bytes; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import buffer_of, documents

TEXT, SENTINELS = 0, 1
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Order of prefix (0), suffix (1) and middle (2) in the output of each form.
ORDERS = {PLAIN: (0,), PSM: (0, 1, 2), SPM: (1, 0, 2)}
#: Where each part stands in the text.
_PLACE = (0, 2, 1)
_ROWS = 512


@dataclass(frozen=True)
class Policy:
    """What is cut and how: a seed, per cents of texts cut and of those in suffix-first form, and the sentinels."""

    seed: int = 7
    cut_percent: int = 100
    spm_percent: int = 50
    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"

    def sentinels(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix, self.suffix, self.middle

    def draws(self, doc_id: int | None) -> list[int]:
        """Four unsigned 32-bit numbers of a document."""
        key = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return [int.from_bytes(key[i : i + 4], "big") for i in range(0, 16, 4)]


@dataclass
class Pieces:
    """A piece table: immutable buffers, and descriptors (buffer, start, length) in reading order."""

    buffers: tuple[memoryview, memoryview]
    table: list[tuple[int, int, int]] = field(default_factory=list)

    def cut(self, *at: int) -> Pieces:
        """The descriptors split at places of the reading order; a place may fall between descriptors or repeat."""
        out, begin, cuts = [], 0, sorted(at)
        for buffer, start, length in self.table:
            edges = [0, *(c - begin for c in cuts if begin <= c < begin + length), length]
            out += [(buffer, start + a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
            begin += length
        out += [(TEXT, 0, 0)] * (len(self.table) + len(cuts) - len(out))  # cuts at the end
        return Pieces(self.buffers, out)

    def arrange(self, order: tuple[int, ...]) -> Pieces:
        return Pieces(self.buffers, [self.table[k] for k in order])

    def chunks(self) -> Iterator[memoryview]:
        for buffer, start, length in self.table:
            yield self.buffers[buffer][start : start + length]

    def digest(self) -> str:
        found = hashlib.sha256()
        for chunk in self.chunks():
            found.update(chunk)
        return found.hexdigest()

    def render(self) -> bytes:
        return b"".join(self.chunks())


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(int(k) for k in np.argsort(order))


def line_ends(text: np.ndarray) -> np.ndarray:
    """The byte after each line; a last line needs no line break."""
    ends = np.flatnonzero(text == 10) + 1
    return ends if not len(text) or (len(ends) and ends[-1] == len(text)) else np.r_[ends, len(text)]


def characters(text: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((text & 0xC0) != 0x80))


def transformed(doc_id: int | None, text: np.ndarray, policy: Policy) -> tuple[int, str, Pieces, int | None, int | None]:
    """Units, form, output pieces, and code points of prefix and middle (None where plain) of a text's bytes."""
    raw = memoryview(text).cast("B") if len(text) else memoryview(b"")
    marks = policy.sentinels()
    whole = Pieces((raw, memoryview(b"".join(marks))), [(TEXT, 0, len(text))])
    ends = line_ends(text)
    n = len(ends)
    h = policy.draws(doc_id)
    found = text.tobytes() if len(text) else b""
    if not n or h[2] % 100 >= policy.cut_percent or any(m in found for m in marks):
        return n, PLAIN, whole, None, None
    form = SPM if h[3] % 100 < policy.spm_percent else PSM
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
    prefix, middle, suffix = whole.cut(a, b).table
    parts, at = (prefix, suffix, middle), 0
    named = []
    for mark, part in zip(marks, parts, strict=True):
        named.append([(SENTINELS, at, len(mark)), part])
        at += len(mark)
    pieces = Pieces(whole.buffers, [piece for k in ORDERS[form] for piece in named[k]])
    return n, form, pieces, characters(text[:a]), characters(text[a:b])


def restored(output: bytes, form: str, policy: Policy) -> Pieces:
    """The text's pieces over an output's bytes: cut at the sentinels, which are dropped, and put in the text's order.

    The text of a document that was cut holds no sentinel, so those found are the transformation's own.
    """
    view = memoryview(output)
    whole = Pieces((view, memoryview(b"")), [(TEXT, 0, len(output))])
    if form == PLAIN:
        return whole
    marks = [policy.sentinels()[k] for k in ORDERS[form]]
    starts, at = [], 0
    for mark in marks:
        starts.append(output.index(mark, at))
        at = starts[-1] + len(mark)
    ends = [*starts[1:], len(output)]
    parts = Pieces(whole.buffers, [(TEXT, s + len(m), e - s - len(m)) for s, m, e in zip(starts, marks, ends, strict=True)])
    return parts.arrange(inverse(ORDERS[form])).arrange(_PLACE)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            some = batch.slice(i, _ROWS)
            data, at = buffer_of(some.column(1))
            yield some.column(0).to_pylist(), [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


_PIECE = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


def transform(df: DataFrame, policy: Policy = Policy(), text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (the text to train on), pieces (its descriptors, in bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _rows(batches):
            found = [transformed(i, t, policy) for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()),
                    pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64()),
                    pa.array([f[2].render() for f in found], pa.binary()).cast(pa.string()),
                    pa.array([[{"buffer": b, "start": s, "length": n} for b, s, n in f[2].table] for f in found], _PIECE),
                ],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "pieces"],
            )

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, pieces array<struct<buffer:int,start:long,length:long>>"
    return df.select("doc_id", text).mapInArrow(run, schema)


def restore(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """doc_id and the text, from doc_id, output and form of transformed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restored((o or "").encode(), f, policy).render() for o, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "output", "form").mapInArrow(run, "doc_id long, text string")


def digests(df: DataFrame, policy: Policy = Policy(), text: str = "text") -> DataFrame:
    """As `transform`, with digests of the output and of the text restored from output and form in place of the texts.

    One text and its output are in memory at a time, beside the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _rows(batches):
            found = []
            for i, t in zip(ids, texts, strict=True):
                n, form, pieces, prefix, middle = transformed(i, t, policy)
                found.append((n, form, prefix, middle, pieces.digest(), restored(pieces.render(), form, policy).digest()))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return df.select("doc_id", text).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
