"""MinHash near-dedup by min-max hashing.

Every permutation of a document's shingle hashes gives two signature values, its minimum and its maximum, so half the
hash evaluations fill the signature. Bands of BAND values go into one table of (band key, document); documents that
share a key are candidates, and candidates are confirmed on their full shingle sets.

Equal sets are collapsed to their smallest doc_id first. A document in a band key's group is compared with the group's
leader (another one under each key) and with two neighbours in a random order under each key; groups of up to COVERED
documents have no other pairs. Where a larger group still holds several components, all its pairs across components are
compared, by exact counts: the group is cut into salted blocks of bounded size, those outside its largest component into
parts, every part meets every block in one task as an incidence matrix of shingles, and only links that join components
come back. So every two similar documents that share a band key end in one component; no rows are made for pairs there,
but the work grows with the size of such a group times the number of its documents outside its largest component. Groups
of the same documents are compared once. Groups are counted by partial aggregation, and the neighbour order runs over
salted parts of bounded size.

Defined results: a null text and one without words have no set, link with nothing and are kept; repeated rows share
their class; rows with a null doc_id get their class's component and aren't kept where that has a doc_id; of one doc_id
with several texts, the links of all count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, WHITE, checkpointed, documents, mix, words_of
from .embeddings import Forest
from .graph import components

SIMILARITY = 80  # per cent
BAND, BANDS = 5, 32
#: Rows of a group that one neighbour order holds, and the size up to which leader and two neighbours make all pairs.
PART, COVERED = 4096, 3
#: Documents and shingles of a block, two of which meet in a task.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 21
#: Shingles in more documents of a task than this are counted by matrix products, so many columns at a time.
_DENSE, _COLUMNS = 32, 1024
_PERMUTATIONS = BAND * BANDS // 2
_FACTORS = mix(np.arange(1, _PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 14
_ROWS = 1024


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row; fewer words than a shingle give one shingle of them all."""
    words = words_of(texts, WHITE, LOWER)
    hashes = words.hash.copy()
    n = max(0, len(hashes) - size + 1)
    joined = hashes[:n].copy()
    for k in range(1, size):
        joined = mix(joined * _STEP + hashes[k : n + k])
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            out.append(np.array([reduce(lambda x, y: mix(np.array([x * int(_STEP) + y & (1 << 64) - 1], np.uint64)).item(), hashes[a:b].tolist(), b - a)], np.uint64))
        else:
            out.append(hashes[:0])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation: all minima, then all maxima."""
    low, high = np.full(_PERMUTATIONS, 1 << 32, np.uint64), np.zeros(_PERMUTATIONS, np.uint64)
    for a in range(0, len(shingles), _CHUNK):
        hashed = shingles[None, a : a + _CHUNK] * _FACTORS[:, None] >> np.uint64(32)
        np.minimum(low, hashed.min(1), out=low)
        np.maximum(high, hashed.max(1), out=high)
    return np.concatenate([low, high])


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band; bands hold minima or maxima of different permutations, never both of one."""
    bands = signature(shingles).reshape(BANDS, BAND)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND):
        key = mix(key * _STEP + bands[:, k])
    return key.view(np.int64)


def signatures(df: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_digest (null without a set) and the band keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                sets = shingle_sets(batch.column(1), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([band_keys(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_digest", "bands"],
                )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_digest binary, bands array<long>")


def similar(a: Column, b: Column, size: int, least: int = SIMILARITY) -> Column:
    """Whether the shingle sets of two texts have at least the similarity, by exact counts."""

    @F.arrow_udf("boolean")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(x), _ROWS):
            for p, q in zip(shingle_sets(x.slice(at, _ROWS), size), shingle_sets(y.slice(at, _ROWS), size), strict=True):
                short, long = sorted((len(p), len(q)))
                if 100 * short < least * long or not short:
                    out.append(False)
                    continue
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                out.append(100 * common >= least * (len(p) + len(q) - common))
        return pa.array(out, pa.bool_())

    return run(a, b)


def confirmed(pairs: DataFrame, df: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar; every text travels once for each of its pairs."""
    texts = df.select("doc_id", "text")
    first = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("_x")), "a")
    both = first.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("_y")), "b")
    return both.where(similar(F.col("_x"), F.col("_y"), size)).select("a", "b").distinct()


def _ordered(node: Column, other: Column) -> Column:
    return F.struct(F.least(node, other).alias("a"), F.greatest(node, other).alias("b"))


def _near(rows: DataFrame, lags: int) -> Column:
    """The nodes just before this one in its salted part of a group, in an order that differs by key."""
    order = W.partitionBy("key", "_part").orderBy(F.xxhash64("node", "key", F.lit(0)), "node")
    return F.array(*[F.lag("node", k).over(order) for k in range(1, lags + 1)])


def _part(n: Column) -> Column:
    return F.pmod(F.xxhash64("node"), F.ceil(n / PART)).alias("_part")


def groups(keys: DataFrame) -> DataFrame:
    """Rows (key, node) of keys that several nodes share, with the group's size and leader."""
    counts = keys.groupBy("key").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "key")).alias("leader")).where("n > 1")
    return keys.join(counts, "key")


def first_pairs(grouped: DataFrame) -> DataFrame:
    """Each node with its group's leader and the two nodes before it."""
    rows = grouped.select("key", "node", "leader", _part(F.col("n")))
    with_near = rows.select("node", F.concat(F.array("leader"), _near(rows, 2)).alias("others"))
    return with_near.select("node", F.explode("others").alias("other")).where("other <> node").select(_ordered(F.col("node"), F.col("other")).alias("p")).select("p.a", "p.b").distinct()


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles every two of the sets share (above the diagonal)."""
    n = len(sets)
    row, shingle = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets)
    order = np.argsort(shingle, kind="stable")
    row, shingle = row[order], shingle[order]
    first = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
    many = np.repeat(np.diff(np.r_[first, len(shingle)]), np.diff(np.r_[first, len(shingle)]))
    x, y = row[(many > 1) & (many <= _DENSE)], shingle[(many > 1) & (many <= _DENSE)]
    out = np.zeros(n * n, np.int64)
    for k in range(1, min(_DENSE, len(y))):
        met = np.flatnonzero(y[k:] == y[:-k])
        if not len(met):
            break
        np.add.at(out, x[met] * n + x[met + k], 1)
    out = out.reshape(n, n)
    x, y = row[many > _DENSE], np.unique(shingle[many > _DENSE], return_inverse=True)[1]
    for a in range(0, int(y[-1]) + 1 if len(y) else 0, _COLUMNS):
        lo, hi = np.searchsorted(y, [a, a + _COLUMNS])
        there = np.zeros((n, _COLUMNS), np.float32)
        there[x[lo:hi], y[lo:hi] - a] = 1
        out += (there @ there.T).astype(np.int64)
    return np.triu(out, 1)


def joins(sets: list[np.ndarray], component: np.ndarray, least: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of components that similar sets join, as a spanning forest."""
    names, label = np.unique(component, return_inverse=True)
    size = np.array([len(s) for s in sets])
    common = common_counts(sets)
    i, j = np.nonzero(common)
    c = common[i, j]
    near = (label[i] != label[j]) & (100 * c >= least * (size[i] + size[j] - c))
    a, b = Forest(len(names)).add(label[i[near]], label[j[near]])
    return names[a], names[b]


def open_groups(grouped: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, node, component) of groups that may hold uncompared pairs across components, one for equal groups."""
    labelled = grouped.where(F.col("n") > COVERED).join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    print_ = F.struct(F.count("*"), F.sum(F.xxhash64("node").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("node", F.lit(1)))).alias("_print")
    counts = labelled.groupBy("key").agg(print_, F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high")
    return labelled.join(counts.groupBy("_print").agg(F.min("key").alias("key")).select("key"), "key")


def remaining_links(opened: DataFrame, df: DataFrame, size: int) -> DataFrame:
    """Links (a, b) between components, by exact comparison of all pairs across components within the groups.

    Every such pair has a member outside the group's largest component. So a group's members are dealt into blocks, and
    those outside the largest one into parts; each part meets each block in one task.
    """
    nodes = opened.select(F.col("node").alias("doc_id")).distinct()
    texts = df.select("doc_id", "text").where("text is not null").join(nodes, "doc_id").distinct().select(F.col("doc_id").alias("node"), "text", F.octet_length("text").alias("_bytes"))
    sized = opened.join(texts.groupBy("node").agg(F.max("_bytes").alias("_bytes")), "node")
    tasks = lambda n, bytes_: F.greatest(F.lit(1), F.ceil(n / BLOCK_ROWS), F.ceil(bytes_ / 2 / BLOCK_SHINGLES)).cast("int")
    held = sized.groupBy("key", "component").agg(F.count("*").alias("_n"), F.sum("_bytes").alias("_bytes"))
    largest = held.groupBy("key").agg(F.max(F.struct("_n", "component", "_bytes")).alias("_l"), F.sum("_n").alias("_n"), F.sum("_bytes").alias("_bytes"))
    counts = largest.select("key", F.col("_l.component").alias("_largest"), tasks(F.col("_n"), F.col("_bytes")).alias("_blocks"), tasks(F.col("_n") - F.col("_l._n"), F.col("_bytes") - F.col("_l._bytes")).alias("_parts"))
    own = opened.join(counts, "key")
    dealt = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = own.select("key", "node", "component", dealt(2, "_blocks").alias("_block"), every("_parts").alias("_part"))
    outside = own.where(F.col("component") != F.col("_largest")).select("key", "node", "component", every("_blocks").alias("_block"), dealt(3, "_parts").alias("_part"))
    placed = members.union(outside).distinct().join(texts.select("node", "text"), "node")

    def compare(table: pa.Table) -> pa.Table:
        sets = [s for batch in table.select(["text"]).to_batches(max_chunksize=_ROWS) for s in shingle_sets(batch.column(0), size)]
        a, b = joins(sets, table.column("component").to_numpy())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return placed.groupBy("key", "_block", "_part").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(df: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    signed = checkpointed(signatures(df, size))
    classes = signed.where("set_digest is not null and doc_id is not null").groupBy("set_digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    classes = checkpointed(classes)
    grouped = checkpointed(groups(classes.select("node", F.explode("bands").alias("key"))))
    links = checkpointed(confirmed(first_pairs(grouped), df, size))
    labels = components(links)
    more = checkpointed(remaining_links(checkpointed(open_groups(grouped, labels)), df, size))
    if not more.isEmpty():
        labels = components(links.union(more))
    found = classes.select("set_digest", "node").join(labels, "node", "left").select("set_digest", F.coalesce("component", "node").alias("_component"))
    component = F.coalesce("_component", "doc_id")
    return signed.drop("bands").join(found, "set_digest", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), 2)
