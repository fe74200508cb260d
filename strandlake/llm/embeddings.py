"""Embedding near-dedup: exact cosine threshold pairs by dual traversal of cover trees.

Unit vectors at cosine >= THRESHOLD are at most REACH apart. Equal vectors are collapsed first, with their count. The
upper tree is a set of pivots, taken farthest-first from a bounded sample, one for about BLOCK vectors; each vector joins
its nearest pivot's cell, and large cells are cut into blocks of about BLOCK vectors. Within a block, nested nets with
halving radii form the lower tree. The traversal descends both trees together: a pair of nodes whose centres are farther
apart than their covering radii and REACH is pruned, cells first, then the nodes of two blocks level by level; what is
left is compared vector by vector in double precision. No pair is pruned that could reach the threshold.

Where vectors have no structure (random ones in many dimensions), no bound prunes cells, and every pair of blocks meets;
each of these is a matrix product in single precision, whose hits within its error are compared in double precision, so
the work stays exact and spread out, but grows with the square. Blocks are stored once, and two parts of a few blocks
meet in one task, so what is written grows with the vectors, not with the pairs.

A pair of blocks returns, for each vector, how many it links with, and a spanning forest of the links, never all links.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths don't link; equal vectors link with each other; rows with a null vec_id count as vectors and aren't
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed
from .graph import components

THRESHOLD = 0.95
BLOCK = 4096
#: Most pivots of the upper tree, and the vectors sampled for them.
PIVOTS, SAMPLE = 512, 2048
RADII = (1.0, 0.5, 0.25, 0.125)
_SLACK = 1e-5  # more than double precision can be off, by far
_ROWS = 512
#: Blocks in a part, and centres of an upper net for each vector at which a block has no structure to descend.
_PART, _FLAT = 16, 0.5
#: Pairs compared at once in double precision.
_PAIRS = 1 << 16


def reach(threshold: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * threshold)))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, in double precision. The root of a difference from 2 is off by up to the root of the
    products' error: 3e-8 here, but 3e-4 in single precision, which would make radii of tight groups too small."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


class Tree:
    """Nested nets over one block. levels[k] has the centres, the node of the level above, and covering radii; members
    are listed by lowest node."""

    def __init__(self, vectors: np.ndarray, radii: tuple[float, ...] = RADII):
        n = len(vectors)
        single = vectors.astype(np.float32)
        cosines = single @ single.T
        node = np.zeros(n, np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for radius in radii:
            near = cosines >= 1 - radius * radius / 2  # cosines may be off a little: covering radii are measured below
            centre, parent, own = [], [], np.full(n, -1)
            for i in np.argsort(node, kind="stable").tolist():
                if own[i] < 0:
                    own[near[i] & (own < 0) & (node == node[i])] = len(centre)
                    own[i] = len(centre)
                    centre.append(i), parent.append(node[i])
            node = own
            cover = np.zeros(len(centre))
            np.maximum.at(cover, node, _between(vectors, np.array(centre, np.int64)[node]))
            self.levels.append((np.array(centre), np.array(parent), cover))
        self.order = np.argsort(node, kind="stable")
        self.first = np.searchsorted(node[self.order], np.arange(len(self.levels[-1][0]) + 1))


def _between(vectors: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The distance of each vector from the one whose index is given."""
    return np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nd->n", vectors, vectors[other])))


def _descend(starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each index, its run of successors: position in `at`, and successor."""
    n = sizes[at]
    back = np.repeat(np.arange(len(at)), n)
    return back, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[at], n)


def linked(x: np.ndarray, y: np.ndarray, tx: Tree, ty: Tree, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two blocks with cosine >= threshold, in parts."""
    far = reach(threshold) + _SLACK
    (cx, _, rx), (cy, _, ry) = tx.levels[0], ty.levels[0]
    if len(cx) * len(cy) > _FLAT * _FLAT * len(x) * len(y):
        yield from _compared(x, y, threshold)
        return
    for a in range(0, len(cx), _ROWS):
        i, j = np.nonzero(_apart(x[cx[a : a + _ROWS]], y[cy]) <= rx[a : a + _ROWS, None] + ry + far)
        i += a
        for k in range(1, len(tx.levels)):
            i, j = _children(tx.levels[k], i, j)
            j, i = _children(ty.levels[k], j, i)
            (px, _, sx), (py, _, sy) = tx.levels[k], ty.levels[k]
            keep = []
            for b in range(0, len(i), 1 << 16):
                u, v = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
                d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nd->n", x[px[u]], y[py[v]])))
                keep.append(d <= sx[u] + sy[v] + far)
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            i, j = i[keep], j[keep]
        # The members of the surviving node pairs, a part at a time.
        nx, ny = np.diff(tx.first), np.diff(ty.first)
        cost = np.cumsum(nx[i] * ny[j])
        cuts = np.unique(np.searchsorted(cost, np.arange(1 << 18, (cost[-1] if len(cost) else 0) + (1 << 18), 1 << 18), "right"))
        for u, v in zip(np.split(i, cuts), np.split(j, cuts), strict=True):
            big = nx[u] * ny[v] > 1 << 16
            for s, t in zip(u[big], v[big], strict=True):
                mx, my = tx.order[tx.first[s] : tx.first[s + 1]], ty.order[ty.first[t] : ty.first[t + 1]]
                for b in range(0, len(mx), _ROWS):
                    p, q = np.nonzero(x[mx[b : b + _ROWS]] @ y[my].T >= threshold)
                    yield mx[p + b], my[q]
            back, mx = _descend(tx.first, nx, u[~big])
            back2, my = _descend(ty.first, ny, v[~big][back])
            p, q = tx.order[mx[back2]], ty.order[my]
            near = np.einsum("nd,nd->n", x[p], y[q]) >= threshold
            yield p[near], q[near]


def _compared(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= threshold, all compared. A product in single precision, which is off by less than the
    rounding of each term and sum, says which ones to compare in double precision."""
    least = np.float32(threshold - (x.shape[1] + 8) * 2.0**-22)
    single, other = x.astype(np.float32), np.ascontiguousarray(y.astype(np.float32).T)
    room = np.empty((min(len(x), _ROWS), len(y)), np.float32)
    for a in range(0, len(x), _ROWS):
        some = np.dot(single[a : a + _ROWS], other, out=room[: min(_ROWS, len(x) - a)])
        rows = np.flatnonzero(some.max(1) >= least)
        p, q = np.nonzero(some[rows] >= least)
        p = rows[p] + a
        for b in range(0, len(p), _PAIRS):
            u, v = p[b : b + _PAIRS], q[b : b + _PAIRS]
            near = np.einsum("nd,nd->n", x[u], y[v]) >= threshold
            yield u[near], v[near]


def _children(level: tuple[np.ndarray, np.ndarray, np.ndarray], nodes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replaces nodes of the level above by their children; a node's children stand together."""
    parent = level[1]
    top = (parent.max() + 1) if len(parent) else 0
    starts = np.searchsorted(parent, np.arange(top))
    sizes = np.searchsorted(parent, np.arange(top), "right") - starts
    back, child = _descend(starts, sizes, nodes)
    return child, others[back]


class Forest:
    """Union by label over the rows of two blocks."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def _root(self, i: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[i]
            if (up == i).all():
                return i
            self.parent[i] = self.parent[up]
            i = up

    def add(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joins the pairs; returns those that joined two trees, in rounds that each hang a root once."""
        kept_a, kept_b = [], []
        while len(a):
            x, y = self._root(a), self._root(b)
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            if not len(a):
                break
            high, low = np.maximum(x, y), np.minimum(x, y)
            _, one = np.unique(high, return_index=True)
            self.parent[high[one]] = low[one]
            kept_a.append(a[one]), kept_b.append(b[one])
        none = np.zeros(0, np.int64)
        return (np.concatenate(kept_a), np.concatenate(kept_b)) if kept_a else (none, none)


def prepared(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, the unit vector as bytes (null where it can't link), and a digest of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, digests = [], []
            for v in batch.column(1):
                whole = v.is_valid and len(v.values) and not v.values.null_count
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0 if whole else None  # -0.0 becomes 0.0
                if x is None or not np.isfinite(x).all() or not x.any():
                    vectors.append(None), digests.append(None)
                    continue
                digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                x = x / np.abs(x).max()  # no square over- or underflows
                vectors.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary()), pa.array(digests, pa.binary())], ["vec_id", "unit", "digest"])

    return df.select(F.col(vec_id).cast("long").alias("vec_id"), embedding).mapInArrow(run, "vec_id long, unit binary, digest binary")


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def _pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each next pivot is the vector farthest from those before, so the sets are nested nets."""
    chosen, apart = [0], _apart(vectors, vectors[:1])[:, 0]
    while len(chosen) < min(n, len(vectors)):
        i = int(apart.argmax())
        if apart[i] <= 0:
            break
        chosen.append(i)
        apart = np.minimum(apart, _apart(vectors, vectors[i : i + 1])[:, 0])
    return vectors[chosen]


def _links(nodes: DataFrame, size: int, block: int, threshold: float) -> DataFrame:
    """Rows (node, n, peer): links of a node by number, or an edge of a spanning forest; nodes are of one length."""
    spark = nodes.sparkSession
    total = nodes.count()
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("unit").collect()
    pivots = _pivots(np.frombuffer(b"".join(bytes(r["unit"]) for r in sample), np.float64).reshape(-1, size), min(PIVOTS, -(-total // block)))
    shared = spark.sparkContext.broadcast(pivots)

    @F.arrow_udf("cell int, apart double")
    def nearest(units: pa.Array) -> pa.Array:
        d = _apart(_matrix(units, size), shared.value)
        return pa.StructArray.from_arrays([pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1).astype(np.float64))], ["cell", "apart"])

    placed = nodes.withColumn("_p", nearest("unit")).select("node", "weight", "unit", "_p.cell", "_p.apart")
    cells = {r["cell"]: (r["r"], -(-r["n"] // block)) for r in placed.groupBy("cell").agg(F.max("apart").alias("r"), F.count("*").alias("n")).collect()}
    names = sorted(cells)
    centres = _apart(pivots[names], pivots[names])
    radius = np.array([cells[c][0] for c in names])
    near = np.triu(centres <= radius[:, None] + radius + reach(threshold) + _SLACK)
    parts = {c: cells[c][1] for c in names}
    part = F.create_map(*[F.lit(x) for c in names for x in (c, parts[c])])[F.col("cell")]
    blocked = placed.withColumn("block", F.concat_ws(".", "cell", F.pmod(F.xxhash64("node"), part)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        x = _matrix(table.column("unit"), size)
        data = pickle.dumps((table.column("node").to_numpy(), table.column("weight").to_numpy(), x, Tree(x)))
        return pa.table({"block": table.column("block")[:1], "cell": table.column("cell")[:1], "data": pa.array([data], pa.binary())})

    packed = checkpointed(blocked.select("block", "cell", "node", "weight", "unit").groupBy("block").applyInArrow(pack, "block string, cell int, data binary"))
    partners = spark.createDataFrame([(c, [names[j] for j in np.flatnonzero(near[i])]) for i, c in enumerate(names)], "cell int, partners array<int>")
    known = packed.join(F.broadcast(partners), "cell")
    n = known.count()
    stored = checkpointed(known.repartition(max(1, -(-n // _PART), min(n, spark.sparkContext.defaultParallelism))))
    a, b = (stored.select(*[F.col(c).alias(f"{c}_{side}") for c in stored.columns]) for side in "ab")
    wanted = F.array_contains("partners_a", F.col("cell_b")) & ((F.col("cell_a") != F.col("cell_b")) | (F.col("block_a") <= F.col("block_b")))
    met = a.hint("shuffle_replicate_nl").crossJoin(b).where(wanted).select((F.col("block_a") == F.col("block_b")).alias("same"), "data_a", "data_b")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (ida, wa, x, tx), (idb, wb, y, ty) = (pickle.loads(batch.column(c)[k].as_py()) for c in (1, 2))
                same = batch.column(0)[k].as_py()
                forest = Forest(len(ida) + len(idb))
                na, nb = np.zeros(len(ida), np.int64), np.zeros(len(idb), np.int64)
                ea, eb = [], []
                for p, q in linked(x, y, tx, ty, threshold):
                    if same:
                        p, q = p[p < q], q[p < q]
                    np.add.at(na, p, wb[q])
                    np.add.at(na if same else nb, q, wa[p])
                    a, b = forest.add(p, q if same else q + len(ida))
                    ea.append(a), eb.append(b if same else b - len(ida))
                node = np.concatenate([ida[na > 0], idb[nb > 0]])
                n = np.concatenate([na[na > 0], nb[nb > 0]])
                a, b = (ida[np.concatenate(ea)], idb[np.concatenate(eb)]) if ea else (ida[:0], idb[:0])
                peer = pa.concat_arrays([pa.nulls(len(node), pa.int64()), pa.array(b)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, a])), pa.array(np.concatenate([n, np.zeros(len(a), np.int64)])), peer], ["node", "n", "peer"])

    return met.mapInArrow(meet, "node long, n long, peer long")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = checkpointed(prepared(df))
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("unit").alias("unit"))
    classes = checkpointed(classes.withColumn("size", (F.octet_length("unit") / 8).cast("int")))
    usable = classes.where("node is not null")
    found = None
    for r in usable.select("size").distinct().orderBy("size").collect():
        part = _links(usable.where(F.col("size") == r["size"]), r["size"], block, threshold)
        found = part if found is None else found.union(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], "node long, n long, peer long")
    found = checkpointed(found)
    counts = found.groupBy("node").agg(F.sum("n").alias("_n"))
    labels = components(found.where("peer is not null").select(F.col("node").alias("a"), F.col("peer").alias("b")))
    by_class = classes.join(counts, "node", "left").join(labels, "node", "left")
    by_class = by_class.select("digest", (F.coalesce("_n", F.lit(0)) + F.col("weight") - 1).alias("_links"), F.coalesce("component", "node").alias("_component"))
    component = F.coalesce("_component", "vec_id")
    joined = rows.select("vec_id", "digest").join(by_class, "digest", "left")
    return joined.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
