"""Embedding near-dedup: exact cosine links by PCA-ordered tiled comparison.

Unit vectors are rotated to principal axes (fitted on a bounded sample; any
rotation is exact, a good one is fast) and cut into leaves by halving the sample
along its leading axes. Two leaves meet only if their boxes in the leading axes
come near enough. Leaves of many rows are cut into tiles, and a task compares
one pair of tiles: single-precision products of the leading axes with the lengths
of the suffixes as one more axis, full products only for pairs that can still
reach the threshold. Tiles grow with the square root of the table, so copies of a
row do too, and pairs of tiles are dealt in waves of bounded size.
"""

from __future__ import annotations

import functools
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sieveloom.llm import graph
from sieveloom.llm.common import connected_components, drop, materialize
from sieveloom.llm.graph import merge_labels

THRESHOLD = 0.95
#: Rows that the rotation and the leaves are fitted on, at most.
SAMPLE_ROWS = 16384
#: Rows of a tile, about: at least these, and so many times the square root of all
#: rows, but no more than make so many tiles.
TILE_ROWS, TILE_ROOTS, LEAST_TILES = 2048, 48, 8
#: Bytes of a tile's vectors in double precision; rounding may add half as much.
TILE_BYTES = 24 << 20
#: A wave deals out about so many bytes of vectors, or as many rows as there are, if that is more.
WAVE_BYTES = 256 << 20
#: Found tables that are kept before they are folded into one.
FOUND_TABLES = 32
#: Leading axes of the leaves' boxes.
BOX_AXES = 12
#: Leaves at most; larger leaves are cut into more tiles.
MAX_LEAVES = 1024
#: Leading axes that a first look may take, and the share of pairs it may leave.
HEADS, LEFT = (16, 24, 32, 64, 128), 1e-3
#: Rows of one side of a block of products.
BLOCK_ROWS = 512
#: Share of a block's pairs from which all its full products are made at once.
DENSE = 0.05
#: Room for rounding in single precision (relative to the number of axes) and in
#: blocks of full products; links are decided by the full product of the pair.
SLACK, NEAR = 1e-6, 1e-10


def clean(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: rows that can link. Null ids and vectors, null or
    non-finite components and zero vectors are left out. Single-precision vectors
    stay so, as they are widened without loss where they are compared."""
    x, kind = F.col(vec_col), vectors.schema[vec_col].dataType
    kept = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists(x, lambda v: v != 0)
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad & some).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: v.cast(kept) + F.lit(0.0).cast(kept)).alias("v")
    )


def vector_key(v: str):
    """Number by which rows find their class; classes that share one are told apart by their vectors."""
    return F.xxhash64(v)


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def packed(m: np.ndarray) -> pa.Array:
    """Rows as bytes, which Spark passes on whole."""
    width = m.shape[1] * m.itemsize
    ends = np.arange(len(m) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(m))])


def unpacked(column: pa.ChunkedArray, kind: str, dim: int) -> np.ndarray:
    """Rows of ``packed`` by numpy's name of their type."""
    parts = [np.zeros((0, dim), kind)]
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = chunk.cast(pa.binary())
        if len(chunk):
            first = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset]
            parts.append(np.frombuffer(chunk.buffers()[2], kind, len(chunk) * dim, first).reshape(-1, dim))
    return np.concatenate(parts)


class Units:
    """Unit rows in double precision, made when they are asked for."""

    def __init__(self, m: np.ndarray):
        self.m = m

    def __getitem__(self, rows) -> np.ndarray:
        return unit(self.m[rows].astype(np.float64))


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # keeps very small and very large rows finite
    return m / np.sqrt((m**2).sum(1, keepdims=True))


class Layout:
    """Rotation and leaves, fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, leaves: int, axes: int = BOX_AXES):
        self.rotation = np.linalg.eigh(sample.T @ sample)[1][:, ::-1].copy()
        p = sample @ self.rotation
        self.axes = min(axes, p.shape[1])
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, cut, below, above; a leaf is -1 - number
        self.leaves = 0
        self._split(p, np.arange(len(p)), max(0, math.ceil(math.log2(max(1, leaves)))))

    def _split(self, p, rows, depth) -> int:
        spread = p[rows, : self.axes].var(axis=0) if len(rows) else np.zeros(1)
        if depth and len(rows) > 1 and spread.max() > 0:
            axis = int(spread.argmax())
            cut = float(np.median(p[rows, axis]))
            low = p[rows, axis] < cut
            if low.any() and not low.all():
                at = len(self.nodes)
                self.nodes.append((axis, cut, 0, 0))
                below = self._split(p, rows[low], depth - 1)
                above = self._split(p, rows[~low], depth - 1)
                self.nodes[at] = (axis, cut, below, above)
                return at
        self.leaves += 1
        return -self.leaves

    def leaf(self, p: np.ndarray) -> np.ndarray:
        at = np.zeros(len(p), np.int64) if self.nodes else np.full(len(p), -1)
        while (on := np.flatnonzero(at >= 0)).size:
            axis, cut, below, above = map(np.array, zip(*[self.nodes[i] for i in at[on]], strict=True))
            at[on] = np.where(p[on, axis] < cut, below, above)
        return -1 - at


def _heads(m: np.ndarray, axes: int) -> np.ndarray:
    """Leading axes and the length of the rest as one more: products of these are upper bounds."""
    if axes >= m.shape[1]:
        return m.astype(np.float32)
    rest = np.sqrt((m[:, axes:] ** 2).sum(1, keepdims=True))
    return np.concatenate([m[:, :axes], rest], axis=1).astype(np.float32)


def _turned(exact: Units, rotation: np.ndarray) -> np.ndarray:
    """Rotated rows in single precision, made block by block."""
    blocks = [(exact[i : i + 4096] @ rotation).astype(np.float32) for i in range(0, len(exact.m), 4096)]
    return np.concatenate([np.zeros((0, rotation.shape[1]), np.float32), *blocks])


def compare(a: np.ndarray, b: np.ndarray, exact_a, exact_b, threshold: float = THRESHOLD, same: bool = False):
    """Yield ``(rows of a, rows of b)`` with cosine >= threshold. ``a``, ``b``:
    rotated unit rows; ``exact_*``: the unit rows themselves, which decide."""
    d = a.shape[1]
    least = np.float32(threshold - SLACK * (d + 9))
    if not len(a) or not len(b):
        return
    some_a, some_b = a[:: max(1, len(a) // 256)], b[:: max(1, len(b) // 256)]
    axes = next((x for x in HEADS if x < d and (_heads(some_a, x) @ _heads(some_b, x).T >= least).mean() <= LEFT), d)
    head_a, head_b = _heads(a, axes), _heads(b, axes)
    for i in range(0, len(a), BLOCK_ROWS):
        for j in range(i if same else 0, len(b), BLOCK_ROWS):
            x, y = slice(i, i + BLOCK_ROWS), slice(j, j + BLOCK_ROWS)
            on = head_a[x] @ head_b[y].T >= least
            left = np.count_nonzero(on)
            if not left:
                continue
            if left > DENSE * on.size:
                full = exact_a[x] @ exact_b[y].T
                on = full >= threshold + NEAR
                u, v = np.nonzero(np.abs(full - threshold) < NEAR)
                on[u, v] = np.einsum("ij,ij->i", exact_a[i + u], exact_b[j + v]) >= threshold
                u, v = np.nonzero(on)
                u, v = i + u, j + v
            else:
                u, v = np.nonzero(on)
                u, v = i + u, j + v
                sure = np.einsum("ij,ij->i", exact_a[u], exact_b[v]) >= threshold
                u, v = u[sure], v[sure]
            if same:
                u, v = u[u < v], v[u < v]
            if len(u):
                yield u, v


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, tile_rows: int | None = None) -> DataFrame:
    """Cosine links of at least ``threshold`` (> 0) between all vectors.

    Returns ``vec_id, n_links, component_id, kept`` for every input row.
    Defined results: null, zero and non-finite vectors, vectors with null
    components and rows with a null id link with nothing (no links, own id as
    component, kept; a null id gives a null component and is not kept); vectors
    of different dimension do not link; equal vectors link with each other, one
    class of equal vectors being compared once; an id that comes repeatedly is
    returned as often, its links counted over all rows but its own; an empty
    table gives no rows. ``tile_rows``: rows of a tile, about (by default they
    follow the table).
    """
    rows = clean(vectors, id_col, vec_col)
    classes = rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # two classes can share their smallest id only if the id is repeated; the class number keeps them apart
    classes = classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("dim", F.size("v")).withColumn("key", vector_key("v"))
    classes = materialize(classes, "embed-classes")
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    dims = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    if not dims:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    keys = materialize(classes.select("cls", "rep", "copies", "key"), "embed-keys")
    shared = materialize(keys.groupBy("key").count().where("count > 1").select("key"), "embed-shared")
    clashes = materialize(classes.join(shared, "key").select("key", "v", "cls"), "embed-clashes") if shared.limit(1).count() else None
    placed = []
    for dim, total in sorted(dims.items()):
        size = tile_rows or max(TILE_ROWS, min(TILE_BYTES // (8 * dim), int(TILE_ROOTS * total**0.5), total // LEAST_TILES))
        placed.append((*_placed(classes.where(F.col("dim") == dim), total, sample_rows, size), dim, total, size))
    drop(classes)  # from here on the placed rows hold the vectors
    found = []
    for table, layout, kind, dim, total, size in placed:
        found += _compared(table, layout, kind, dim, total, threshold, size)
        drop(table)
    edges, counts = _parts(found)
    links = counts.groupBy("src").agg(F.sum("n").alias("n")).withColumnRenamed("src", "cls")
    graph_edges = edges.join(keys.select(F.col("cls").alias("src"), F.col("rep").alias("a")), "src").join(keys.select(F.col("cls").alias("dst"), F.col("rep").alias("b")), "dst")
    comp = connected_components(graph_edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), "embed")
    per_class = keys.join(links, "cls", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("key", "cls", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    keyed = rows.withColumn("key", vector_key("v"))
    if clashes is None:
        linked = keyed.drop("v").join(per_class, "key")
    else:
        alone = keyed.drop("v").join(shared, "key", "left_anti").join(per_class, "key")
        told = keyed.join(shared, "key", "left_semi").join(clashes, ["key", "v"]).select("vec_id", "cls").join(per_class, "cls")
        linked = alone.select("vec_id", "n_links", "component_id").union(told.select("vec_id", "n_links", "component_id"))
    linked = linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    linked = linked.select(F.col("vec_id").alias("__id"), "n_links", "component_id")
    out = ids.join(linked, F.col("vec_id") == F.col("__id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def _placed(classes: DataFrame, total: int, sample_rows: int, tile_rows: int) -> tuple[DataFrame, Layout, str]:
    """Classes of one dimension with their leaves, stored, the layout, and the type of the packed vectors."""
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("v").toArrow()  # at most sample_rows rows
    leaves = 1 << max(0, (total // tile_rows).bit_length() - 1)
    layout = Layout(unit(matrix(sample.column(0))), min(MAX_LEAVES, leaves))
    sent = classes.sparkSession.sparkContext.broadcast(layout)

    held = classes.select("cls", "v", "copies")
    kind = "f4" if isinstance(held.schema["v"].dataType.elementType, FloatType) else "f8"

    def place(batches):
        for batch in batches:
            m = matrix(batch.column(1))
            leaf = sent.value.leaf(unit(m) @ sent.value.rotation) if len(m) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), packed(m.astype(kind)), batch.column(2), pa.array(leaf)], names=["cls", "v", "copies", "leaf"])

    return materialize(held.mapInArrow(place, "cls long, v binary, copies long, leaf long"), "embed-placed"), layout, kind


def waves(leaf: np.ndarray, sizes: np.ndarray, near: np.ndarray, most: float):
    """Yield lists of pairs ``(x, y)`` of tiles: each pair whose leaves are near
    comes once, and a list's tiles hold ``most`` rows together, or it is one pair."""
    t, wave, held = len(leaf), [], 0
    for d in range(t // 2 + 1):
        x = np.arange(t // 2 if d and 2 * d == t else t)
        y = (x + d) % t
        on = near[leaf[x], leaf[y]]
        for u, v, n in zip(x[on].tolist(), y[on].tolist(), (sizes[x] + (sizes[y] if d else 0))[on].tolist(), strict=True):
            if wave and held + n > most:
                yield wave
                wave, held = [], 0
            wave.append((u, v))
            held += n
    if wave:
        yield wave


def _boxes(placed: DataFrame, sent, kind: str, dim: int):
    """Rows, least and greatest leading coordinates by leaf: at most MAX_LEAVES rows."""

    def box(batches):
        for batch in batches:
            leaf = batch.column(0).to_numpy()
            p = Units(unpacked(batch.column(1), kind, dim))[:] @ sent.value.rotation[:, : sent.value.axes] if len(leaf) else None
            for k in np.unique(leaf):
                q = p[leaf == k]
                yield pa.RecordBatch.from_pydict({"leaf": [k], "n": [len(q)], "lo": [q.min(0)], "hi": [q.max(0)]}, schema=made)

    made = pa.schema([("leaf", pa.int64()), ("n", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])
    parts = placed.select("leaf", "v").mapInArrow(box, "leaf long, n long, lo array<double>, hi array<double>")
    axes = range(sent.value.axes)
    ends = [F.array(*[f(F.col(c)[i]) for i in axes]).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"))]
    return parts.groupBy("leaf").agg(F.sum("n").alias("n"), *ends).orderBy("leaf").collect()


def _compared(placed: DataFrame, layout: Layout, kind: str, dim: int, total: int, threshold: float, tile_rows: int) -> list[DataFrame]:
    """For placed classes of one dimension: stored rows ``src, dst, null`` (links
    that span the components) and ``src, null, n`` (partners found, copies counted)."""
    spark = placed.sparkSession
    sent = spark.sparkContext.broadcast(layout)
    stats = _boxes(placed, sent, kind, dim)
    lo, hi = (np.array([r[c] for r in stats]) for c in ("lo", "hi"))
    far = 2 - 2 * threshold + 1e-9  # squared distance of unit vectors at the threshold
    near = np.array([(np.maximum(0, np.maximum(lo - hi[i], lo[i] - hi)) ** 2).sum(1) <= far for i in range(len(stats))])
    tiles = [max(1, round(r["n"] / tile_rows)) for r in stats]
    units = [(i, k) for i, n in enumerate(tiles) for k in range(n)]
    cut = F.broadcast(spark.createDataFrame([(r["leaf"], n) for r, n in zip(stats, tiles, strict=True)], "leaf long, tiles long"))  # at most MAX_LEAVES rows
    tiled = placed.join(cut, "leaf").withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")))

    def pair(group: pa.Table) -> pa.Table:
        side, cls, copies = (group.column(c).to_numpy() for c in ("side", "cls", "copies"))
        m = unpacked(group.column("v"), kind, dim)
        one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # 2: a tile with itself
        same = bool((side == 2).any())
        exact = [Units(m)] * 2 if same else [Units(m[one]), Units(m[two])]
        turned = [_turned(x, sent.value.rotation) for x in exact[: 2 - same]]
        labels, n = np.arange(len(cls)), np.zeros(len(cls), np.int64)
        for u, v in compare(turned[0], turned[-1], *exact, threshold, same):
            u, v = one[u], two[v]
            np.add.at(n, u, copies[v])
            np.add.at(n, v, copies[u])
            labels = merge_labels(labels, u, v)
        moved, linked = np.flatnonzero(labels != np.arange(len(cls))), np.flatnonzero(n)
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.table({
            "src": pa.chunked_array([cls[moved], cls[linked]], pa.int64()),
            "dst": pa.chunked_array([pa.array(cls[labels[moved]]), none(len(linked))], pa.int64()),
            "n": pa.chunked_array([none(len(moved)), pa.array(n[linked])], pa.int64()),
        })

    found, held = [], 0
    leaf, sizes = np.array([i for i, _ in units]), np.array([stats[i]["n"] / tiles[i] for i, _ in units])
    for wave in waves(leaf, sizes, near, max(total, WAVE_BYTES // (8 * dim))):
        plan = []
        for number, (x, y) in enumerate(wave):
            for side, (i, k) in ((2, units[x]),) if x == y else ((0, units[x]), (1, units[y])):
                plan.append((stats[i]["leaf"], k, number, side))
        plan = F.broadcast(spark.createDataFrame(plan, "leaf long, tile long, pair long, side int"))  # two rows for each task
        dealt = tiled.join(plan, ["leaf", "tile"]).select("pair", "side", "cls", "copies", "v")
        found.append(materialize(dealt.groupBy("pair").applyInArrow(pair, "src long, dst long, n long"), "embed-found"))
        held += found[-1].count()
        if len(found) >= FOUND_TABLES or len(found) > 1 and held > 4 * total:
            found = [_folded(found)]
            held = found[0].count()
    return found


def _parts(found: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    both = functools.reduce(DataFrame.union, found)
    return both.where("dst IS NOT NULL").select("src", "dst"), both.where("n IS NOT NULL").select("src", "n")


def _folded(found: list[DataFrame]) -> DataFrame:
    """The same links as one table of two rows a class at most: its component and its count."""
    edges, counts = _parts(found)
    comp = connected_components(edges, "embed-fold")
    none = F.lit(None).cast("long")
    moved = comp.where("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst"), none.alias("n"))
    out = materialize(moved.union(counts.groupBy("src").agg(F.sum("n").alias("n")).select("src", none.alias("dst"), "n")), "embed-found")
    drop(comp, *found)
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(graph)
