"""SimHash near-dedup: 64-bit fingerprints, Burkhard-Keller trees, components.

Fingerprints within ``radius`` differing bits agree on two of five bit blocks
(four bits cannot be enough to spoil four blocks), so each distinct fingerprint
is sent to ten shards, one for each pair of blocks. In each shard a BK-tree,
whose children are keyed by their Hamming distance to the parent, answers the
radius queries of that shard's fingerprints. The trees are not broadcast:
together they are as large as the corpus' fingerprints, so trees and queries
meet by a shuffle on the shard. A shard that holds very many fingerprints is
dealt as tiles and pairs of tiles, each pair a tree and the queries to it.
"""

from __future__ import annotations

import itertools
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveloom.llm import graph
from sieveloom.llm.common import broadcast_if_small, connected_components, materialize
from sieveloom.llm.graph import merge_labels, slices

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
BITS = 64
BLOCKS = 5
#: A shard above this many fingerprints is cut into tiles of about this size.
TILE = 4096
#: One fingerprint in so many is looked at to find such shards.
PROBE = 64
#: Rows that a task searches at once, and tree nodes it visits at once.
BATCH_ROWS = 1 << 17
FRONTIER = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of one text: majority of the bits of its shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    first = starts[:n].tolist()
    last = ((starts + lengths)[shingle - 1 :] if len(words) >= shingle else (starts + lengths)[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)), np.uint64, n)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) of every row; a null or
    wordless text has fingerprint 0."""

    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, agree: int = BLOCKS - RADIUS, bits: int = BITS) -> list[int]:
    """Bit masks, as signed longs, of every choice of ``agree`` of the blocks."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    masks = [sum(one[i] for i in chosen) for chosen in itertools.combinations(range(blocks), agree)]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in masks]


# ---- BK-trees, many at a time -------------------------------------------------


def build_forest(fps: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A BK-tree for each run of equal ``tree`` (ascending); its first row is
    the root. Returns each row's parent (-1: root) and distance to the parent.
    All rows descend one level at a time: at each node the first row that comes
    by a distance becomes that child, the others go on below it."""
    n = len(fps)
    parent, dist = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    new = np.concatenate(([True], tree[1:] != tree[:-1])) if n else np.zeros(0, bool)
    roots = np.flatnonzero(new)
    at = roots[np.cumsum(new) - 1] if n else roots
    rest = np.flatnonzero(~new)
    at = at[rest]
    while len(rest):
        d = np.bitwise_count(fps[rest] ^ fps[at]).astype(np.int64)
        key = at * (BITS + 1) + d
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        child = rest[first]
        parent[child], dist[child] = at[first], d[first]
        below = np.ones(len(rest), bool)
        below[first] = False
        rest, at = rest[below], child[back[below]]
    return parent, dist


def search_forest(fps, parent, dist, root_of, queries, query_rows, radius=RADIUS):
    """Yield arrays ``(query row, tree row)`` of pairs within ``radius``. A node at
    distance d leads on only to children keyed d - radius to d + radius."""
    order = np.lexsort((dist, parent))
    keys = parent[order] * (BITS + 1) + dist[order]
    todo = [(query_rows, root_of)]
    while todo:
        q, node = todo.pop()
        if len(q) > FRONTIER:
            half = len(q) // 2
            todo += [(q[half:], node[half:]), (q[:half], node[:half])]
            continue
        d = np.bitwise_count(queries[q] ^ fps[node]).astype(np.int64)
        hit = d <= radius
        if hit.any():
            yield q[hit], node[hit]
        lo = np.searchsorted(keys, node * (BITS + 1) + np.maximum(d - radius, 0), "left")
        hi = np.searchsorted(keys, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
        width = hi - lo
        on = width > 0
        q, lo, width = q[on], lo[on], width[on]
        if len(q):
            slot = np.repeat(lo - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
            todo.append((np.repeat(q, width), order[slot]))


def link_runs(run: np.ndarray, side: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int = RADIUS):
    """For rows sorted by (run, side): spanning links of the pairs within
    ``radius`` in each run. A run with one side is searched against itself; in a
    run with two, the second side's rows query the first side's tree."""
    n = len(run)
    new = np.concatenate(([True], run[1:] != run[:-1]))
    number = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate((start, [n])))
    two = side[start + size - 1] != side[start]  # sorted: the last row's side differs
    in_tree = ~two[number] | (side == 0)
    asks = ~two[number] | (side == 1)
    alive = size[number] > 1
    tree_rows, ask_rows = np.flatnonzero(in_tree & alive), np.flatnonzero(asks & alive)
    if not len(tree_rows) or not len(ask_rows):
        return ids[:0], ids[:0]
    tree_fps = fps[tree_rows]
    parent, dist = build_forest(tree_fps, number[tree_rows])
    root = np.searchsorted(tree_rows, start[number[ask_rows]])
    labels = np.arange(n)
    for q, node in search_forest(tree_fps, parent, dist, root, fps[ask_rows], np.arange(len(ask_rows)), radius):
        labels = merge_labels(labels, ask_rows[q], tree_rows[node])
    moved = np.flatnonzero(labels != np.arange(n))
    return ids[moved], ids[labels[moved]]


def _shards(reps: DataFrame, radius: int, tile: int, probe: int) -> DataFrame:
    """Rows ``t, k, i, j, side, fp, rep``: a fingerprint in each of its shards,
    or, in a shard of more than ``tile``, in each pair of tiles with its own."""
    masks = block_masks(radius + 2, 2)  # as many wrong bits leave two of the blocks whole
    entries = reps.select(
        "fp", "rep", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])).alias("e")
    ).select("fp", "rep", "e.t", "e.k")
    seen = entries.where(F.pmod(F.xxhash64("fp"), F.lit(probe)) == 0)
    hot = materialize(
        seen.groupBy("t", "k").count().where(F.col("count") * probe > tile)
        .select("t", "k", F.ceil(F.col("count") * probe / tile).cast("int").alias("tiles")),
        "simhash-hot",
    )
    if not hot.limit(1).count():
        return entries.select("t", "k", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "fp", "rep")
    dealt = entries.join(broadcast_if_small(hot), ["t", "k"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.select(
        "t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "fp", "rep"
    )


def links(reps: DataFrame, radius: int = RADIUS, tile: int = TILE, probe: int = PROBE) -> DataFrame:
    """``src``, ``dst``: links that span the components of fingerprints within
    ``radius`` bits. ``reps`` has one row per distinct ``fp`` and its id ``rep``."""
    shards = _shards(reps, radius, tile, probe)
    dealt = shards.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "side", "fp")

    def run(batches):
        held: list = []
        rows = 0

        def flush(last: bool):
            nonlocal held, rows
            t = [np.concatenate(x) for x in zip(*held, strict=True)]
            new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in t[:4]], axis=0)))
            cut = len(new) if last else int(np.flatnonzero(new)[-1])
            held, rows = ([[c[cut:] for c in t]], len(new) - cut) if cut < len(new) else ([], 0)
            if cut:
                return link_runs(np.cumsum(new)[:cut], t[4][:cut], t[5][:cut].view(np.uint64), t[6][:cut], radius)
            return t[6][:0], t[6][:0]

        def out(src, dst):
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows >= BATCH_ROWS:
                yield out(*flush(False))
        if rows:
            yield out(*flush(True))

    return dealt.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE_WORDS, tile: int = TILE, probe: int = PROBE) -> DataFrame:
    """Components of texts whose fingerprints link.

    Returns ``doc_id``, ``fp`` (long) and ``component_id``, one row per input
    row. Defined results: a null or wordless text has fingerprint 0 and is
    linked like any other; equal fingerprints always link; repeated rows are
    returned as often as they came; a row whose id is null gets its
    fingerprint's component, null if no row with an id shares or links it; an
    empty table gives an empty result. Other columns are not read.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL")
    reps = materialize(reps, "simhash-reps")
    found = connected_components(links(reps, radius, tile, probe), "simhash")
    member = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(member, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component, that with the smallest id; all columns
    stay. Of repeated rows of an id one stays (that with the smallest text);
    rows with a null id stay, as no id can be kept for them."""
    found = near_duplicates(docs.where("doc_id IS NOT NULL"), radius=radius)
    ids = materialize(found.groupBy("doc_id").agg(F.min("component_id").alias("low"), F.count(F.lit(1)).alias("n")).where("low = doc_id").select(F.col("doc_id").alias("__id"), "n"), "simhash-kept")
    kept = docs.join(ids.select("__id"), docs["doc_id"] == ids["__id"], "left_semi")
    if ids.where("n > 1").limit(1).count():
        several = ids.where("n > 1").select("__id")
        once = kept.join(several, kept["doc_id"] == several["__id"], "left_semi")
        first = Window.partitionBy("doc_id").orderBy("text", *[c for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith("map")])
        once = once.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")
        kept = kept.join(several, kept["doc_id"] == several["__id"], "left_anti").union(once)
    return kept.union(docs.where("doc_id IS NULL"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(graph)
