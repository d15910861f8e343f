"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are dealt by descending length, so each task works through buckets
of similar length, the longest first. For a query with k-th best score t, a
bucket whose lengths reach at most L can only hold an answer whose cosine is at
least t / (L |q|): above 1 the bucket is passed over, as are all after it; a low
value prunes by length alone; a high one prunes by the query's leading
coordinate first. What is left is verified by exact integer products.

Queries go in blocks of bounded size, each broadcast to one pass over the
candidates, so memory does not grow with the number of queries.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveloom.llm.common import materialize

SCALE = 256
K = 5
QUERY_BLOCK = 32768
BUCKET_ROWS = 2048
#: Queries whose products with a bucket are held at once.
QUERY_ROWS = 1024
#: Longest candidates that give every query its first k-th best score.
SEED_ROWS = 2048
#: Rows that a task of candidates should have.
TASK_ROWS = 16384
#: Local cosine from which a bucket is pruned by coordinates.
BY_COORDINATE = 0.5
EXACT = 2.0**53


def quantized(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, q`` with q = floor(scale * x) of each component as double. Rows
    with a null id or vector, or a null or non-finite component, are left out."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("q")
    )


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(rows, matrix)`` for each dimension found in a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = []
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        out.append((rows, flat[starts[rows][:, None] + np.arange(d)] if d else np.zeros((len(rows), 0))))
    return out


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as longs. In doubles where every partial sum is below
    2**53; in Python integers, cut off at the range of a long, beyond."""
    reach = np.sqrt((queries**2).sum(1).max(initial=0)) * np.sqrt((rows**2).sum(1).max(initial=0))
    if reach < EXACT:
        return np.rint(queries @ rows.T).astype(np.int64)
    big = np.array([[int(x) for x in r] for r in queries], object) @ np.array([[int(x) for x in r] for r in rows], object).T
    lim = np.iinfo(np.int64)
    return np.array([[min(max(int(x), lim.min + 1), lim.max) for x in r] for r in big], np.int64).reshape(len(queries), len(rows))


class Best:
    """The k best (score, id) of every query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norms = np.sqrt((vectors**2).sum(1))
        self.lead = np.argmax(np.abs(vectors), axis=1) if vectors.shape[1] else np.zeros(len(ids), np.int64)
        self.scores = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = self.scores[:, -1].copy()

    def add(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: of the queries ``who`` with the rows ``ids``; those under the floor can be any."""
        low = np.iinfo(np.int64).min
        mine = self.ids[who][:, None] == ids[None, :]
        scores = np.where(mine | (scores < self.floor[who][:, None]), low, scores)
        hit = np.flatnonzero((scores > low).any(axis=1))
        for i in hit:
            w = who[i]
            good = np.flatnonzero(scores[i] > low)
            s, v = np.concatenate((self.scores[w], scores[i, good])), np.concatenate((self.found[w], ids[good]))
            order = np.lexsort((v, ~s))[: self.k]  # ~s falls as s rises
            self.scores[w], self.found[w] = s[order], v[order]
        self.floor[who] = np.maximum(self.floor[who], self.scores[who, -1])

    def bucket(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """One bucket of candidates of like length, for some queries at a time."""
        for at in range(0, len(self.ids), QUERY_ROWS):
            self._bucket(ids, rows, slice(at, at + QUERY_ROWS))

    def _bucket(self, ids: np.ndarray, rows: np.ndarray, part: slice) -> None:
        norms = np.sqrt((rows**2).sum(1))
        longest = norms.max(initial=0)
        # the floor is compared with room for the rounding of lengths
        who = part.start + np.flatnonzero(self.floor[part] <= self.norms[part] * longest * (1 + 1e-9) + 1)
        if not len(who):
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            top = self.norms[who] * longest
            cosine = np.where(top > 0, self.floor[who] / top, -1.0)
        by_coordinate = cosine >= BY_COORDINATE
        plain = who[~by_coordinate]
        if len(plain):
            self.add(plain, ids, products(self.vectors[plain], rows))
        who = who[by_coordinate]
        lead = self.lead[who]
        for c in np.unique(lead):
            some = who[lead == c]
            # with unit vectors, q.v <= q_c v_c + sqrt(1 - q_c^2) sqrt(1 - v_c^2) must reach the local cosine
            qc = self.vectors[some, c] / self.norms[some]
            vc = rows[:, c] / np.where(norms > 0, norms, 1)
            reach = qc[:, None] * vc[None, :] + np.sqrt(np.maximum(0, 1 - qc**2))[:, None] * np.sqrt(np.maximum(0, 1 - vc**2))[None, :]
            need = (self.floor[some] / (self.norms[some] * longest))[:, None]
            live = np.flatnonzero((reach >= need * (1 - 1e-9) - 1e-12).any(axis=0))
            if len(live):
                self.add(some, ids[live], products(self.vectors[some], rows[live]))


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` rows with the highest integer inner product for each query row.

    ``is_query``: a condition on ``vec_id``. Returns ``query_id, rank, vec_id,
    score``; ties go to the smaller vec_id, rows with the query's own id are no candidates.
    Defined results: null ids, null vectors and vectors with null or non-finite
    components take no part; vectors of different dimension do not meet; a
    query with fewer than k candidates has them all; repeated candidate rows
    count each by itself, a repeated query row is answered once for its first
    vector in order; scores beyond a long are cut off at its range; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    base = quantized(vectors, id_col, vec_col, scale)
    base = materialize(base.withColumn("len2", F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)), "topk-vectors")
    rows = base.count()
    tasks = max(1, -(-rows // TASK_ROWS))
    dealt = materialize(base.repartitionByRange(tasks, F.desc("len2"), F.xxhash64("vec_id")).sortWithinPartitions(F.desc("len2"), "vec_id"), "topk-dealt")
    asked = materialize(base.where(is_query).groupBy("vec_id").agg(F.min("q").alias("q")), "topk-queries")
    n_blocks = max(1, -(-asked.count() // query_block))
    longest = dealt.orderBy(F.desc("len2"), "vec_id").limit(SEED_ROWS).select("vec_id", "q").toArrow()  # at most SEED_ROWS rows
    seeds = [(longest.column(0).to_numpy()[rows], m) for rows, m in _matrix(longest.column(1).combine_chunks())] if longest.num_rows else []

    def block_pass(part: DataFrame) -> DataFrame:
        got = part.toArrow()  # at most query_block rows by the even split of hashes below
        blocks = []
        for rows_, m in _matrix(got.column(1).combine_chunks()) if got.num_rows else []:
            best = Best(got.column(0).to_numpy()[rows_], m, k)
            for ids, s in seeds:
                if s.shape[1] == m.shape[1]:
                    for at in range(0, len(ids), BUCKET_ROWS):
                        best.bucket(ids[at : at + BUCKET_ROWS], s[at : at + BUCKET_ROWS])
            blocks.append((best.ids, m, best.floor))
        sent = spark.sparkContext.broadcast(blocks)

        def run(batches):
            mine = {}
            for ids, m, floor in sent.value:
                mine[m.shape[1]] = best = Best(ids, m, k)
                best.floor = floor.copy()
            for batch in batches:
                for where, m in _matrix(batch.column(1)):
                    d = m.shape[1]
                    if d not in mine:
                        continue
                    ids = batch.column(0).to_numpy()[where]
                    for at in range(0, len(ids), BUCKET_ROWS):
                        mine[d].bucket(ids[at : at + BUCKET_ROWS], m[at : at + BUCKET_ROWS])
            for best in mine.values():
                at, place = np.nonzero(best.found < np.iinfo(np.int64).max)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(best.ids[at]), pa.array(best.found[at, place]), pa.array(best.scores[at, place])], names=["query_id", "vec_id", "score"])

        return dealt.select("vec_id", "q").mapInArrow(run, "query_id long, vec_id long, score long")

    out = None
    for b in range(n_blocks):
        found = block_pass(asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b))
        out = found if out is None else out.union(found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
