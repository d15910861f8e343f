"""Top-k search and embedding near-dedup: against brute force and in corner cases."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sieveloom.llm import embed_dedup, topk
from tests.llm.helpers import rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in vectors], SCHEMA)


def clusters(n=600, dim=16, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    out = centres[r.integers(0, 12, n)] + r.normal(scale=0.25, size=(n, dim)) * r.choice([0.2, 1, 4], (n, 1))
    out *= r.choice([0.5, 1, 3], (n, 1))
    out[50] = out[51] = out[52]
    return np.float32(out)


def brute_top(vectors, asked, k=5):
    q = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in q:
        if asked(a):
            best = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=True)), b) for b in q if b != a and len(q[a]) == len(q[b]))[:k]
            out += [(a, n, b, -s) for n, (s, b) in enumerate(best, 1)]
    return sorted(out, key=repr)


def test_top_k_equals_brute_force(spark, monkeypatch):
    vectors = [(i, v.tolist()) for i, v in enumerate(clusters())] + [(900, [1.0] * 8), (950, [2.0] * 8), (1000, None), (1050, [float("nan")] * 16), (1100, [None] + [1.0] * 15), (1150, [float("inf")] * 16)]
    monkeypatch.setattr(topk, "SEED_ROWS", 64)
    got = topk.top_k(table(spark, vectors), F.col("vec_id") % 50 == 0, query_block=5)
    assert rows(got) == brute_top(vectors, lambda i: i % 50 == 0)


def test_top_k_prunes_and_stays_exact():
    rng = np.random.default_rng(3)
    m = np.floor(rng.normal(size=(3000, 12)) * rng.choice([20, 200], (3000, 1)))
    order = np.argsort(-(m**2).sum(1))
    best = topk.Best(np.arange(5), m[:5], 4)
    for at in range(0, 3000, 250):
        best.bucket(order[at : at + 250], m[order[at : at + 250]])
    for i in range(5):
        want = sorted((-int(m[i] @ m[j]), j) for j in range(3000) if j != i)[:4]
        assert [(-s, j) for s, j in zip(best.scores[i].tolist(), best.found[i].tolist(), strict=True)] == want


def test_top_k_corner_cases(spark):
    assert topk.top_k(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    ties = [(0, [1, 0]), (3, [1, 0]), (2, [1, 0]), (7, [-1, 0]), (8, [0, 0]), (50, [0, 0])]
    extra = table(spark, ties).withColumn("score", F.lit("clash")).withColumn("rank", F.lit("x"))
    assert rows(topk.top_k(extra, F.col("vec_id") % 50 == 0)) == brute_top(ties, lambda i: i % 50 == 0)
    huge = [(0, [1e30, 1]), (1, [1e30, 2]), (2, [-1e30, 0])]
    assert [r.vec_id for r in topk.top_k(table(spark, huge), F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]
    big = [(0, [1e7, 3.0]), (1, [1e7, 5.0]), (2, [1e7, 4.0])]  # products beyond 2**53
    assert rows(topk.top_k(table(spark, big), F.col("vec_id") == 0)) == brute_top(big, lambda i: i == 0)


def brute_links(vectors, threshold=0.95):
    ok = {i: np.float64(np.float32(v)) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _ in vectors}
    ids = sorted(ok)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / math.sqrt(ok[a] @ ok[a]) / math.sqrt(ok[b] @ ok[b]) >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = []
    for a in links:
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out.append((a, len(links[a]), min(seen), min(seen) == a))
    return sorted(out, key=repr)


def test_embedding_links_equal_brute_force(spark):
    vectors = [(i, v.tolist()) for i, v in enumerate(clusters(400))] + [(900, [1.0] * 8), (901, [2.0] * 8), (902, None), (903, [float("nan")] * 16), (904, [0.0] * 16), (905, [None] * 16), (906, [1e-38] * 8), (907, [3e38] * 8)]
    want = brute_links(vectors)
    assert sum(n for _, n, _, _ in want) > 200
    for tile in (2048, 48):  # one tile, and many leaves and tiles
        assert rows(embed_dedup.near_duplicates(table(spark, vectors), tile_rows=tile)) == want


def test_embedding_hot_groups(spark):
    r = random.Random(2)
    base = [r.gauss(0, 1) for _ in range(12)]
    vectors = [(i, base) for i in range(150)] + [(200 + i, [x + r.gauss(0, 0.02) for x in base]) for i in range(150)] + [(500 + i, [r.gauss(0, 1) for _ in range(12)]) for i in range(100)]
    assert rows(embed_dedup.near_duplicates(table(spark, vectors), tile_rows=32)) == brute_links(vectors)


def test_embedding_corner_cases(spark):
    assert embed_dedup.near_duplicates(table(spark, [])).count() == 0
    assert rows(embed_dedup.near_duplicates(table(spark, [(4, None), (5, [0, 0])]))) == [(4, 0, 4, True), (5, 0, 5, True)]
    twice = table(spark, [(1, [1, 0]), (1, [1, 0]), (2, [0, 1]), (None, [1, 0])]).withColumn("v", F.lit("clash")).withColumn("cls", F.lit(1))
    assert rows(embed_dedup.near_duplicates(twice)) == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, False)], key=repr)


def test_compare_is_exact_at_every_dimension():
    for dim in (2, 8, 9, 40, 64):
        m = embed_dedup.unit(np.random.default_rng(zlib.crc32(bytes([dim]))).normal(size=(300, dim)) + 2)
        turned = m @ embed_dedup.Layout(m, 4).rotation
        got = {(int(a), int(b)) for u, v in embed_dedup.compare(turned, turned, m, m, 0.9, True) for a, b in zip(u, v, strict=True)}
        c = m @ m.T
        assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if c[i, j] >= 0.9}


def most_dealt(spark, run):
    """The result of ``run()`` and the most rows that one of its stages shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (got.apply(i) for got in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)] for i in range(got.size()))}
    before = stages()
    out = run()
    return out, max(n for k, n in stages().items() if k not in before)


def test_embedding_pairs_are_dealt_in_waves(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "WAVE_BYTES", 0, raising=False)
    monkeypatch.setattr(embed_dedup, "FOUND_TABLES", 3, raising=False)
    vectors = [(i, v.tolist()) for i, v in enumerate(clusters(300))]
    found, most = most_dealt(spark, lambda: rows(embed_dedup.near_duplicates(table(spark, vectors), tile_rows=48)))
    assert found == brute_links(vectors)
    assert most <= 600  # a wave deals as many rows as there are; all pairs at once are 2,384


def test_embedding_waves_hold_each_near_pair_once():
    r = np.random.default_rng(5)
    for t in (1, 2, 3, 8, 9):
        leaf, sizes = np.sort(r.integers(0, 4, t)), r.integers(1, 90, t)
        near = np.eye(4, dtype=bool) | (lambda m: m | m.T)(r.random((4, 4)) < 0.4)
        made = list(embed_dedup.waves(leaf, sizes, near, 200))
        assert all(len(w) == 1 or sum(sizes[x] + (sizes[y] if x != y else 0) for x, y in w) <= 200 for w in made)
        pairs = sorted(tuple(sorted(p)) for w in made for p in w)
        assert pairs == [(x, y) for x in range(t) for y in range(x, t) if near[leaf[x], leaf[y]]]


def test_embedding_classes_with_one_key(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "vector_key", lambda v: F.size(v).cast("long"), raising=False)
    vectors = [(i, v.tolist()) for i, v in enumerate(clusters(120))] + [(900, [1.0] * 8), (901, [1.0] * 8)]
    assert rows(embed_dedup.near_duplicates(table(spark, vectors), tile_rows=64)) == brute_links(vectors)


def test_compare_dense_rows():
    r = np.random.default_rng(6)
    m = embed_dedup.unit(np.concatenate([np.ones((700, 24)) + r.normal(scale=0.23, size=(700, 24)), r.normal(size=(100, 24))]))
    turned = m @ embed_dedup.Layout(m, 4).rotation
    got = {(int(a), int(b)) for u, v in embed_dedup.compare(turned[:500], turned[500:], m[:500], m[500:]) for a, b in zip(u, v, strict=True)}
    c = m[:500] @ m[500:].T
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(c >= 0.95), strict=True)}
    assert 0.1 * c.size < len(got) < 0.9 * c.size
