"""Toxicity: classifier chains of linear models on word features.

The chain predicts its categories in order; each later model also reads the
earlier categories' probabilities, and is trained on out-of-fold predictions of
them, so that it sees in training what it will see in use. The models are
fitted on a bounded sample of labelled rows; every document is scored whole.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.llm import graph
from sieveloom.llm.graph import slices

#: Categories in chain order; the last one decides.
CHAIN = ("low_quality", "toxic")
#: Labelled rows that the models are fitted on, at most: those of smallest seeded hash.
TRAIN_ROWS = 6000
#: Features of a model, at most: those whose presence tells most about the category.
FEATURES = 300
MIN_DOCS = 5
FOLDS = 3
THRESHOLD = 0.5
SEED = 11
PREFIXES = (4, 5, 6)
#: Punctuation that is cut from both ends of a word.
MARKS = ".,;:!?\"'()[]{}|*#%&$@<>-_/\\"


def word_features(word: str) -> list[str]:
    """A word's features: itself, and its first letters (compounds share them)."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def _words(text: str | None) -> set[str]:
    return {w.strip(MARKS) for w in (text or "").lower().split()}


class Seen:
    """Words that were looked at, and the features of those that have any."""

    def __init__(self, limit: int = 120_000):
        self.words: set[str] = set()
        self.features: dict[str, tuple[str, ...]] = {}
        self.limit = limit

    def telling(self, words: set[str], known) -> set[str]:
        if len(self.words) > self.limit:
            self.words, self.features = set(), {}
        new = words - self.words
        for w in new:
            bare = w.strip(MARKS)
            got = tuple(f for f in word_features(bare) if f in known) if bare else ()
            if got:
                self.features[w] = got
        self.words |= new
        return words & self.features.keys()


class Linear:
    """Logistic regression on 0/1 features and dense extras, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.05):
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
        pull[-1] = 1e-6
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - y) + pull * w
            h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x
            h[np.diag_indices_from(h)] += pull
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights, self.bias = w[:-1], w[-1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def _select(indptr, indices, n_features, y, limit):
    """The features whose presence gives the highest chi-square with ``y``."""
    rows = np.repeat(np.arange(len(y)), np.diff(indptr))
    n, pos = len(y), y.sum()
    df = np.bincount(indices, minlength=n_features).astype(float)
    hit = np.bincount(indices, weights=y[rows], minlength=n_features)
    expected = df * pos / max(n, 1)
    variance = expected * (1 - pos / max(n, 1)) * (1 - df / max(n, 1)) + 1e-12
    score = np.where(df >= MIN_DOCS, (np.abs(hit - expected) - 0.5).clip(0) ** 2 / variance, 0)
    best = np.lexsort((np.arange(n_features), -score))[:limit]
    return best[score[best] > 6.6]  # 1 % level of one degree of freedom


def _dense(indptr, indices, chosen, n_features):
    at = np.full(n_features, -1)
    at[chosen] = np.arange(len(chosen))
    rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    cols = at[indices]
    x = np.zeros((len(indptr) - 1, len(chosen)), np.float64)
    x[rows[cols >= 0], cols[cols >= 0]] = 1
    return x


class Chain:
    """Fitted models; ``weights[feature]`` has a weight for each category."""

    def __init__(self, texts: list[str | None], labels: np.ndarray, features: int = FEATURES, folds: int = FOLDS):
        number: dict[str, int] = {}
        indptr, indices = [0], []
        for text in texts:
            mine = {number.setdefault(f, len(number)) for w in _words(text) if w for f in word_features(w)}
            indices.extend(sorted(mine))
            indptr.append(len(indices))
        indptr, indices = np.array(indptr), np.array(indices, np.int64)
        n, k = labels.shape
        fold = np.arange(n) % folds
        earlier = np.zeros((n, 0))
        self.links: list[np.ndarray] = []
        self.bias: list[float] = []
        self.weights: dict[str, np.ndarray] = {}
        names = list(number)
        for c in range(k):
            y = labels[:, c].astype(float)

            def fit(rows, y=y, earlier=earlier):
                part = np.concatenate([indices[indptr[i] : indptr[i + 1]] for i in rows]) if len(rows) else indices[:0]
                ptr = np.concatenate(([0], np.cumsum(np.diff(indptr)[rows])))
                chosen = _select(ptr, part, len(names), y[rows], features)
                return chosen, Linear(np.hstack([_dense(ptr, part, chosen, len(names)), _logit(earlier[rows])]), y[rows])

            chosen, model = fit(np.arange(n))
            for f, w in zip(chosen, model.weights, strict=False):
                self.weights.setdefault(names[f], np.zeros(k))[c] = w
            self.links.append(model.weights[len(chosen) :])
            self.bias.append(float(model.bias))
            if c + 1 < k:
                out = np.zeros(n)
                for f in range(folds):
                    rows, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                    if not len(rows) or not len(held):
                        out[held] = y.mean() if n else 0.5
                        continue
                    picked, m = fit(rows)
                    part = np.concatenate([indices[indptr[i] : indptr[i + 1]] for i in held])
                    ptr = np.concatenate(([0], np.cumsum(np.diff(indptr)[held])))
                    out[held] = m(np.hstack([_dense(ptr, part, picked, len(names)), _logit(earlier[held])]))
                earlier = np.hstack([earlier, out[:, None]])

    def score(self, texts, seen: Seen | None = None) -> np.ndarray:
        """Probabilities, a row for each text and a column for each category."""
        k, known, seen = len(self.bias), self.weights, seen or Seen()
        out = np.zeros((len(texts), k))
        for i, text in enumerate(texts):
            words = set((text or "").lower().split())
            hits = {f for w in seen.telling(words, known) for f in seen.features[w]}
            if hits:
                out[i] = np.sum([known[f] for f in sorted(hits)], axis=0)
        p = np.zeros_like(out)
        for c in range(k):
            z = out[:, c] + self.bias[c] + _logit(p[:, :c]) @ self.links[c]
            p[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, features: int = FEATURES, seed: int = SEED) -> Chain:
    """Fit the chain on at most ``rows`` labelled documents: those with the
    smallest seeded hash of their id. Rows with a null id, label or text, and
    ids labelled twice with different values, are not trained on; an id that comes
    with several texts counts once, with the smallest of them; without labelled
    rows every probability is 0.5."""
    y = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("quality_1"), F.min("toxic").alias("toxic"), F.max("toxic").alias("toxic_1")
    ).where("quality = quality_1 AND toxic = toxic_1").select(F.col("doc_id").alias("__id"), (F.col("quality") == 0).cast("int").alias("low_quality"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    order = F.xxhash64(F.col("__id"), F.lit(seed))
    # labelled ids that exist, bounded before any text moves
    chosen = y.join(docs.select(F.col("doc_id").alias("__id")).distinct(), "__id", "left_semi").orderBy(order, "__id").limit(rows)
    d = docs.where("text IS NOT NULL").select("doc_id", "text")
    # a row for each id, however often the id comes
    got = d.join(F.broadcast(chosen), d["doc_id"] == chosen["__id"]).groupBy("doc_id", *CHAIN).agg(F.min("text").alias("text"))
    feats = got.mapInArrow(_featurize, "doc_id long, low_quality int, toxic int, words array<string>").toArrow().sort_by("doc_id")
    texts = [" ".join(x) for x in feats.column("words").to_pylist()]
    y = np.stack([feats.column(c).to_numpy() for c in CHAIN], axis=1) if len(texts) else np.zeros((0, len(CHAIN)))
    return Chain(texts, y, features)


def _featurize(batches):
    """Texts as their distinct words: what the models read, and no more."""
    for batch in slices(batches):
        words = [sorted(w for w in _words(x) if w) for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "low_quality", "toxic", "words"])


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, p_low_quality, p_toxic, toxic`` for every row of ``docs``.

    Defined results: a null or wordless text is scored by the models' intercepts
    and never toxic; null ids and repeated rows are carried; an empty table gives
    no rows. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # at most FEATURES features for each category

    def run(batches):
        seen = Seen()
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            p = np.round(sent.value.score(texts, seen), 6)
            toxic = (p[:, -1] >= threshold) & np.array([bool(x and x.strip()) for x in texts], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, c]) for c in range(p.shape[1])], pa.array(toxic)], names=["doc_id", "p_low_quality", "p_toxic", "toxic"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, p_low_quality double, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the chain finds toxic; all columns and all
    other rows stay. One pass, without a join: rows are judged where they are."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index("text")

    def run(batches):
        seen = Seen()
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            keep = [not (p >= threshold and x and x.strip()) for p, x in zip(np.round(sent.value.score(texts, seen)[:, -1], 6), texts, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(graph)
