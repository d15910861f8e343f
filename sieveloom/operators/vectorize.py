"""Text columns to sparse word vectors, with vocabularies for each class."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveloom.functions.text import tokens
from sieveloom.model import Relation, Sparse

#: Largest vocabulary, in words, that is broadcast.
BROADCAST_WORDS = 1_000_000


@dataclass(frozen=True)
class VectorParams:
    words_to_keep: int = 1000
    min_term_freq: int = 1
    per_class: bool = True
    output_counts: bool = False
    tf: bool = True
    idf: bool = True
    normalize: bool = True
    #: String attributes to convert; all by default.
    columns: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.words_to_keep <= 0:
            raise ValueError("words_to_keep must be positive")


def _texts(data: Relation, params: VectorParams) -> list[Column]:
    names = [a.name for a in data.attributes if a.is_string]
    chosen = names if params.columns is None else [n for n in names if n in params.columns]
    if not chosen:
        raise ValueError("no string attribute to convert")
    return [F.col(f"`{n}`") for n in chosen]


def _words(data: Relation, params: VectorParams) -> DataFrame:
    """``row_id, cls, weight, words``: every row with its words in an array."""
    return data.frame.select(F.col(f"`{data.row_id}`").alias("row_id"), data.class_value().alias("cls"), data.row_weight().alias("weight"), tokens(*_texts(data, params)).alias("words"))


def token_counts(data: Relation, params: VectorParams | None = None) -> DataFrame:
    """``row_id, cls, word, tf``: how often each row has each word."""
    words = _words(data, params or VectorParams())
    return words.select("row_id", "cls", F.explode("words").alias("word")).groupBy("row_id", "cls", "word").agg(F.count(F.lit(1)).alias("tf"))


def class_word_counts(data: Relation, params: VectorParams | None = None) -> DataFrame:
    """``cls, word, cnt, dc``: occurrences and rows of each word by class (all
    rows in class 0 if not ``per_class``).

    Rows are told apart in their own array, so only (class, word) sums are
    shuffled, not every row's words.
    """
    params = params or VectorParams()
    words = _words(data, params)
    if not params.per_class:
        words = words.withColumn("cls", F.lit(0))
    marks = F.concat(
        F.transform("words", lambda w: F.struct(w.alias("word"), F.lit(1).alias("cnt"), F.lit(0).alias("dc"))),
        F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("word"), F.lit(0).alias("cnt"), F.lit(1).alias("dc"))),
    )
    each = words.select("cls", F.explode(marks).alias("m")).select("cls", "m.*")
    return each.groupBy("cls", "word").agg(F.sum("cnt").alias("cnt"), F.sum("dc").alias("dc"))


def thresholds(counts: DataFrame, params: VectorParams) -> DataFrame:
    """``cls, prune``: the count from which a class keeps words: the count of its
    ``words_to_keep``-th most frequent word, at least ``min_term_freq``. Found
    from the histogram of counts, which is far smaller than the words."""
    hist = counts.where("cls IS NOT NULL").groupBy("cls", "cnt").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("cls").orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumn("above", F.sum("n").over(down))
    kth = F.max(F.when(F.col("above") >= params.words_to_keep, F.col("cnt")))
    return run.groupBy("cls").agg(F.greatest(F.coalesce(kth, F.lit(0)), F.lit(params.min_term_freq)).cast("long").alias("prune"))


def dictionary(counts: DataFrame, params: VectorParams, first_index: int) -> DataFrame:
    """``attr_idx, word, first_cls, df``: the words that some class keeps (ties at
    the threshold included), numbered by first such class, then by word; df
    counts the rows of all classes."""
    prune = thresholds(counts, params)
    first = F.min(F.when(F.col("cnt") >= F.col("prune"), F.col("cls")))
    kept = counts.join(F.broadcast(prune), "cls", "left").groupBy("word").agg(first.alias("first_cls"), F.sum("dc").alias("df")).where("first_cls IS NOT NULL")
    order = Window.orderBy("first_cls", "word")  # over kept words only
    return kept.select((F.row_number().over(order) - 1 + first_index).cast("int").alias("attr_idx"), "word", "first_cls", "df")


@dataclass(frozen=True)
class VectorModel:
    """A fitted vocabulary: it turns the rows it was fitted on, or new ones, into vectors."""

    params: VectorParams
    words: DataFrame
    n_rows: DataFrame
    average: DataFrame | None = None
    broadcast: bool = True

    def _values(self, data: Relation) -> DataFrame:
        p = self.params
        base = _words(data, p)
        words = F.broadcast(self.words) if self.broadcast else self.words
        if p.output_counts:
            each = base.select("row_id", "cls", "weight", F.explode("words").alias("word")).join(words, "word")
            each = each.groupBy("row_id", "cls", "weight", "attr_idx", "df").agg(F.count(F.lit(1)).cast("double").alias("value"))
        else:
            each = base.select("row_id", "cls", "weight", F.explode(F.array_distinct("words")).alias("word")).join(words, "word").withColumn("value", F.lit(1.0))
        value = F.col("value")
        if p.tf:
            value = F.ln(value + 1)
        if p.idf:
            each = each.crossJoin(F.broadcast(self.n_rows))  # one row
            value = value * F.ln(F.col("n_rows").cast("double") / F.col("df"))
        return each.select("row_id", "cls", "weight", "attr_idx", value.alias("value"))

    def word_entries(self, data: Relation) -> DataFrame:
        """Entries of the word attributes, normalised if the parameters ask for it."""
        each = self._values(data)
        if not self.params.normalize:
            return each
        # a row's values and their norm come from one grouping, so texts are cut once
        entry = F.struct("cls", "weight", "attr_idx", "value")
        rows = each.groupBy("row_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.collect_list(entry).alias("entries"))  # as many as a row has words
        out = rows.select("row_id", "norm", F.explode("entries").alias("e")).select("row_id", "norm", "e.*").crossJoin(F.broadcast(self.average))  # one row
        # a word that every row has is worth nothing: zero entries go
        return out.select("row_id", "cls", "weight", "attr_idx", (F.col("value") * F.col("avg_len") / F.nullif("norm", F.lit(0.0))).alias("value")).where("value IS NOT NULL AND value <> 0")

    def stored(self, path: str) -> VectorModel:
        """Write the model's tables below ``path`` and return a model that reads them."""
        spark = self.words.sparkSession
        tables = {"words": self.words, "n_rows": self.n_rows, "average": self.average}
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}")
        return replace(self, **{name: spark.read.parquet(f"{path}/{name}") for name in tables})

    def transform(self, data: Relation) -> Sparse:
        scalars = tuple(a for a in data.attributes if not a.is_string)
        at = [a.name for a in scalars].index(data.class_name) if data.class_name else -1
        entries = data.scalar_entries().union(self.word_entries(data))
        return Sparse(data.name, scalars, data.rows(), entries, at, self.words.select("attr_idx", "word"))


def average_length(values: DataFrame, rows: DataFrame) -> DataFrame:
    """``avg_len``: mean over all rows of the length of their word vector, 0 for
    rows without words."""
    norms = values.groupBy("row_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(norms.agg(F.sum("norm").alias("s"))).select((F.coalesce("s", F.lit(0.0)) / F.nullif("n", F.lit(0))).alias("avg_len"))


def fit(data: Relation, params: VectorParams | None = None) -> VectorModel:
    """Vocabulary, document frequencies, number of rows and average length.

    The vocabulary is counted here, to see whether it can be broadcast: ties at
    the threshold can make it larger than ``words_to_keep``."""
    params = params or VectorParams()
    if data.class_name is not None and data.attribute(data.class_name).is_string:
        raise ValueError("the class attribute must be nominal")
    per_class = params.per_class and data.class_name is not None
    params = replace(params, per_class=per_class)
    # read twice, for the thresholds and for the words: kept until the vocabulary is there
    counts = class_word_counts(data, params).persist(StorageLevel.MEMORY_AND_DISK)
    # the vocabulary is used by every later step: kept, and recomputed if an executor is lost
    words = dictionary(counts, params, len([a for a in data.attributes if not a.is_string])).persist(StorageLevel.MEMORY_AND_DISK)
    n_rows = data.frame.agg(F.count(F.lit(1)).alias("n_rows"))
    model = VectorModel(params, words, n_rows, None, _fits(words))
    counts.unpersist()
    return replace(model, average=average_length(model._values(data), data.rows()))


def _fits(words: DataFrame) -> bool:
    """Whether the vocabulary, ties included, is small enough to broadcast: a row
    holds a word of the texts and three numbers."""
    return words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
