"""Vectorizing and counting on streams.

Vocabulary, document frequencies and class histograms need all rows, so models
are fitted in batch; a fitted model turns a stream of new rows into vectors, as
the vocabulary is a static side of a stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.functions.text import tokens
from sieveloom.model import Relation
from sieveloom.operators.vectorize import VectorModel
from sieveloom.sources.scratch import scratch_path


def vectorize_stream(model: VectorModel, data: Relation) -> DataFrame:
    """``row_id, attr_idx, value`` of a streaming relation's rows, as they come.
    Values that need one row's words together (counts, normalisation) are made
    within the row's own batch: use ``foreachBatch`` with ``model.transform``."""
    p = model.params
    if p.output_counts or p.normalize:
        raise ValueError("counts and normalisation need foreachBatch with model.transform")
    fixed = model.stored(scratch_path(data.frame.sparkSession, "model"))
    return fixed.word_entries(data).select("row_id", "attr_idx", "value")


def windowed_word_counts(stream: DataFrame, time: str, text: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """``window, word, n``: words by event-time window; rows later than ``late`` go."""
    words = stream.withWatermark(time, late).select(F.col(time), F.explode(tokens(F.col(text))).alias("word"))
    return words.groupBy(F.window(time, window).alias("window"), "word").agg(F.count(F.lit(1)).alias("n"))
