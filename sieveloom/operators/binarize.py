"""Numeric attributes to present/absent."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sieveloom.model import NOMINAL, Attribute, Sparse


def binarize(data: Sparse) -> Sparse:
    """Every stored value of a numeric attribute becomes 1 (explicit zeros too),
    missing ones stay missing; nominal attributes and the class are unchanged.
    Numeric attributes become nominal ``{0, 1}`` and are renamed ``..._binarize``."""
    kept = [i for i, a in enumerate(data.attributes) if a.is_nominal or i == data.class_index]
    value = F.when(F.col("attr_idx").isin(kept) | F.col("value").isNull(), F.col("value")).otherwise(F.lit(1.0))
    attributes = tuple(a if i in kept else Attribute(f"{a.name}_binarize", NOMINAL, ("0", "1"), (0.0, 1.0)) for i, a in enumerate(data.attributes))
    words = None if data.words is None else data.words.select("attr_idx", F.concat("word", F.lit("_binarize")).alias("word"))
    return replace(data, attributes=attributes, entries=data.entries.withColumn("value", value), words=words)
