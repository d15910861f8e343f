"""Information gain of attributes about the class, from contingency tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.functions.numeric import DIGITS, EPSILON, LN2, xlogx
from sieveloom.model import NOMINAL, Sparse
from sieveloom.operators.binarize import binarize


def class_histogram(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, cls, total``: weight of each class; the missing class is null."""
    return rows.groupBy(*by, "cls").agg(F.sum("weight").alias("total"))


def contingency(entries: DataFrame, rows: DataFrame, attributes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, attr_idx, value_idx, cls, weight``, a row for each cell, for every attribute in ``attributes``.

    What is not stored has value 0, so value 0 gets each class's total less what
    is stored: the work follows the stored entries, not rows times attributes.
    ``entries`` must hold no other attributes than those.
    Null value_idx and cls stand for missing.
    """
    keys = [*by, "attr_idx"]
    stored = entries.where("value IS NULL OR value <> 0").groupBy(*keys, F.col("value").cast("int").alias("value_idx"), "cls").agg(F.sum("weight").alias("weight"))
    # both read the same exchange of partial sums
    taken = stored.groupBy(*keys, "cls").agg(F.sum("weight").alias("taken"))
    hist = class_histogram(rows, by)
    grid = attributes.select("attr_idx").crossJoin(F.broadcast(hist))  # attributes times classes (and folds): a cell each, as in the result
    same = [grid[k].eqNullSafe(taken[k]) for k in [*keys, "cls"]]
    zero = grid.join(taken, same, "left").select(*[grid[k] for k in keys], F.lit(0).alias("value_idx"), grid["cls"], (grid["total"] - F.coalesce(taken["taken"], F.lit(0.0))).alias("weight"))
    return stored.select(*keys, "value_idx", "cls", "weight").union(zero).where("weight <> 0")


def merge_missing(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Spread the weight of missing values and classes over the observed cells in
    proportion: ``n + R/S m + C/S u + n/S b``; nothing is done where S is 0."""
    keys = [*by, "attr_idx"]
    known_v, known_c = F.col("value_idx").isNotNull(), F.col("cls").isNotNull()
    parts = lambda cond: F.sum(F.when(cond, F.col("weight")).otherwise(0.0))
    per_value = cells.where(known_v).groupBy(*keys, "value_idx").agg(parts(known_c).alias("r"), parts(~known_c).alias("u"))
    per_class = cells.where(known_c).groupBy(*keys, "cls").agg(parts(known_v).alias("c"), parts(~known_v).alias("m"))
    whole = cells.groupBy(*keys).agg(parts(known_v & known_c).alias("s"), parts(~known_v & ~known_c).alias("b"))
    grid = per_value.join(per_class, keys).join(whole, keys)
    n = cells.where(known_v & known_c).select(*keys, "value_idx", "cls", F.col("weight").alias("n"))
    full = grid.join(n, [*keys, "value_idx", "cls"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    spread = F.col("n") + F.col("r") / F.col("s") * F.col("m") + F.col("c") / F.col("s") * F.col("u") + F.col("n") / F.col("s") * F.col("b")
    return full.select(*keys, "value_idx", "cls", F.when(F.col("s") > EPSILON, spread).otherwise(F.col("n")).alias("weight"))


def separate_missing(cells: DataFrame) -> DataFrame:
    """Missing as a value and a class of its own (-1)."""
    return cells.withColumn("value_idx", F.coalesce("value_idx", F.lit(-1))).withColumn("cls", F.coalesce("cls", F.lit(-1)))


def entropies(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, attr_idx, h_class, h_conditional, gain`` in bits.

    One aggregation over four grouping sets (cells, values, classes, all); 0
    where an attribute has no weight.
    """
    keys = [*by, "attr_idx"]
    sets = [[*keys, "value_idx", "cls"], [*keys, "value_idx"], [*keys, "cls"], keys]
    sums = cells.groupingSets(sets, *keys, "value_idx", "cls").agg(F.sum("weight").alias("w"), F.grouping("value_idx").alias("gv"), F.grouping("cls").alias("gc"))
    f = xlogx(F.col("w"))
    pick = lambda gv, gc: F.sum(F.when((F.col("gv") == gv) & (F.col("gc") == gc), f).otherwise(0.0))
    total = F.sum(F.when((F.col("gv") == 1) & (F.col("gc") == 1), F.col("w")).otherwise(0.0))
    flat = sums.groupBy(*keys).agg(pick(0, 0).alias("cell"), pick(0, 1).alias("value"), pick(1, 0).alias("class"), pick(1, 1).alias("all"), total.alias("t"))
    scale = lambda x: F.when(F.abs(F.col("t")) < EPSILON, F.lit(0.0)).otherwise(x / (F.col("t") * LN2))
    h, hc = scale(F.col("all") - F.col("class")), scale(F.col("value") - F.col("cell"))
    return flat.select(*keys, h.alias("h_class"), hc.alias("h_conditional"), (h - hc).alias("gain"))


def info_gain(data: Sparse, missing_merge: bool = True, binarize_numeric: bool = True, by: tuple[str, ...] = (), rows: DataFrame | None = None, entries: DataFrame | None = None, regroup: Callable[[DataFrame], DataFrame] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """``by, attr_idx, gain``, rounded to 9 digits, of every attribute but the class.

    Numeric attributes are binarized first; without that their gain is 0, as
    they are not discretized. ``rows`` and ``entries`` can be given with the columns
    ``by``; ``regroup`` turns their cells into those of the final ``by``, of which
    ``groups`` then has the values.
    """
    if data.class_index < 0:
        raise ValueError("information gain needs a class attribute")
    own = data if entries is None else replace(data, entries=entries)
    table = data.attribute_table().where(F.col("attr_idx") != data.class_index)
    scored = table if binarize_numeric else table.where(F.col("kind") == NOMINAL)
    own = (binarize(own) if binarize_numeric else own).entries.where(F.col("attr_idx") != data.class_index)
    if not binarize_numeric:
        own = own.where(F.col("attr_idx").isin([i for i, a in enumerate(data.attributes) if a.is_nominal]))
    base_rows = data.rows if rows is None else rows
    # as many cells as attributes times values times classes, read by every step below
    cells = contingency(own, base_rows, scored, by)
    if regroup is not None:
        cells, by = regroup(cells), tuple(groups.columns)
    cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
    if not missing_merge:
        cells = separate_missing(cells)
    elif cells.where("value_idx IS NULL OR cls IS NULL").limit(1).count():  # else there is nothing to spread
        cells = merge_missing(cells, by)
    gains = entropies(cells, by)
    ids = table.select("attr_idx")
    if by:
        ids = ids.crossJoin(F.broadcast(base_rows.select(*by).distinct() if groups is None else groups))
    out = ids.join(gains, [*by, "attr_idx"], "left")
    return out.select(*by, "attr_idx", F.round(F.coalesce("gain", F.lit(0.0)), DIGITS).alias("gain"))
