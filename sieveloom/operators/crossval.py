"""Folds and cross-validated attribute statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.functions.numeric import shuffled_position
from sieveloom.model import Sparse
from sieveloom.operators.infogain import info_gain
from sieveloom.operators.rank import Ranker

#: Digits of sums over folds.
SUM_DIGITS = 6


def fold_sizes(n: int, folds: int) -> list[tuple[int, int]]:
    """``(start, size)`` of each test block of ``n`` rows."""
    if folds < 2 or folds > n:
        raise ValueError(f"{folds} folds of {n} rows")
    return [(f * (n // folds) + min(f, n % folds), n // folds + (f < n % folds)) for f in range(folds)]


def folds(rows: DataFrame, k: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """``rows`` with ``position`` in seeded order and ``test_fold``, the block that
    holds the row; blocks are contiguous and differ by one row at most."""
    n = rows.count()
    fold_sizes(n, k)
    base, more = divmod(n, k)
    at = F.col("position")
    # the first ``more`` blocks are one row longer
    long_rows = more * (base + 1)
    fold = F.when(at < long_rows, F.floor(at / (base + 1))).otherwise(more + F.floor((at - long_rows) / base)).cast("int")
    return shuffled_position(rows, row_id, seed).withColumn("test_fold", fold)


def train_split(rows: DataFrame, k: int, fold: int, seed: int, row_id: str = "row_id") -> DataFrame:
    return folds(rows, k, seed, row_id).where(F.col("test_fold") != fold)


def test_split(rows: DataFrame, k: int, fold: int, seed: int, row_id: str = "row_id") -> DataFrame:
    return folds(rows, k, seed, row_id).where(F.col("test_fold") == fold)


def cross_validate(data: Sparse, k: int, seed: int, ranker: Ranker | None = None, missing_merge: bool = True) -> DataFrame:
    """``attr_idx, n_folds, sum_merit, sum_rank, sum_merit_sq, sum_rank_sq``, and
    means and deviations, of the attributes ranked on each fold's training rows.

    One grouped query over all folds. The vocabulary is that of the full data, as
    vectors are made before folds are cut: the figures tell how stable the
    ranking is, not how well it generalises.
    """
    ranker = ranker or Ranker()
    dealt = folds(data.rows, k, seed).select("row_id", "cls", "weight", "test_fold")
    entries = data.entries.join(dealt.select("row_id", "test_fold"), "row_id")

    def training(cells: DataFrame) -> DataFrame:
        """Cells of each fold's training rows: those of all other test blocks."""
        others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("test_fold"))
        each = cells.select(F.explode(others).alias("fold"), "attr_idx", "value_idx", "cls", "weight")
        return each.groupBy("fold", "attr_idx", "value_idx", "cls").agg(F.sum("weight").alias("weight"))

    numbers = data.rows.sparkSession.range(k).select(F.col("id").cast("int").alias("fold"))
    gains = info_gain(data, missing_merge, by=("test_fold",), rows=dealt, entries=entries, regroup=training, groups=numbers)
    ranked = ranker.rank(gains, ("fold",))
    merit, rank = F.col("merit"), F.col("rank")
    out = ranked.groupBy("attr_idx").agg(
        F.count(F.lit(1)).alias("n_folds"), F.round(F.sum(merit), SUM_DIGITS).alias("sum_merit"), F.sum(rank).alias("sum_rank"),
        F.round(F.sum(merit * merit), SUM_DIGITS).alias("sum_merit_sq"), F.sum(rank * rank).alias("sum_rank_sq"),
    )
    n = F.col("n_folds")
    spread = lambda s, q: F.sqrt(F.greatest(F.lit(0.0), (F.col(q) - F.col(s) * F.col(s) / n) / F.greatest(n - 1, F.lit(1))))
    return out.select("*", (F.col("sum_rank") / n).alias("mean_rank"), (F.col("sum_merit") / n).alias("mean_merit"), spread("sum_rank", "sum_rank_sq").alias("sd_rank"), spread("sum_merit", "sum_merit_sq").alias("sd_merit"))
