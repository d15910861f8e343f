"""Ranking attributes by merit, and choosing among them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_range(text: str | None) -> list[int]:
    """Positions (from 0) of a list such as ``"1,3-5"``, which counts from 1."""
    out: set[int] = set()
    for part in (text or "").replace(" ", "").split(","):
        if not part:
            continue
        low, dash, high = part.partition("-")
        try:
            a, b = int(low), int(high) if dash else int(low)
        except ValueError:
            raise ValueError(f"bad range {part!r}") from None
        if a < 1 or b < a:
            raise ValueError(f"bad range {part!r}")
        out.update(range(a - 1, b))
    return sorted(out)


@dataclass(frozen=True)
class Ranker:
    """``num_to_select`` > 0 wins over ``threshold`` (strict); neither: all."""

    threshold: float | None = None
    num_to_select: int = -1
    exclude: str | None = None

    def excluded(self, n_attributes: int | None = None) -> list[int]:
        ids = parse_range(self.exclude)
        if n_attributes is not None and ids and ids[-1] >= n_attributes:
            raise ValueError(f"range {self.exclude!r} goes beyond {n_attributes} attributes")
        return ids

    def candidates(self, gains: DataFrame) -> DataFrame:
        """Gains of the attributes that are not excluded and have one."""
        gains = gains.where(F.col("gain").isNotNull())
        ids = self.excluded()
        return gains.where(~F.col("attr_idx").isin(ids)) if ids else gains

    def rank(self, gains: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """``by, attr_idx, merit, rank`` (from 1): best first, ties by attribute."""
        order = Window.partitionBy(*by).orderBy(F.desc("gain"), "attr_idx")
        return self.candidates(gains).select(*by, "attr_idx", F.col("gain").alias("merit"), F.row_number().over(order).cast("long").alias("rank"))

    def select(self, gains: DataFrame) -> DataFrame:
        """The ranked attributes that are kept."""
        if self.num_to_select > 0:
            best = self.candidates(gains).orderBy(F.desc("gain"), "attr_idx").limit(self.num_to_select)
            return Ranker().rank(best)
        ranked = self.rank(gains)
        return ranked if self.threshold is None else ranked.where(F.col("merit") > self.threshold)
