"""Text functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelled out so that engines agree on it.
SPACE = r"[\t-\r\x{85}\p{Z}]+"


def tokens(*texts: Column) -> Column:
    """The words of all texts in order: split at white space, nothing else."""
    parts = [F.split(F.coalesce(t, F.lit("")), SPACE) for t in texts]
    return F.filter(reduce(lambda a, b: F.concat(a, b), parts), lambda w: w != "")
