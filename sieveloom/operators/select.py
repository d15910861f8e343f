"""Attribute selection: evaluate, rank, keep, project."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveloom.model import Relation, Sparse, broadcast_if_few
from sieveloom.operators.infogain import info_gain
from sieveloom.operators.rank import Ranker


@dataclass(frozen=True)
class AttributeSelection:
    """Rank all attributes by information gain and project the rows to the best."""

    ranker: Ranker = field(default_factory=Ranker)
    missing_merge: bool = True
    binarize: bool = True

    def gains(self, data: Sparse) -> DataFrame:
        return info_gain(_with_class(data), self.missing_merge, self.binarize)

    def selected(self, data: Sparse) -> DataFrame:
        """``attr_idx, new_idx``: kept attributes in ranked order, the class last."""
        data = _with_class(data)
        n = self.ranker.num_to_select
        if n > 0:
            there = data.attribute_table().where(F.col("attr_idx") != data.class_index)
            ids = self.ranker.excluded()
            there = there.where(~F.col("attr_idx").isin(ids)) if ids else there
            if n > (have := there.count()):
                raise ValueError(f"{n} attributes asked for, {have} there")
        kept = self.ranker.select(self.gains(data)).select("attr_idx", (F.col("rank") - 1).cast("int").alias("new_idx"))
        last = kept.agg(F.coalesce(F.max("new_idx") + 1, F.lit(0)).cast("int").alias("new_idx"))
        return kept.union(last.select(F.lit(data.class_index).alias("attr_idx"), "new_idx"))

    def project(self, data: Sparse, selected: DataFrame | None = None) -> DataFrame:
        """``row_id, weight, new_idx, value``: the original values of the kept
        attributes, renumbered; zeros go, missing values stay."""
        chosen = self.selected(data) if selected is None else selected
        chosen = broadcast_if_few(chosen.persist(StorageLevel.MEMORY_AND_DISK))  # counted and joined: ranked once
        return data.entries.join(chosen, "attr_idx").where("value IS NULL OR value <> 0").select("row_id", "weight", "new_idx", "value")

    def schema(self, data: Sparse, selected: DataFrame | None = None) -> DataFrame:
        """``new_idx, name, kind`` of the output's attributes, the class last."""
        chosen = self.selected(data) if selected is None else selected
        return chosen.join(data.attribute_table(), "attr_idx").select("new_idx", "name", "kind")


def _with_class(data: Sparse) -> Sparse:
    """Without a class attribute, the last attribute is taken as the class; it
    must then be nominal, and rows take their class from its entries."""
    if data.class_index >= 0:
        return data
    at = len(data.attributes) - 1
    if data.words is not None or at < 0 or not data.attributes[at].is_nominal:
        raise ValueError("the class attribute must be nominal")
    stored = data.entries.where(F.col("attr_idx") == at).select("row_id", F.coalesce("value", F.lit(-1.0)).alias("__c"))
    value = F.coalesce("__c", F.lit(0.0)).cast("int")
    cls = F.when(value >= 0, value)
    rows = data.rows.drop("cls").join(stored, "row_id", "left").select("row_id", cls.alias("cls"), "weight")
    entries = data.entries.drop("cls").join(stored, "row_id", "left").select("row_id", cls.alias("cls"), "weight", "attr_idx", "value")
    return replace(data, rows=rows, entries=entries, class_index=at)


def remove(data: Relation, columns: list[int], keep: bool = True) -> Relation:
    """Keep exactly ``columns`` (positions) in the order listed, or drop them."""
    n = len(data.attributes)
    if any(not 0 <= c < n for c in columns):
        raise ValueError(f"columns {columns} go beyond {n} attributes")
    ids = list(dict.fromkeys(columns)) if keep else [i for i in range(n) if i not in set(columns)]
    chosen = tuple(data.attributes[i] for i in ids)
    names = [a.name for a in chosen]
    extra = [c for c in (data.row_id, data.weight) if c and c in data.frame.columns and c not in names]
    frame = data.frame.select(*[F.col(f"`{c}`") for c in [*extra, *names]])
    return Relation(data.name, chosen, frame, data.class_name if data.class_name in names else None, data.row_id, data.weight)


def top(df: DataFrame, by: str, n: int, ties: str) -> DataFrame:
    """The ``n`` largest of ``by`` with their rank."""
    best = df.orderBy(F.desc(by), ties).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), ties)).cast("long"))
