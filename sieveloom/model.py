"""Relations: attributes with roles, and rows in dense or sparse form.

A dense relation is a DataFrame with a column per attribute. A sparse one is a
long table of stored entries; what is not stored is zero. Entries carry their
row's class and weight, so that no statistic has to join them back to the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOMINAL, NUMERIC, STRING = "nominal", "numeric", "string"
KINDS = (NOMINAL, NUMERIC, STRING)


@dataclass(frozen=True)
class Attribute:
    """A column: its name, kind, and, if nominal, its labels in order."""

    name: str
    kind: str
    labels: tuple[str, ...] = ()
    bounds: tuple[float, float] | None = None
    weight: float = 1.0

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unsupported attribute type {self.kind!r} of {self.name!r}")

    @property
    def is_nominal(self) -> bool:
        return self.kind == NOMINAL

    @property
    def is_numeric(self) -> bool:
        return self.kind == NUMERIC

    @property
    def is_string(self) -> bool:
        return self.kind == STRING

    @property
    def n_values(self) -> int:
        """Number of labels; 0 unless nominal."""
        return len(self.labels) if self.is_nominal else 0

    def index_of(self, value: Column) -> Column:
        """Position of a label; null for missing and undeclared ones. Of a label
        that is declared twice the last position counts."""
        at = {label: i for i, label in enumerate(self.labels)}
        pairs = [F.lit(x) for label, i in at.items() for x in (label, float(i))]
        return F.create_map(*pairs)[value.cast("string")] if pairs else F.lit(None).cast("double")


@dataclass(frozen=True)
class Relation:
    """A dense relation: ``frame`` has ``row_id`` and a column for each attribute."""

    name: str
    attributes: tuple[Attribute, ...]
    frame: DataFrame
    class_name: str | None = None
    row_id: str = "row_id"
    weight: str | None = None

    def __post_init__(self):
        names = [a.name for a in self.attributes]
        if len(set(names)) < len(names):
            raise ValueError(f"attribute names repeat: {names}")
        if self.class_name is not None and self.class_name not in names:
            raise ValueError(f"no attribute {self.class_name!r}")

    @property
    def class_index(self) -> int:
        return -1 if self.class_name is None else self.index(self.class_name)

    def index(self, name: str) -> int:
        return [a.name for a in self.attributes].index(name)

    def attribute(self, at: int | str) -> Attribute:
        return self.attributes[at if isinstance(at, int) else self.index(at)]

    def with_frame(self, frame: DataFrame) -> Relation:
        return replace(self, frame=frame)

    def class_value(self) -> Column:
        """The class label's position as int; null if missing."""
        if self.class_name is None:
            return F.lit(None).cast("int")
        a = self.attribute(self.class_name)
        if not a.is_nominal:
            raise ValueError("the class attribute must be nominal")
        return a.index_of(F.col(f"`{a.name}`")).cast("int")

    def row_weight(self) -> Column:
        return F.lit(1.0) if self.weight is None else F.col(f"`{self.weight}`").cast("double")

    def rows(self) -> DataFrame:
        """``row_id, cls, weight`` of every row."""
        return self.frame.select(F.col(f"`{self.row_id}`").alias("row_id"), self.class_value().alias("cls"), self.row_weight().alias("weight"))

    def scalar_entries(self, start: int = 0) -> DataFrame:
        """The entries of all attributes but strings, renumbered from ``start`` in
        their order: stored values are the non-zero and the missing ones."""
        scalars = [a for a in self.attributes if not a.is_string]
        cells = [
            F.struct(F.lit(i + start).alias("attr_idx"), (a.index_of(F.col(f"`{a.name}`")) if a.is_nominal else F.col(f"`{a.name}`").cast("double")).alias("value"))
            for i, a in enumerate(scalars)
        ]
        base = self.frame.select(F.col(f"`{self.row_id}`").alias("row_id"), self.class_value().alias("cls"), self.row_weight().alias("weight"), F.explode(F.array(*cells)).alias("e"))
        return base.select("row_id", "cls", "weight", "e.attr_idx", "e.value").where("value IS NULL OR value <> 0")

    def sparse(self) -> Sparse:
        """The same relation in sparse form; string attributes are left out."""
        scalars = tuple(a for a in self.attributes if not a.is_string)
        at = [a.name for a in scalars].index(self.class_name) if self.class_name else -1
        return Sparse(self.name, scalars, self.rows(), self.scalar_entries(), at)


#: Rows of a table of attributes, a name and a few numbers each, that are broadcast at most.
BROADCAST_ATTRIBUTES = 100_000


def broadcast_if_few(attributes: DataFrame) -> DataFrame:
    """Mark a table with a row for each attribute for broadcast, if it is small
    enough; entries then need not be shuffled by attribute, where common words are
    large groups."""
    few = attributes.limit(BROADCAST_ATTRIBUTES + 1).count() <= BROADCAST_ATTRIBUTES
    return F.broadcast(attributes) if few else attributes


@dataclass(frozen=True)
class Sparse:
    """A sparse relation.

    ``rows``: ``row_id, cls, weight``. ``entries``: ``row_id, cls, weight,
    attr_idx, value``, a null value being a missing one. ``words``, if any:
    ``attr_idx, word`` of numeric word attributes that follow ``attributes``;
    a vocabulary stays a table, however large it is.
    """

    name: str
    attributes: tuple[Attribute, ...]
    rows: DataFrame
    entries: DataFrame
    class_index: int = -1
    words: DataFrame | None = None

    def attribute_table(self) -> DataFrame:
        """``attr_idx, name, kind`` of all attributes."""
        spark = self.entries.sparkSession
        own = spark.createDataFrame([(i, a.name, a.kind) for i, a in enumerate(self.attributes)], "attr_idx int, name string, kind string")
        if self.words is None:
            return own
        return own.union(self.words.select("attr_idx", "word", F.lit(NUMERIC)))

    def lookup(self, attr_idx: int) -> DataFrame:
        """``row_id, value``: one attribute's value in every row, 0 if not stored."""
        stored = self.entries.where(F.col("attr_idx") == attr_idx).select("row_id", F.coalesce("value", F.lit(float("nan"))).alias("v"))
        value = F.coalesce("v", F.lit(0.0))
        return self.rows.join(stored, "row_id", "left").select("row_id", F.when(~F.isnan(value), value).alias("value"))

    def dense(self, ids: list[int]) -> DataFrame:
        """``row_id`` and a column ``a<i>`` for each of the attributes ``ids``."""
        wanted = self.entries.where(F.col("attr_idx").isin(ids))
        columns = [F.max(F.when(F.col("attr_idx") == i, F.coalesce("value", F.lit(float("nan"))))).alias(f"a{i}") for i in ids]
        got = self.rows.select("row_id").join(wanted.groupBy("row_id").agg(*columns), "row_id", "left")
        full = lambda c: F.when(~F.isnan(F.coalesce(c, F.lit(0.0))), F.coalesce(c, F.lit(0.0)))
        return got.select("row_id", *[full(F.col(f"a{i}")).alias(f"a{i}") for i in ids])

    def displayed(self) -> DataFrame:
        """Entries with ``shown``: the label of a nominal value, else the attribute's name."""
        labels = [(i, float(j), label) for i, a in enumerate(self.attributes) if a.is_nominal for j, label in enumerate(a.labels)]
        names = broadcast_if_few(self.attribute_table().select("attr_idx", "name"))
        spark = self.entries.sparkSession
        table = spark.createDataFrame(labels or [(-1, 0.0, "")], "attr_idx int, value double, label string")
        out = self.entries.join(F.broadcast(table), ["attr_idx", "value"], "left").join(names, "attr_idx")
        return out.select("row_id", "attr_idx", "value", F.coalesce("label", "name").alias("shown"))
