"""Shared pieces of the training-data operators: durable intermediate tables,
size-checked broadcasts and connected components."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: Largest table, in bytes of its rows, that is broadcast; beyond it the plain shuffle join runs.
BROADCAST_BYTES = 16 << 20
#: Removes a finished query's shuffle files, which else stay until the driver collects its garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary
    one serves on one machine (tests) and is recorded in the session; on a cluster
    other machines would not see it, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sieveloom.scratch", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="sieveloom-")
        spark.conf.set("spark.sieveloom.scratch", found)
    return found.rstrip("/")


#: Tables that this process wrote and did not delete, by open scope; the first is for those outside any.
_written: list[list[str]] = [[]]
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process. Results that were not
    written yet still read them, so call this after the last action."""
    for scope in _written:
        while scope:
            _delete(spark, scope.pop())


def drop(*tables: DataFrame) -> None:
    """Delete intermediate tables that nothing unwritten reads any more."""
    for table in tables:
        path = _paths.get(table)
        for scope in _written:
            if path in scope:
                scope.remove(path)
                _delete(table.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator:
    """The intermediate tables that are written inside go at the end, but for
    those given to the function that this yields (and for all, if it fails)."""
    scope: list[str] = []
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(_paths[table])
        return table

    _written.append(scope)
    try:
        yield keep
        for path in scope:
            if path not in kept:
                _delete(spark, path)
        scope[:] = [path for path in scope if path in kept]
    finally:
        _written.remove(scope)
        _written[-1].extend(scope)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: the
    lineage ends there, so a lost executor costs a re-read and nothing more. The
    query's shuffle files go when it is written, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/sieveloom-{label}-{uuid.uuid4().hex}"
    _written[-1].append(path)
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_SHUFFLES) if before is None else spark.conf.set(CLEAN_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def table_bytes(df: DataFrame) -> int:
    """The bytes of ``df``'s rows: eight for each value and row, and what strings and arrays hold."""
    long = [F.octet_length(f"`{f.name}`") if isinstance(f.dataType, StringType | BinaryType) else 8 * F.size(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, StringType | BinaryType | ArrayType)]
    held = sum((F.coalesce(F.greatest(x, F.lit(0)).cast("long"), F.lit(0)) for x in long), F.lit(8 * (1 + len(df.columns))).cast("long"))
    return df.agg(F.sum(held)).first()[0] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if its rows hold at most ``limit`` bytes; a larger
    one is joined by shuffle. ``df`` should be a stored table, as it is read for this."""
    return F.broadcast(df) if table_bytes(df) <= limit else df


def connected_components(edges: DataFrame, label: str = "components", jumps: int = 2) -> DataFrame:
    """Components of an undirected graph.

    ``edges`` has the long columns ``src`` and ``dst``. Returns ``node``,
    ``component`` for every node on an edge, the component being its smallest
    node. Each round points every node to its smallest neighbour, follows the
    pointers ``jumps`` times and contracts the graph, so the edges shrink
    geometrically. All state stays in tables; the driver sees counts only.
    Self loops, repeated edges and edges with a null end have no effect.
    """
    live = materialize(
        edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(),
        f"{label}-edges",
    )
    member = None
    while live.limit(1).count():
        both = live.union(live.select("b", "a"))
        up = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), f"{label}-up")
        jumped = up
        for _ in range(jumps):
            step = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = jumped.join(step, "p").select("a", F.col("q").alias("p"))
        jumped = materialize(jumped, f"{label}-jump")
        near = jumped.select("a", F.col("p").alias("pa"))
        far = jumped.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        drop(up)
        before, live = live, materialize(
            live.join(near, "a").join(far, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            f"{label}-edges",
        )
        drop(before)
        hop = jumped.select(F.col("a").alias("component"), F.col("p").alias("root"))
        if member is None:
            moved = jumped.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            moved = member.join(hop, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        before, member = member, materialize(moved, f"{label}-member")
        drop(jumped, *[] if before is None else [before])
    if member is None:
        member = materialize(live.select(F.col("a").alias("node"), F.col("b").alias("component")), f"{label}-member")
    drop(live)
    return member
