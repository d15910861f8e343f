"""URL filters: prefix rules as nested intervals, matched by a sorted sweep.

Built-in column functions only. A host reversed label by label ("com.example.")
turns "this host and its subdomains" into a prefix, and a prefix into an
interval of the sorted keys. Intervals of prefixes are nested or disjoint, so
the rules that are active at a key are a stack: the last rule that began at or
before the key, and the rules that enclose it. The sweep is run twice: over
distinct hosts, which yields the host rules' anchors, and over distinct paths
below each anchor, which yields the longest path prefix. Keys are dealt by
range, and each range starts with the stack that the ranges before it left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveloom.llm.common import broadcast_if_small, materialize


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = _rest(url)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels in reverse order, each closed by a dot: ``a.example.com`` -> ``com.example.a.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def enclosing(queries: DataFrame, rules: DataFrame, partitions: int, label: str) -> DataFrame:
    """``key, rule``: each of the distinct ``queries.key`` with every one of the
    distinct ``rules.key`` that is a prefix of it.

    One sort of both by key. The last rule at or before a key carries its stack
    (itself and the rules that are prefixes of it); those of the stack that are
    prefixes of the key are active.
    """
    rules = materialize(rules.select("key").distinct(), f"{label}-rules")
    lengths = F.broadcast(rules.agg(F.array_sort(F.collect_set(F.length("key"))).alias("lengths")))  # one row; as many items as key lengths
    heads = rules.join(lengths).select("key", F.explode("lengths").alias("n")).where("n <= length(key)").select("key", F.expr("substring(key, 1, n)").alias("head"))
    stacks = heads.join(rules.select(F.col("key").alias("head")), "head").groupBy("key").agg(F.array_sort(F.collect_list("head")).alias("stack"))
    stacks = materialize(stacks, f"{label}-stacks")
    events = queries.select("key", F.lit(1).alias("is_query"), F.lit(None).cast("array<string>").alias("stack")).union(stacks.select("key", F.lit(0), "stack"))
    dealt = events.repartitionByRange(partitions, "key", "is_query").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, f"{label}-sweep")
    sweep = Window.partitionBy("part").orderBy("key", "is_query").rowsBetween(Window.unboundedPreceding, 0)
    seen = dealt.withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
    # the last rule of each range: a row for each range
    ends = dealt.where("is_query = 0").groupBy("part").agg(F.max("key").alias("key"))
    parts = dealt.select("part").distinct().join(ends, "part", "left")
    carry = parts.withColumn("prior", F.max("key").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    carry = carry.where("prior IS NOT NULL").select("part", F.col("prior").alias("key")).join(stacks, "key").select("part", F.col("stack").alias("carried"))
    found = seen.where("is_query = 1").join(F.broadcast(carry), "part", "left").select("key", F.explode(F.coalesce("open", "carried")).alias("rule"))
    return found.where(F.startswith("key", "rule"))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", default: str = "allow", partitions: int | None = None) -> DataFrame:
    """Verdict of host and path prefix rules for every URL.

    ``rules``: ``verdict, host, path``. A rule fits its host and all subdomains if
    the path starts with its own; the longest ``host + path`` wins, then the
    longest host, then the smallest verdict. Returns ``page_id, host, path, rule,
    verdict``, a row for each input row. Defined results: a null URL or one
    without ``://`` has an empty host and path, which only a rule with both empty
    fits; without a rule the verdict is ``default``; repeated rows and null ids
    are carried; an empty table of pages or rules gives no rows or no matches.
    """
    spark = pages.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parsed = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    parsed = materialize(parsed, "url-pages")
    rules = rules.select(F.coalesce("host", F.lit("")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict").distinct()
    rules = materialize(rules.withColumn("anchor", F.when(F.col("r_host") == "", "").otherwise(reversed_host(F.col("r_host")))), "url-rules")

    hosts = parsed.select("host").distinct().withColumn("key", F.when(F.col("host") == "", "").otherwise(reversed_host(F.col("host"))))
    anchors = enclosing(hosts, rules.select(F.col("anchor").alias("key")), partitions, "url-host")
    anchors = hosts.join(anchors, "key").select("host", F.col("rule").alias("anchor"))
    # a host without labels fits an empty anchor only; all others fit it as well
    places = parsed.select("host", "path").distinct().join(anchors, "host")
    below = places.select(F.concat("anchor", F.lit("\x00"), "path").alias("key")).distinct()
    ruled = rules.withColumn("key", F.concat("anchor", F.lit("\x00"), "r_path"))
    fits = enclosing(below, ruled.select("key"), partitions, "url-path")
    fits = fits.join(ruled.select(F.col("key").alias("rule"), "r_host", "r_path", "verdict"), "rule").select("key", "r_host", "r_path", "verdict")
    best = F.max(F.struct(F.length(F.concat("r_host", "r_path")).alias("size"), F.length("r_host").alias("deep"), (F.lit(0) - F.when(F.col("verdict") == "allow", 0).otherwise(1)).alias("first"), "r_host", "r_path", "verdict"))
    won = places.withColumn("key", F.concat("anchor", F.lit("\x00"), "path")).join(fits, "key").groupBy("host", "path").agg(best.alias("won"))
    won = materialize(won.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.concat("won.r_host", "won.r_path").alias("rule"), "won.verdict"), "url-won")
    out = parsed.join(broadcast_if_small(won), (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
