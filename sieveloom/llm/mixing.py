"""Mixing sources to target weights by Sainte-Lague apportionment.

Built-in column functions only. Equal-token blocks are allocated to sources by
the highest quotients ``target / (2 s + 1)``, then to each source's shards by
the same rule on the shards' sizes. In a shard, whose documents lie in a seeded
order, every block is taken ``quota div blocks`` times and the remaining quota
takes a run of blocks that starts at a seeded place and wraps around.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveloom.llm.common import broadcast_if_small, materialize, scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Share of all sizes that the mix takes, in percent, and the cap on repeats.
PERCENT = 150
CAP = 2
#: Words of a block, at most; a small corpus is cut into no fewer than BLOCKS of them.
BLOCK = 32
BLOCKS = 4096
SHARD_DOCS = 4096
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    empty = lambda i: (F.element_at(parts, i) == "").cast("long")
    # without conditions, so that the text is split once
    return F.size(parts).cast("long") - empty(1) - F.least(empty(-1), F.size(parts).cast("long") - 1)


def seeded(number: Column, salt: str, seed: str = SEED) -> Column:
    """A seeded 32-bit number for each id, the same on any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/{salt}/"), F.coalesce(number.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, cap: int = CAP) -> DataFrame:
    """``source, n_docs, source_size, num, den`` with target = num / den: shares
    of ``percent`` of all sizes by weight, none above ``cap`` times its source,
    the excess reshared by weight until none is above.

    ``sizes``: ``source, n_docs, source_size``, one row per source. Sources are
    filled in order of size per weight: the first that are capped are those
    whose cap lies below the level that the others then get.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    everyone = Window.partitionBy()
    w = (
        w.withColumn("total", F.sum("source_size").over(everyone))
        .withColumn("below", F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("above", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        # the level if exactly the sources before this one were capped, as level / 100
        .withColumn("left", F.col("total") * percent - F.col("below") * (100 * cap))
    )
    w = w.withColumn("open", F.col("left") * F.col("weight") <= F.col("source_size") * (100 * cap) * F.col("above"))
    level = Window.partitionBy("open").orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    w = w.withColumn("left", F.first("left").over(level)).withColumn("above", F.first("above").over(level))
    return w.select(
        "source", "n_docs", "source_size",
        F.when(F.col("open"), F.col("left") * F.col("weight")).otherwise(F.col("source_size") * cap).alias("num"),
        F.when(F.col("open"), F.col("above") * 100).otherwise(F.lit(1)).cast("long").alias("den"),
    )


def sainte_lague(votes: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """Seats for each of ``votes``' rows, ``keys`` unique in ``group``.

    ``votes``: group, keys, ``num``, ``den`` (the votes are num / den >= 0) and
    ``seats``, the group's number of seats. Adds ``quota``. A divisor method
    seats the highest quotients; all seats but few follow from rounding, so only
    quotients near the rounding are ranked: with n rows in a group, the divisor
    shifts seats by at most n / 2 in all, each row by its share of that and one.
    """
    of = Window.partitionBy(*group)
    v = votes.withColumn("__v", F.col("num") / F.col("den"))
    v = v.withColumn("__sum", F.sum("__v").over(of)).withColumn("__n", F.count(F.lit(1)).over(of))
    v = v.withColumn("__x", F.when(F.col("__sum") > 0, F.col("__v") * F.col("seats") / F.col("__sum")).otherwise(0.0))
    slack = F.col("__n") / 2 * F.when(F.col("seats") > 0, F.col("__x") / F.col("seats")).otherwise(0.0) + 2
    v = v.withColumn("__sure", F.greatest(F.lit(0), F.floor(F.col("__x") - slack)).cast("long"))
    v = v.withColumn("__open", F.when(F.col("__v") > 0, F.ceil(F.col("__x") + slack).cast("long") - F.col("__sure")).otherwise(0))
    v = v.withColumn("__spare", F.col("seats") - F.sum("__sure").over(of))
    offers = v.where("__open > 0").select(*group, *keys, "__v", "__sure", "__spare", F.explode(F.sequence(F.lit(0), F.col("__open") - 1)).alias("__i"))
    best = Window.partitionBy(*group).orderBy((F.col("__v") / (2 * (F.col("__sure") + F.col("__i")) + 1)).desc(), *[x for k in keys for x in (F.col(k).isNull(), F.col(k))], "__i")
    won = offers.withColumn("__rank", F.row_number().over(best)).where("__rank <= __spare").groupBy(*group, *keys).agg(F.count(F.lit(1)).alias("__won"))
    right = won.select(*[F.col(c).alias(f"__r_{c}") for c in [*group, *keys]], "__won")
    same = [v[c].eqNullSafe(right[f"__r_{c}"]) for c in [*group, *keys]]
    return v.join(right, same, "left").select(*votes.columns, (F.col("__sure") + F.coalesce("__won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, percent: int = PERCENT, cap: int = CAP, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: str = SEED, key: Column | None = None) -> DataFrame:
    """What the mix takes of every document.

    Returns ``doc_id, size, source_size, target, taken`` and the places that
    were taken: ``whole`` (times the whole document is taken) and the word
    intervals ``[a0, a1)`` and ``[b0, b1)`` that are taken once more; with ``key``,
    a long, also that as ``__key``.
    Blocks have ``block`` words, and fewer in a corpus of less than ``BLOCKS`` of
    them, where whole blocks would be too coarse for the targets.
    Defined results: a null or wordless text has size 0 and nothing taken; the
    null source is a source, last in order; repeated rows are documents of their
    own; null ids come first in a shard, which a hash of their text tells; an empty
    table gives no rows. The same rows give the same result in any order and
    partitioning; which of several rows with the same id and size has which share
    is settled by ``key``, where it is given.
    """
    narrow = [] if key is None else [key.alias("__key")]
    # only rows without an id need their text's hash: one shard could not hold them all
    spare = F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 31))).alias("__spare")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), spare, *narrow)
    base = materialize(base, "mix-sizes")
    per_source = materialize(base.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")), "mix-sources")
    block = max(1, min(block, int(per_source.agg(F.sum("source_size")).first()[0] or 0) // BLOCKS))
    goal = targets(per_source, weights, percent, cap)
    total = F.sum("source_size").over(Window.partitionBy())
    seats = goal.withColumn("seats", F.floor((total * percent + 50 * block) / (100 * block)).cast("long")).withColumn("__all", F.lit(1))
    quotas = materialize(sainte_lague(seats, ["__all"], ["source"]), "mix-quotas")

    src = quotas.select(F.col("source").alias("__source"), "source_size", (F.col("num") / F.col("den")).alias("target"), F.ceil(F.col("n_docs") / shard_docs).alias("__shards"), F.col("quota").alias("seats"))
    small = broadcast_if_small(src)
    placed = base.join(small, base["source"].eqNullSafe(small["__source"])).drop("__source")
    placed = placed.withColumn("__order", seeded(F.col("doc_id"), "order", seed)).withColumn("shard", F.coalesce("__spare", seeded(F.col("doc_id"), "shard", seed)) % F.col("__shards"))
    line = Window.partitionBy("source", "shard").orderBy("__order", "doc_id", "size", *[] if key is None else ["__key"]).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("__end", F.sum("size").over(line))

    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("num"), F.first("seats").alias("seats"))
    shards = sainte_lague(shards.withColumn("den", F.lit(1).cast("long")), ["source"], ["shard"])
    words, blocks = F.col("__words"), F.col("__blocks")
    shards = shards.select(F.col("source").alias("__source"), F.col("shard").alias("__shard"), F.col("num").alias("__words"), F.ceil(F.col("num") / block).alias("__blocks"), F.col("quota").alias("__quota"))
    shards = shards.withColumn("__quota", F.least(F.col("__quota"), blocks * cap))
    shards = shards.withColumn("__whole", F.when(blocks > 0, F.floor(F.col("__quota") / blocks)).otherwise(0).cast("long"))
    shards = shards.withColumn("__more", F.col("__quota") - F.col("__whole") * blocks)
    shards = shards.withColumn("__from", F.when(blocks > 0, seeded(F.concat_ws("/", F.coalesce("__source", F.lit("")), F.col("__shard").cast("string")), "start", seed) % blocks).otherwise(0))
    last = F.col("__from") + F.col("__more")
    shards = shards.withColumn("__lo", F.col("__from") * block).withColumn("__hi", F.least(last * block, words))
    shards = shards.withColumn("__wrap", F.least(F.greatest(last - blocks, F.lit(0)) * block, words))

    both = placed.join(shards, placed["source"].eqNullSafe(shards["__source"]) & (placed["shard"] == shards["__shard"]))
    begin, size = F.col("__end") - F.col("size"), F.col("size")
    clip = lambda x: F.greatest(F.lit(0), F.least(x - begin, size)).cast("long")
    both = both.withColumn("a0", clip(F.lit(0))).withColumn("a1", clip(F.col("__wrap"))).withColumn("b0", clip(F.col("__lo"))).withColumn("b1", clip(F.col("__hi")))
    taken = F.col("__whole") * size + F.col("a1") - F.col("a0") + F.greatest(F.col("b1") - F.col("b0"), F.lit(0))
    return both.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("__whole").alias("whole"), "a0", "a1", "b0", "b1", *([] if key is None else ["__key"]))


def apply_mix(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed documents: ``docs``' rows as often as the mix takes them whole,
    and once more with the words of a part that it takes; all columns stay, the
    text and, where there is one, its length are those of the part.

    Shares are settled on narrow rows; texts then move once, to their shares. Rows
    that are the same in all columns are one text to all of these rows' shares.
    """
    kinds = dict(docs.dtypes)
    key = F.xxhash64(*[F.to_json(F.col(f"`{c}`")) if "map<" in kinds[c] else F.col(f"`{c}`") for c in docs.columns])
    with scratch(docs.sparkSession) as keep:
        shares = mix(docs, id_col, text_col, key=key, **options).select(F.col("doc_id").alias("__id"), "__key", "size", "whole", "a0", "a1", "b0", "b1", "taken")
        shares = keep(materialize(shares, "mix-shares"))
        several = keep(materialize(shares.groupBy("__id", "__key").count().where("count > 1").select("__id", "__key"), "mix-several"))
    same = lambda x, y: x["__id"].eqNullSafe(y["__id"]) & (x["__key"] == y["__key"])
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), key.alias("__key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    taken = shares.where("taken > 0")
    names = ["__row", "size", "whole", "a0", "a1", "b0", "b1"]

    def give(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.withColumnsRenamed({"__id": "__of", "__key": "__at"})
        return x.join(y, x["__id"].eqNullSafe(y["__of"]) & (x["__key"] == y["__at"])).select(*names)

    if several.limit(1).count():
        few = broadcast_if_small(several)
        once = rows.join(few, same(rows, few), "left_semi").groupBy("__id", "__key").agg(F.first("__row").alias("__row"))
        again = give(once, taken.join(few, same(taken, few), "left_semi"))
        mixed = give(rows.join(few, same(rows, few), "left_anti"), broadcast_if_small(taken.join(few, same(taken, few), "left_anti"))).union(again)
    else:
        mixed = give(rows, broadcast_if_small(taken))
    text = F.col(f"__row.`{text_col}`")
    rest = F.col("a1") - F.col("a0") + F.greatest(F.col("b1") - F.col("b0"), F.lit(0))
    words = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), 0)
    cut = lambda lo, hi: F.slice(words, (F.col(lo) + 1).cast("int"), F.greatest(F.col(hi) - F.col(lo), F.lit(0)).cast("int"))
    part = F.when(rest == F.col("size"), text).otherwise(F.array_join(F.concat(cut("a0", "a1"), cut("b0", "b1")), ""))
    copies = F.concat(F.array_repeat(F.lit(True), F.col("whole").cast("int")), F.when(rest > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    out = mixed.select("*", F.explode(copies).alias("__full")).withColumn("__text", F.when(F.col("__full"), text).otherwise(part))
    columns = {c: F.col(f"__row.`{c}`") for c in docs.columns} | {text_col: F.col("__text")}
    if chars_col in columns:
        columns[chars_col] = F.length("__text").cast(docs.schema[chars_col].dataType)
    return out.select(*[x.alias(c) for c, x in columns.items()])
