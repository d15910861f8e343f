"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit similarity, components.

Built-in column functions only. Normalised lines are reduced to distinct ones
with a 64-bit SimHash of their words, in which long words weigh more: were
common short words to count alike, unrelated lines would share blocks by the
thousand. Fingerprints within three bits agree on
two of five blocks, so ten keys for each fingerprint bring all such pairs
together. A key's lines are first compared with those of its smallest
fingerprint, lines of equal fingerprint with the first of them; after the linked
ones are merged, only lines outside the main component are compared with those
of other components, so many like lines cost in proportion to their number and
not to its square. Pairs are verified by edit similarity of the
normalised lines, and one occurrence of each component stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveloom.llm.common import broadcast_if_small, connected_components, materialize, scratch
from sieveloom.llm.simhash import RADIUS, block_masks

SIMILARITY = 0.8
#: Bits of a count of votes, and the words whose weight (at most 49 each) leaves its top bit free; longer lines are counted in chunks.
LANE, CHUNK = 16, 668
#: Characters up to which chunks are added up in lanes of 32 bits; votes of longer lines are counted in full width.
HEAVY = 1 << 19
#: Two texts are compared in pieces of about STRIDE characters that begin where PROBE characters are the same.
STRIDE, PROBE = 64, 12
#: Told apart by these: two lines of one fingerprint and length are one if their hashes agree.
LINE = ["h", "fp", "size"]


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select(*[c for c in df.columns if c != name], value.alias(name))


def normalized(df: DataFrame, line: str) -> DataFrame:
    """``df`` with ``line`` in lower case, with single spaces and no white space at
    either end; in steps, so that each is computed once."""
    df = _once(df, line, F.lower(line))
    low = F.col(line)
    odd = low.contains("  ") | low.contains("\t") | low.contains("\r") | low.contains("\f") | low.contains("\x0b")
    return _once(df, line, F.trim(F.when(odd, F.regexp_replace(low, r"[ \t\r\f\x0B]+", " ")).otherwise(low)))


def _weight(word: Column) -> Column:
    """The square of half a word's length, from 1 to 49."""
    half = F.greatest(F.lit(1), F.least(F.lit(7), F.shiftright(F.length(word), 1)))
    return (half * half).cast("long")


def _majority(sums: list[Column], weight: Column, lane: int) -> Column:
    """The bits whose count is more than half the weight: sum i holds bits i,
    i + lane, ... in a lane each, and a count c is more than half of w if
    c + 2^(lane - 2) - 1 - w div 2 sets the last bit but one of its lane."""
    ones = sum(1 << at for at in range(0, 64, lane))
    room = (F.lit((1 << (lane - 2)) - 1).cast("long") - F.shiftright(weight, 1)) * F.lit(ones).cast("long")
    bits = [F.shiftleft(F.shiftrightunsigned((x + room).bitwiseAND(F.lit(ones << (lane - 2)).cast("long")), lane - 2), i) for i, x in enumerate(sums)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, pos, h, fp, size`` of every line that is not blank;
    ``doc_id`` and ``text_key``, a hash of the whole text, tell documents apart.

    Votes are counted for single occurrences, so no count depends on how often a
    line comes, and for CHUNK words at most, so none overflows; the few lines of
    more words are put together afterwards.
    """
    parts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", "\n").alias("parts"))  # below the generator: once for each text
    every = parts.select("doc_id", "text_key", F.posexplode("parts").alias("pos", "norm"))
    # on the line itself: a condition on the normalised one would compute it twice
    every = normalized(every.where(F.col("norm").rlike(r"[^ \t\r\f\x0B]")), "norm")
    # position and length in one long, as each column is carried past every word
    own = ["doc_id", "text_key", "h", "place"]
    place = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.length("norm").cast("long"))
    lines = every.select(F.monotonically_increasing_id().alias("of"), "doc_id", "text_key", F.xxhash64("norm").alias("h"), place.alias("place"), F.split("norm", " ").alias("words"))
    cut = F.transform(F.sequence(F.lit(1), F.size("words"), F.lit(CHUNK)), lambda at: F.slice("words", at, CHUNK))
    chunks = lines.select(F.when(F.size("words") > CHUNK, F.col("of")).alias("of"), *own, F.explode(F.when(F.size("words") <= CHUNK, F.array("words")).otherwise(cut)).alias("words"))
    # of: the line, for those of several chunks
    chunks = chunks.select(F.monotonically_increasing_id().alias("chunk"), "of", *own, "words")
    words = chunks.select("chunk", "of", *own, F.explode("words").alias("word")).select("chunk", "of", *own, F.xxhash64("word").alias("x"), _weight(F.col("word")).alias("w"))
    ones = F.lit(sum(1 << at for at in range(0, 64, LANE))).cast("long")
    names = [f"a{i}" for i in range(LANE)]
    sums = [F.sum(F.shiftrightunsigned("x", i).bitwiseAND(ones) * F.col("w")).alias(a) for i, a in enumerate(names)]
    votes = words.groupBy("chunk").agg(*[F.min(c).alias(c) for c in ["of", *own]], F.sum("w").alias("weight"), *sums)
    whole = F.col("of").isNull()
    fp = F.when(whole, _majority([F.col(a) for a in names], F.col("weight"), LANE)).alias("fp")
    votes = materialize(votes.select("of", *own, fp, *[F.when(~whole, F.col(c)).alias(c) for c in ["weight", *names]]), "line-votes")
    single = lambda df: df.select("doc_id", "text_key", F.shiftright("place", 32).cast("int").alias("pos"), "h", "fp", F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("size"))
    found = single(votes.where("fp IS NOT NULL"))
    several = votes.where("fp IS NULL").withColumn("heavy", F.col("place").bitwiseAND(F.lit((1 << 32) - 1)) > HEAVY)
    joined = None
    for lane, part in ((32, several.where("NOT heavy")), (64, several.where("heavy"))):
        mask = F.lit(sum(((1 << LANE) - 1) << at for at in range(0, 64, lane))).cast("long")
        wide = [F.sum(F.shiftrightunsigned(names[i % LANE], LANE * (i // LANE)).bitwiseAND(mask)).alias(f"b{i}") for i in range(lane)]
        part = part.groupBy("of", *own).agg(F.sum("weight").alias("weight"), *wide)
        part = single(part.select(*own, _majority([F.col(f"b{i}") for i in range(lane)], F.col("weight"), lane).alias("fp")))
        joined = part if joined is None else joined.union(part)
    return found.union(materialize(joined, "line-long"))


def distinct_lines(docs: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """``line, h, fp, size, first, n``: the distinct normalised lines with their
    lengths and first occurrence (smallest document id, null last)."""
    every = occurrences(docs) if every is None else every
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "pos")
    lines = every.groupBy(*LINE).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    return materialize(lines.withColumn("line", F.monotonically_increasing_id()), "lines")


def _near(a: str, b: str, radius: int = RADIUS) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def _keyed(fps: DataFrame) -> DataFrame:
    """``key, fp``: each fingerprint under ten keys, one for each pair of blocks.
    Keys of different pairs differ by a constant; were two the same after all,
    there would be more pairs to look at and none fewer."""
    salts = [(t + 1) * 0x9E3779B97F4A7C15 % (1 << 63) for t in range(len(block_masks()))]
    keys = [F.col("fp").bitwiseAND(F.lit(m).cast("long")).bitwiseXOR(F.lit(x).cast("long")) for m, x in zip(block_masks(), salts, strict=True)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _near_keys(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``fx, fy`` of fingerprints that are near and alone with each other in a
    key, or near the key's smallest; and ``key, fp, low``, the members of keys
    that more than two share."""
    fps = fps.select("fp")
    keys = _keyed(fps).groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count(F.lit(1)).alias("n"))
    # of two that share a key, the pair is known and mostly not near; a key of more is kept
    keys = materialize(keys.where((F.col("n") > 2) | (F.col("n") > 1) & _near("low", "high")), "line-keys")
    twos = keys.where("n = 2").select(F.col("high").alias("fx"), F.col("low").alias("fy"))
    large = materialize(keys.where("n > 2").select("key", "low"), "line-large")
    members = materialize(_keyed(fps).join(broadcast_if_small(large), "key"), "line-members")
    near = twos.union(members.where("fp <> low").where(_near("fp", "low")).select(F.col("fp").alias("fx"), F.col("low").alias("fy"))).distinct()
    return materialize(near, "line-near"), members


def _texts(docs: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``line, norm``: the texts of the ``wanted`` lines, each from its first
    occurrence; one pass over the documents, which splits only those that hold one."""
    wanted = wanted.distinct().join(lines.select("line", "first"), "line")
    wanted = wanted.select(F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__key"), F.struct("line", F.col("first.pos").alias("pos")).alias("at"))
    wanted = materialize(wanted.groupBy("__id", "__key").agg(F.collect_list("at").alias("at")), "line-wanted")
    # rows with the same id and text are one document
    found = docs.withColumn("key", F.xxhash64("text")).join(broadcast_if_small(wanted), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")))
    parts = found.select(F.split("text", "\n").alias("parts"), "at")
    found = parts.select(F.explode(F.transform("at", lambda s: F.struct(s["line"].alias("line"), F.get("parts", s["pos"]).alias("norm")))).alias("l")).select("l.line", "l.norm")
    return materialize(normalized(found, "norm").groupBy("line").agg(F.min("norm").alias("norm")), "line-texts")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``; a lambda's variable is computed once."""
    return F.transform(F.array(value), body)[0]


def _in_pieces(a: str, b: str, room: str) -> Column:
    """Edits that turn ``a`` into ``b`` piece by piece: never fewer than are
    needed, and far more than ``room`` if one piece takes more. Both are cut where
    PROBE characters of ``a`` come next in ``b``. Equal pieces cost nothing, so near
    copies take time in proportion to their length."""
    size, far = F.length(a), F.lit(1 << 29)

    def edits(x: Column, y: Column) -> Column:
        differ = lambda s: F.call_function("levenshtein", s["x"], s["y"], F.col(room))
        return _let(F.struct(x.alias("x"), y.alias("y")), lambda s: F.when(s["x"] == s["y"], 0).otherwise(_let(differ(s), lambda n: F.when(n < 0, far).otherwise(n))))

    def cut(at: Column, pos: Column) -> Column:
        ahead = pos - at["x"]
        slack = F.greatest(F.lit(STRIDE), ahead)  # what lies between may have grown or shrunk
        probe, want = F.call_function("substring", F.col(a), pos, F.lit(PROBE)), at["y"] + ahead
        there = F.when(F.call_function("substring", F.col(b), want, F.lit(PROBE)) == probe, want).otherwise(F.call_function("locate", probe, F.col(b), F.greatest(at["y"], want - slack)))
        piece = lambda to: edits(F.call_function("substring", F.col(a), at["x"], ahead), F.call_function("substring", F.col(b), at["y"], to - at["y"]))
        moved = lambda to: F.struct(pos.alias("x"), to.alias("y"), F.least(at["n"] + piece(to), far).alias("n"))
        return _let(there, lambda to: F.when((to > 0) & (to <= want + slack) & (at["n"] <= F.col(room)), moved(to)).otherwise(at))

    rest = lambda at: F.when(at["n"] > F.col(room), at["n"]).otherwise(F.least(at["n"] + edits(F.call_function("substring", F.col(a), at["x"], size), F.call_function("substring", F.col(b), at["y"], F.length(b))), far))
    cuts = F.when(size > 2 * STRIDE, F.sequence(F.lit(1 + STRIDE), size - PROBE, F.lit(STRIDE))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(cuts, F.struct(F.lit(1).alias("x"), F.lit(1).alias("y"), F.lit(0).alias("n")), cut, rest)


def _verified(texts: DataFrame, pairs: DataFrame, similarity: float, label: str) -> DataFrame:
    """Those ``pairs`` (``x``, ``y``: lines) whose texts are similar enough:
    1 - edits / longer length >= similarity. Pairs that are near enough piece by
    piece pass at once; the edit distance of the whole texts decides on all others."""
    both = pairs.join(texts.select(F.col("line").alias("x"), F.col("norm").alias("a")), "x").join(texts.select(F.col("line").alias("y"), F.col("norm").alias("b")), "y")
    longer = F.greatest(F.length("a"), F.length("b"))
    both = both.withColumn("room", F.floor(longer * (1 - similarity) + 1e-9).cast("int")).where(F.abs(F.length("a") - F.length("b")) <= F.col("room"))
    near = (_in_pieces("a", "b", "room") <= F.col("room")) | (F.call_function("levenshtein", F.col("a"), F.col("b"), F.col("room")) >= 0)
    return materialize(both.where(near).select(F.col("x").alias("src"), F.col("y").alias("dst")), f"{label}-links")


def _line_pairs(fps: DataFrame, x: DataFrame, y: DataFrame, similarity: float) -> DataFrame:
    """``x, y`` of pairs of fingerprints ``fx, fy``: their lines, but for those
    whose lengths alone differ by more edits than may be."""
    both = fps.join(x.select(F.col("fp").alias("fx"), F.col("line").alias("x"), F.col("size").alias("sx"), F.col("c").alias("cx")), "fx")
    both = both.join(y.select(F.col("fp").alias("fy"), F.col("line").alias("y"), F.col("size").alias("sy"), F.col("c").alias("cy")), "fy")
    fits = F.abs(F.col("sx") - F.col("sy")) <= F.floor(F.greatest("sx", "sy") * (1 - similarity) + 1e-9)
    return both.where((F.col("x") != F.col("y")) & (F.col("cx") != F.col("cy")) & fits).select("x", "y")


def linked_lines(docs: DataFrame, lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``node, component`` of the lines that are similar to another one."""
    with scratch(docs.sparkSession) as keep:
        return keep(_linked(docs, lines, similarity))


def _linked(docs: DataFrame, lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    fps = materialize(lines.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "line-fps")
    near, members = _near_keys(fps)
    # whatever is compared shares a fingerprint, is a near pair's or shares a key of more than two
    several = fps.where("n > 1").select("fp")
    some = near.select(F.col("fx").alias("fp")).union(near.select("fy")).union(several).union(members.select("fp")).distinct()
    some = materialize(some, "line-some")
    some = materialize(lines.join(broadcast_if_small(some), "fp").select("fp", "line", "size", "first"), "line-compared")
    of = some.select("fp", "line", "size", F.col("line").alias("c"))
    # equal fingerprints: each line with the first of them
    first = of.groupBy("fp").agg(F.min_by(F.struct("line", "size"), "line").alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("fp", "f.line", "f.size", F.col("f.line").alias("c"))
    equal = _line_pairs(first.select(F.col("fp").alias("fx"), F.col("fp").alias("fy")), of, first, similarity)
    a = materialize(equal.union(_line_pairs(near, of, of, similarity)), "line-a")
    # lines to compare now, and those that may have to be compared later
    later = of.join(several.union(members.select("fp")).distinct(), "fp", "left_semi").select("line")
    texts = _texts(docs, some, a.select(F.col("x").alias("line")).union(a.select("y")).union(later))
    found = _verified(texts, a, similarity, "line-low")
    comp = connected_components(found, "line-low")
    # what is left: lines outside the component of their key's, or their fingerprint's, first line
    some = of.drop("c").join(texts.select("line"), "line", "left_semi").join(comp.select(F.col("node").alias("line"), F.col("component").alias("c")), "line", "left")
    labels = materialize(some.select("fp", "line", "size", F.coalesce("c", "line").alias("c")), "line-labels")
    span = materialize(labels.groupBy("fp").agg(F.min("c").alias("c0"), F.max("c").alias("c1")), "line-span")
    # all lines of the smallest fingerprint were compared already
    others = members.where("fp <> low").join(span, "fp").join(span.select(F.col("fp").alias("low"), F.col("c0").alias("c_low")), "low")
    others = materialize(others, "line-many")
    outside = others.where("c0 <> c_low OR c1 <> c_low").select("key", F.col("fp").alias("fx"), F.col("c0").alias("x0"), F.col("c1").alias("x1"))
    rest = outside.join(others.select("key", F.col("fp").alias("fy"), F.col("c0").alias("y0"), F.col("c1").alias("y1")), "key")
    rest = rest.where((F.col("fx") != F.col("fy")) & (F.least("x0", "y0") != F.greatest("x1", "y1")) & _near("fx", "fy"))
    rest = rest.select(F.least("fx", "fy").alias("fx"), F.greatest("fx", "fy").alias("fy")).distinct()
    within = span.where("c0 <> c1").select(F.col("fp").alias("fx"), F.col("fp").alias("fy"))
    b = _line_pairs(rest, labels, labels, similarity)
    b = materialize(b.union(_line_pairs(within, labels, labels, similarity).where("x < y")), "line-b")
    if not b.limit(1).count():
        return comp
    more = _verified(texts, b, similarity, "line-rest")
    if not more.limit(1).count():
        return comp
    return connected_components(found.union(more), "line-all")


def decide(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, text_key, dropped``: positions of the lines to drop, for each
    document that loses any."""
    with scratch(docs.sparkSession) as keep:
        every = occurrences(docs)
        lines = distinct_lines(docs, every)
        comp = linked_lines(docs, lines, similarity)
        comp = broadcast_if_small(comp.withColumnRenamed("node", "line"))
        grouped = lines.join(comp, "line")
        # the component keeps its first occurrence
        keeper = grouped.groupBy("component").agg(F.min("first").alias("kept"))
        grouped = grouped.join(keeper, "component").select(*LINE, "kept")
        repeated = lines.where("n > 1").join(comp, "line", "left_anti").select(*LINE, F.col("first").alias("kept"))
        kept = [F.col(f"kept.{c}").alias(f"kept_{c}") for c in ("doc_id", "text_key", "pos")]
        rules = materialize(grouped.union(repeated).select(*LINE, *kept), "line-rules")
        hits = every.join(broadcast_if_small(rules), LINE)
        lost = hits.where(~(F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("text_key") == F.col("kept_text_key")) & (F.col("pos") == F.col("kept_pos"))))
        return keep(materialize(lost.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("dropped")), "line-dropped"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the repeated and near-repeated lines taken out of ``text``,
    plus ``__lines`` and ``__dropped``, the numbers of lines before and dropped.

    Defined results: of each group of similar lines the occurrence in the
    document with the smallest id stays, and of several there the first; blank
    lines always stay; a null text stays null; a text all of whose lines go
    becomes empty and its row stays; rows with the same id and text count as one
    document and keep the same lines; of several texts of one id the one with the
    smallest hash comes first; rows with a null id keep a line only if no row with
    an id has it; other columns are carried; an empty table stays empty.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    lost = decide(base, similarity).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("dropped").alias("__lost"))
    joined = docs.join(broadcast_if_small(lost), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left")
    parts = F.split("text", "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("__lost"), i)), "\n")
    out = joined.withColumn("__lines", F.coalesce(F.size(parts), F.lit(0))).withColumn("__dropped", F.coalesce(F.size("__lost"), F.lit(0)))
    return out.withColumn("text", F.when(F.col("__lost").isNotNull(), kept).otherwise(F.col("text"))).drop("__id", "__key", "__lost")
