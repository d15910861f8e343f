"""Packing: token sequences by shortest-pack-first over the length histogram.

Documents are tokenised, closed by one end id and cut at ``max_len``. The
histogram of piece lengths (at most ``max_len`` bins, so its size is proven)
goes to the driver, where lengths are placed longest first, each into the
emptiest packing pattern that has room, and patterns carry counts. Ranks of
pieces within their length then tell each piece its pattern and place.
"""

from __future__ import annotations

import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveloom.llm import graph
from sieveloom.llm.common import materialize
from sieveloom.llm.graph import slices

MAX_LEN = 2048
END_ID = 1
#: Words whose ids a Python worker remembers: the first that it meets, as common words come early.
CACHE_WORDS = 200_000
#: White space to Python, not to the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Pieces of one length that are ranked together.
RANK_ROWS = 2048


class WordIds(dict):
    """Ids of white-space separated chunks, as little-endian 32-bit bytes.

    The tokenizer drops white space and starts afresh after it, so a text's ids
    are its chunks' ids. Chunks of Latin-1 letters, digits and ASCII punctuation
    are cut here and go straight to the tokenizer's model; all others, and those
    that may hold a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        import re

        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.limit, self.piece = Tokenizer.from_file(path), limit, {}
        self.model = self.tokenizer.model
        letters = "A-Za-zÀ-ÖØ-öø-ÿ"
        # str.split() would also split at, and drop, U+001C to U+001F, which are no white space to the tokenizer
        self.split = re.compile(r"[^\S\x1c-\x1f]+").split
        self.plain = re.compile(rf"[{letters}0-9!-/:-;=-@\[-`{{-~]+").fullmatch
        self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^{letters}0-9]+").findall
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_char = {chr(i): "".join(x for x, _ in bytewise.pre_tokenize_str(chr(i))) for i in range(33, 256)}
        self.fast = self._agrees()

    def _agrees(self) -> bool:
        """Whether the short way gives the tokenizer's own ids on a sample of shapes."""
        shapes = "the The, don't it's I'LL Élan's straße 1a2b a1! (x) c'est--bon ÀÉÎÕÜ ÿþ x-y_z 'tis ''s 's' a'sb @#$%&*()".split()
        return all(self._short(x) == self._long(x) for x in shapes)

    def _long(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _short(self, chunk: str) -> bytes:
        out = []
        for part in self.cut(chunk.lower()):
            got = self.piece.get(part)
            if got is None:
                seen = part if part.isascii() else "".join(map(self.byte_char.__getitem__, part))
                got = np.array([x.id for x in self.model.tokenize(seen)], "<u4").tobytes()
                if len(self.piece) < self.limit:
                    self.piece[part] = got
            out.append(got)
        return b"".join(out)

    def __missing__(self, chunk: str) -> bytes:
        got = self._short(chunk) if self.fast and self.plain(chunk) else self._long(chunk)
        if len(self) < self.limit:
            self[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        chunks = self.split(text) if any(x in text for x in SEPARATORS) else text.split()
        return b"".join(map(self.__getitem__, filter(None, chunks)))


def word_ids(path: str) -> WordIds:
    """One per worker process, kept between its tasks."""
    kept = sys.__dict__.setdefault("_sieveloom_word_ids", {})
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``max_len`` ids, the document's end id last:
    ``doc_id, start, length, ids_crc32, doc_tokens`` and, if asked for, ``ids``."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words = word_ids(tokenizer_path)
        for batch in slices(batches):
            rows: list[list] = [[], [], [], [], []]
            kept = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.encode(text or "") + end
                total = len(ids) // 4
                for at in range(0, total, max_len):
                    part = ids[4 * at : 4 * (at + max_len)]
                    for column, value in zip(rows, (doc, at, len(part) // 4, zlib.crc32(part), total), strict=True):
                        column.append(value)
                    if with_ids:
                        kept.append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [pa.array(x, pa.int64()) for x in rows]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def pack_histogram(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packing patterns ``(times, ((length, how many), ...))`` that use up the
    histogram. Lengths are placed longest first; a length goes to the pattern
    with most room left, of which as many as needed are split off. Where none has
    room, it opens patterns of as many pieces of its own as fit."""
    room: dict[int, list[list]] = defaultdict(list)
    done = []
    for length in sorted((k for k, v in counts.items() if v > 0), reverse=True):
        left = counts[length]
        while left:
            free = max((k for k, v in room.items() if v), default=0)
            if free < length:
                full = max_len // length
                for times, many in ((left // full, full), (1, left % full)):
                    if times and many:
                        room[max_len - many * length].append([times, ((length, many),)])
                break
            times, pattern = room[free].pop()
            fits = free // length if left >= times else 1
            used = min(times, left)
            fits = min(fits, left // used)
            if used < times:
                room[free].append([times - used, pattern])
            room[free - fits * length].append([used, (*pattern, (length, fits))])
            left -= used * fits
    for free in sorted(room):
        done += [(times, pattern) for times, pattern in room[free]]
    return done


def slots(patterns) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, rank after the last, first sequence, offset)`` of
    every place in the patterns; within a length the ranks are used in turn."""
    out, used, sequence = [], defaultdict(int), 0
    for times, pattern in patterns:
        offset = 0
        for length, many in pattern:
            for _ in range(many):
                out.append((length, used[length], used[length] + times, sequence, offset))
                used[length] += times
                offset += length
        sequence += times
    return out


def pack(cut: DataFrame, max_len: int = MAX_LEN, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces. ``cut`` must be a stored
    table: it is read twice and both reads must agree."""
    spark = cut.sparkSession
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most max_len rows
    patterns = pack_histogram(counts, max_len)
    rows = slots(patterns)
    places = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length long, r0 long, r1 long, base long, offset long")
    shards = max(1, -(-sum(counts.values()) // rank_rows))
    dealt = cut.withColumn("__shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)))
    before = Window.partitionBy("length").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.groupBy("length", "__shard").count().select("length", "__shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__ahead"))
    within = Window.partitionBy("length", "__shard").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("__rank", F.row_number().over(within) - 1).join(ahead, ["length", "__shard"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__ahead"))
    # places: at most a few times max_len rows, as patterns are split at most once for each length and pattern
    placed = ranked.join(F.broadcast(places), "length").where("__rank >= r0 AND __rank < r1")
    return placed.select(*cut.columns, (F.col("base") + F.col("__rank") - F.col("r0")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, with_ids: bool = False) -> DataFrame:
    """Documents packed into sequences of at most ``max_len`` ids, a row per piece:
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Defined results: a null or empty text is its end id alone; a text longer than
    ``max_len`` is cut into full pieces and a rest; repeated rows are packed as
    often as they come; a null id is carried; an empty table gives no rows. Only
    the id and text columns are read.
    """
    cut = materialize(pieces(docs, tokenizer_path, max_len=max_len, with_ids=with_ids), "pieces")
    return pack(cut, max_len)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(graph)
