"""License scans: canonical digests of entire texts, hash-joined to known licences.

Texts are compared by the SHA-256 of a canonical form, in which case,
punctuation, spacing, copyright lines and equivalent spellings do not matter.
The same column expressions make the known digests and the documents', so the
two cannot drift apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveloom.llm.common import broadcast_if_small
from sieveloom.llm.license_texts import TEXTS

#: A line that starts as a copyright line, comment signs aside.
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;>-]*(portions )?(copyright( \(c\)| ©|:| by)? ?[0-9<\[{][^\n]*|\(c\) ?[0-9][^\n]*|© ?[0-9][^\n]*|all rights reserved[^\n]{0,2}[ \t]*)"
#: Also lines without a year: whatever begins with a copyright mark and is no
#: sentence of a licence. Longer names than these words would be licence text lost.
ANY_COPYRIGHT_LINE = r"(^|\n)[ \t*#/;>-]*(portions )?(copyright(?! ?(notices?|holders?|owners?|laws?|licen[cs]es?|statements?|interests?|treaty|treaties|protection|status|and|or|is|in|of|to)\b)[^\n]*|\(c\) ?[^\n]*|©[^\n]*|all rights reserved[^\n]{0,2}[ \t]*)"
#: All that is no letter or digit.
NOT_WORD = r"[^a-z0-9\x{AA}\x{B5}\x{BA}\x{C0}-\x{1FFF}\x{2C00}-\x{2DFF}\x{3040}-\x{D7FF}\x{F900}-\x{FDFF}\x{10000}-\x{10FFFF}]+"
#: Equivalent spellings; words stand between single spaces of their own.
SPELLINGS = (
    (r" (sub|non)  (licen[cs]e[ds]?|licen[cs]ing|commercial|commercially) ", r" \1\2 "),
    (r" ((?:sub|re)?licen|defen|offen|preten)c(e|es|ed|ing) ", r" \1s\2 "),
    (r" practi[cs](e|es|ed|ing) ", r" practic\1 "),
    (r" ((?:un)?authori|organi|reali|recogni|utili|optimi|maximi|initiali|categori|capitali|emphasi|customi)s(e|es|ed|ing|er|ers|ation|ations) ", r" \1z\2 "),
    (r" analys(e|ed|es|ing) ", r" analyz\1 "),
    (r" (fav|lab|col|hon|behavi)our(s|ed|ing|able|ite|al)? ", r" \1or\2 "),
    (r" (cent|calib)re(s)? ", r" \1er\2 "),
    (r" (acknowledg|judg)ement(s)? ", r" \1ment\2 "),
    (r" (cancel|label|model|signal)l(ed|ing) ", r" \1\2 "),
    (r" (catal|anal)ogue(s)? ", r" \1og\2 "),
    (r" artefact(s)? ", r" artifact\1 "),
    (r" whilst ", r" while "),
    (r" wilful(ly)? ", r" willful\1 "),
    (r" fulfil(s|ment)? ", r" fulfill\1 "),
    (r" programme(s)? ", r" program\1 "),
    (r" per  cent ", r" percent "),
    (r" copyright  (owner|owners) ", r" copyright  holder "),
    (r" copyright  holders ", r" copyright  holder "),
    (r" https ", r" http "),
)


def canonical(text: Column, copyright_line: str = COPYRIGHT_LINE) -> Column:
    """The canonical form; null stays null, a text without words is ``' '``-only."""
    out = F.regexp_replace(F.lower(text), copyright_line, "\n")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, NOT_WORD, "  ")), F.lit(" "))
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    return out


def digest(text: Column, copyright_line: str = COPYRIGHT_LINE) -> Column:
    return F.sha2(canonical(text, copyright_line).cast("binary"), 256)


def known_licenses(spark, texts: dict[str, str] | None = None, copyright_line: str = COPYRIGHT_LINE) -> DataFrame:
    """``license_id, digest`` of licence texts (by default the built-in ones)."""
    rows = sorted((TEXTS if texts is None else texts).items())
    known = spark.createDataFrame(rows, "license_id string, text string")
    return known.select("license_id", digest(F.col("text"), copyright_line).alias("digest"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", copyright_line: str = COPYRIGHT_LINE) -> DataFrame:
    """``doc_id, digest, license_id`` for every row; license_id is null where the
    entire text is no known licence. ``known`` must come from the same
    ``copyright_line``; ``ANY_COPYRIGHT_LINE`` takes lines without a year as well.

    Defined results: a null text has a null digest and no licence; texts without
    a word share a digest, which no licence has; licences with the same digest
    count as the one with the smallest id; repeated rows and null ids are
    carried; empty tables give no rows or no licences. Other columns are not read.
    """
    known = known.where("digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col), copyright_line).alias("digest"))
    return found.join(broadcast_if_small(known), "digest", "left").select("doc_id", "digest", "license_id")
