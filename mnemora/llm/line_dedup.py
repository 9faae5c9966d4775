"""Line deduplication by overlapping windows of three lines, in DataFrame operations.

A text is split at line feeds, and each run of three consecutive lines is a window, named by the MD5
of its text. A window that occurs more than once in the table stays at its first place, by (document
id, line number); at all later places its lines are removed, overlapping windows together covering
the union of their lines. Every distinct line keeps a copy: the first place of a line's earliest
window is never a later occurrence.

Counting windows is an aggregation with a fixed-width state, combined before its shuffle, so that a
passage in a third of all documents is one row per task. The repeated ones are written to the shared
folder; finding their places again is a shuffle join of narrow rows with only sorts above its
exchanges, which adaptive execution splits at hot windows. Positions then gather per document, as a set,
so that a row that repeats a million times has the positions of one, and only they meet the texts, which
are shuffled once.

Defined results: null text = empty text; texts of fewer than three lines, and windows of blank lines
only, are left alone; null ids come before all others, and different texts without an id are different
documents, ordered by their hash; rows that share an id count as one document, so windows they have at
the same line number are not later occurrences of each other; rows that repeat are treated alike; a text
may be as long as a row can hold, its windows being made within its row; an empty table gives an empty
result; other columns pass through, whatever their names and types, but for columns named n_lines or
n_removed, which the result's own replace.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import whole_text, written

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(id, tag, pos, w, place) of (id, text) rows: pos counts lines from 0; place orders occurrences."""
    lines = docs.select("id", F.xxhash64("text").alias("tag"), _lines(F.col("text")).alias("lines")).where(F.size("lines") >= window)
    texts = F.transform(F.sequence(F.lit(1), F.size("lines") - window + 1), lambda i: F.array_join(F.slice("lines", i, window), "\n"))
    names = F.transform(texts, lambda x: F.when(~x.rlike(r"\A[\x20\x09-\x0D]*\z"), F.unhex(F.md5(x))))
    rows = lines.select("id", "tag", F.posexplode(names).alias("pos", "w")).where(F.col("w").isNotNull())
    # below all ids, a number of its own for each text without one
    unnamed = (F.lit(Decimal(-(2**64) - 1)) - F.col("tag").cast("decimal(20,0)")).cast("decimal(20,0)")
    first = F.coalesce(F.col("id").cast("decimal(20,0)"), unnamed) * F.lit(Decimal(10**10)) + F.col("pos").cast("decimal(10,0)")
    return rows.withColumn("place", first)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, tag, starts): per document, the line numbers at which later occurrences of windows start."""
    windows = _windows(docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")), window)
    firsts = written(windows.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).where("n > 1").select("w", "first"))
    later = windows.join(firsts, "w").where("place > first")
    return later.groupBy("id", "tag").agg(F.collect_set("pos").alias("starts"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows and columns of docs with the text cleaned, and two columns more: n_lines, n_removed."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # inside, columns go by their place, so that no name can clash
    inner = {c: f"c{k}" for k, c in enumerate(names)}
    rows = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in inner.items()))
    text = whole_text(inner[text_col])
    starts = repeated_lines(rows, inner[id_col], inner[text_col], window)
    joined = rows.join(starts, F.col(inner[id_col]).cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("tag")), "left")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + window - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    cleaned = F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")
    out = joined.withColumn("lines", _lines(text)).withColumn("kept", F.when(F.col("starts").isNotNull(), kept))
    return out.select(
        *(F.when(F.col("kept").isNull(), F.col(i)).otherwise(cleaned).alias(c) if c == text_col else F.col(i).alias(c) for c, i in inner.items()),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
    )
