"""Exact deduplication by 128-bit content hash, in DataFrame operations only.

Two texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is
deleted. The steps:

1. *Classes.* Documents are grouped by (MD5 of the normalised text, the normalised text). The hash
   spreads the groups; the text in the grouping key means that members of a hash group are compared
   byte by byte, so an MD5 collision ends in two classes. Aggregation is partial: a task sends each
   of its texts once, however many copies it holds, so a hot group arrives as one row per task.
2. *Membership.* Narrow rows (id, MD5, SHA-256, and XXH64 and length as a check) join the classes on both hashes. Should two
   classes ever agree in both, their rows meet a class with another check, and the query stops with an error instead of merging
   them. Only sorts stand between the join and its exchanges, so that adaptive execution splits the join where a group
   of copies is hot.

Texts are shuffled once at most; nothing is collected or broadcast by hint.

Defined results: a null text is an empty text; of equal texts the one with the most code points
stays, then the smallest id; a null id never wins while any copy has an id; rows that repeat, ids
included, are separate members of their group, and each row with the kept id has kept = true; ids may be
any 64-bit numbers; texts may be as long as a row can hold; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import column, whole_text

WHITESPACE = r"[\x20\x09-\x0D]+"
#: A length of one more counts for more than any two 64-bit ids are apart.
_SCALE = "decimal(20,0)"
_LENGTH_UNIT = Decimal(2**64)


def normalised(column: str) -> Column:
    return F.regexp_replace(whole_text(column), WHITESPACE, "")


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct normalised text: content_md5, text_sha256, group_size, keep_id, check."""
    source = docs.select(column(id_col).cast("long").alias("id"), F.char_length(whole_text(text_col)).alias("n"), normalised(text_col).alias("norm"))
    # One fixed-width number orders (length, smallest id), so that the aggregation stays a hash aggregation.
    rank = F.col("n").cast("decimal(10,0)") * _LENGTH_UNIT - F.col("id").cast(_SCALE)
    grouped = source.groupBy(F.unhex(F.md5("norm")).alias("content_md5"), "norm").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.when(F.col("id").isNotNull(), F.col("n"))).alias("longest"),
        F.max(rank).alias("rank"),
    )
    keep = (F.col("longest").cast("decimal(10,0)") * _LENGTH_UNIT - F.col("rank")).cast("long")
    return grouped.select("content_md5", F.sha2("norm", 256).alias("text_sha256"), "group_size", keep.alias("keep_id"), _check("norm").alias("check"))


def _check(norm: str) -> Column:
    return F.struct(F.xxhash64(norm), F.octet_length(norm))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: <id_col>, keep_id, group_size, kept, text_sha256, content_md5."""
    narrow = docs.select(column(id_col).alias("__id"), normalised(text_col).alias("__norm")).select(
        "__id", F.unhex(F.md5("__norm")).alias("content_md5"), F.sha2("__norm", 256).alias("text_sha256"), _check("__norm").alias("__check")
    )
    met = narrow.join(exact_classes(docs, id_col, text_col), ["content_md5", "text_sha256"])
    size = F.when(F.col("__check") == F.col("check"), F.col("group_size")).otherwise(F.raise_error(F.lit("two texts agree in MD5 and SHA-256")))
    return met.select(
        F.col("__id").alias(id_col), "keep_id", size.alias("group_size"), F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.lower(F.hex("content_md5")).alias("content_md5")
    )
