"""Exact token counts for every context limit, from one histogram of encoded lengths.

Documents are encoded whole, and counted by length (one aggregation, combined before its shuffle).
For a limit L, documents cut to L tokens hold ``sum(min(length, L))`` tokens: all tokens, less those of
longer documents, plus L for each of these. The numbers of longer documents and of their tokens are suffix
sums over the histogram, so a row per distinct length answers every limit, the truncated total being
linear between neighbouring lengths.

Suffix sums go in two levels, so that no task sees the whole histogram: inside blocks as wide as the
square root of the largest length, and over the blocks' totals. As lengths are below 2^31, neither a block
nor the list of blocks can have more than 46,341 rows, whatever the corpus.

Defined results: null and empty texts have length 0 and are counted; each row counts, whether it repeats
or not, and ids are not looked at; a text may be as long as a row can hold; no documents, no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import map_slices, whole_text, written
from .bpe import _counter, ship


def token_lengths(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """(length) of every row."""
    data = ship(docs.sparkSession, tokenizer_path)

    def make(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        count = _counter(data.value).encode
        yield pa.RecordBatch.from_arrays([pa.array([count(x) for x in part.column("text").to_pylist()], pa.int64())], ["length"])

    return map_slices(docs.select(whole_text(text_col).alias("text")), "text", make, "length long")


def length_histogram(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """(length, n_docs) per distinct length."""
    return token_lengths(docs, tokenizer_path, text_col).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def context_report(histogram: DataFrame) -> DataFrame:
    """One row per distinct length, as a context limit: length, n_docs, docs_up_to, docs_longer,
    tokens_up_to (of documents that fit), truncated_total (all documents, cut to the limit),
    total_docs, total_tokens, and quantile, the share of documents that fit. The histogram is written
    once, as blocks and lengths both read it and texts should be encoded once."""
    histogram = written(histogram)
    width = math.isqrt(histogram.agg(F.max("length").alias("n")).first()["n"] or 0) + 1
    h = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / width).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # a row per block: 46,341 at most
    later, everything = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing), Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = blocks.select(
        "block", F.sum("d").over(later).alias("docs_later"), F.sum("t").over(later).alias("tokens_later"), F.sum("d").over(everything).alias("total_docs"), F.sum("t").over(everything).alias("total_tokens")
    )
    above = Window.partitionBy("block").orderBy("length").rowsBetween(1, Window.unboundedFollowing)
    run = h.select("*", F.sum("n_docs").over(above).alias("d"), F.sum("tokens").over(above).alias("t")).join(totals, "block")
    both = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    longer, tokens_longer = both(F.col("d"), F.col("docs_later")), both(F.col("t"), F.col("tokens_later"))
    up_to, whole = F.col("total_docs") - longer, F.col("total_tokens") - tokens_longer
    return run.select(
        "length", "n_docs", up_to.alias("docs_up_to"), longer.alias("docs_longer"), whole.alias("tokens_up_to"),
        (whole + longer * F.col("length")).alias("truncated_total"), "total_docs", "total_tokens", (up_to / F.col("total_docs")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, truncated_total, docs_cut) for given limits."""
    each = histogram.select("length", "n_docs", F.explode(F.array(*[F.lit(int(x)) for x in limits])).alias("context_limit"))
    return each.groupBy("context_limit").agg(
        F.sum(F.least("length", "context_limit") * F.col("n_docs")).alias("truncated_total"),
        F.sum(F.when(F.col("length") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_cut"),
    )


def length_quantiles(report: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, length): the smallest length that at least a share of the documents keep within."""
    each = report.select("length", "quantile", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return each.where(F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
