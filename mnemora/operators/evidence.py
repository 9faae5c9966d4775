"""Source references: resolution against transcripts, and composition of what they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUES = ("missing_transcript", "missing_turn", "invalid_span")


def source_refs(memories: DataFrame) -> DataFrame:
    """(id, pos, transcript_id, turn_idx, span) of declared memories; pos counts from 0."""
    return (
        memories.where("provenance_status = 'declared'")
        .select("id", F.posexplode("source_refs").alias("pos", "ref"))
        .select("id", "pos", F.col("ref.transcript_id").alias("transcript_id"), F.col("ref.turn_idx").alias("turn_idx"), F.col("ref.span").alias("span"))
    )


def classified_refs(refs: DataFrame, transcripts: DataFrame, turns: DataFrame) -> DataFrame:
    """refs with turn_length and outcome: `ok`, `whole` (a whole transcript), or one of ISSUES. Only the
    turns' lengths take part in the joins, not their texts."""
    known = transcripts.select("transcript_id", F.lit(True).alias("__known"))
    lengths = turns.select("transcript_id", "turn_idx", F.char_length("content").alias("turn_length"))
    outcome = (
        F.when(F.col("__known").isNull(), "missing_transcript")
        .when(F.col("turn_idx").isNull(), "whole")
        .when(F.col("turn_length").isNull(), "missing_turn")
        .when(F.col("span.end") > F.col("turn_length"), "invalid_span")
        .otherwise("ok")
    )
    return refs.join(known, "transcript_id", "left").join(lengths, ["transcript_id", "turn_idx"], "left").select("id", "pos", "transcript_id", "turn_idx", "span", "turn_length", outcome.alias("outcome"))


def issues(refs: DataFrame, transcripts: DataFrame, turns: DataFrame) -> DataFrame:
    """(id, source_ref_index, kind, transcript_id, turn_idx, span, turn_length), null where not known."""
    kind = F.col("outcome")
    return (
        classified_refs(refs, transcripts, turns)
        .where(kind.isin(*ISSUES))
        .select(
            "id", F.col("pos").alias("source_ref_index"), kind.alias("kind"), "transcript_id",
            F.when(kind != "missing_transcript", F.col("turn_idx")).alias("turn_idx"),
            F.when(kind == "invalid_span", F.col("span")).alias("span"),
            F.when(kind == "invalid_span", F.col("turn_length")).alias("turn_length"),
        )
    )


def segments(refs: DataFrame, turns: DataFrame) -> DataFrame:
    """(id, source_ref_index, transcript_id, turn_idx, role, span, text) of references that resolve."""
    single = refs.where("turn_idx is not null").join(turns, ["transcript_id", "turn_idx"]).where("span is null or span.end <= char_length(content)")
    cited = F.when(F.col("span").isNull(), F.col("content")).otherwise(F.substring("content", F.col("span.start") + 1, F.col("span.end") - F.col("span.start")))
    whole = refs.where("turn_idx is null").drop("turn_idx", "span").join(turns, "transcript_id")
    columns = ["id", F.col("pos").alias("source_ref_index"), "transcript_id", "turn_idx", "role"]
    return single.select(*columns, "span", cited.alias("text")).unionByName(
        whole.select(*columns, F.lit(None).cast("struct<start:int,end:int>").alias("span"), F.col("content").alias("text"))
    )


def _place() -> list[Column]:
    """The canonical order of segments; no span comes first."""
    return [
        F.col("transcript_id"), F.col("turn_idx"), F.coalesce(F.col("span.start"), F.lit(-1)).alias("span_start"), F.coalesce(F.col("span.end"), F.lit(-1)).alias("span_end"),
    ]


def unique_segments(found: DataFrame) -> DataFrame:
    """Distinct (transcript, turn, span, text, role) per memory, with the first reference's index."""
    keys = ["id", "transcript_id", "turn_idx", "span", "text", "role"]
    return found.groupBy(*keys).agg(F.min("source_ref_index").alias("source_ref_index"), F.count(F.lit(1)).alias("copies"))


def composed(found: DataFrame) -> DataFrame:
    """Per memory with segments: premise (texts in canonical order, a line feed between), the counts, and
    the coordinates [{role, span, transcript_id, turn_idx}] in that order."""
    item = F.struct(*_place(), "source_ref_index", "role", "text", "span", "copies")
    grouped = unique_segments(found).groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    span = lambda x: F.when(x["span"].isNotNull(), F.array(x["span"]["start"], x["span"]["end"]))
    return grouped.select(
        "id",
        F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("premise"),
        F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + x["copies"]).alias("segment_count"),
        F.size("s").alias("unique_segment_count"),
        F.transform("s", lambda x: F.struct(x["role"].alias("role"), span(x).alias("span"), x["transcript_id"].alias("transcript_id"), x["turn_idx"].alias("turn_idx"))).alias("coordinates"),
    )
