"""Provenance of memories as they arrive: the check that needs no other memory.

Appended memories join static transcripts, so nothing is kept between batches. The checks that compare
memories with each other are not monotonic; they are run over the whole store again (`on_each_batch`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.evidence import ISSUES, source_refs


def streamed_issues(memories: DataFrame, transcripts: DataFrame, turns: DataFrame) -> DataFrame:
    """(id, source_ref_index, kind, transcript_id, turn_idx) of a stream of memories."""
    refs = source_refs(memories)
    known = transcripts.select("transcript_id", F.lit(True).alias("known"))
    lengths = turns.select("transcript_id", "turn_idx", F.char_length("content").alias("turn_length"))
    kind = (
        F.when(F.col("known").isNull(), ISSUES[0])
        .when(F.col("turn_idx").isNotNull() & F.col("turn_length").isNull(), ISSUES[1])
        .when(F.col("span.end") > F.col("turn_length"), ISSUES[2])
    )
    found = refs.join(known, "transcript_id", "left").join(lengths, ["transcript_id", "turn_idx"], "left").withColumn("kind", kind)
    return found.where("kind is not null").select("id", F.col("pos").alias("source_ref_index"), "kind", "transcript_id", "turn_idx")


def on_each_batch(stream: DataFrame, store_path: str, check: Callable[[DataFrame], None]) -> DataStreamWriter:
    """Appends each batch to the store and checks the store as a whole."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store_path}/batch={batch_id}")  # a replayed batch replaces itself
        check(batch.sparkSession.read.parquet(store_path).drop("batch"))

    return stream.writeStream.foreachBatch(run)
