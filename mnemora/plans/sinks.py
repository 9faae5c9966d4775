"""Single-file JSON of stores, transcripts and reports; larger stores are written as tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical
from ..model import SCHEMA_VERSION
from ..operators import evidence as ev
from ..operators.checks import canonical_policy


def memory_dict(r, include_raw: bool = False) -> dict:
    ref = lambda x: {"transcript_id": x["transcript_id"], "turn_idx": x["turn_idx"], "span": x["span"] and [x["span"]["start"], x["span"]["end"]]}
    out = {
        "id": r["id"], "content": r["content"], "created_at": r["created_at_text"], "updated_at": r["updated_at_text"], "source_refs": [ref(x) for x in r["source_refs"]],
        "provenance_status": r["provenance_status"], "scope": r["scope"].asDict(), "active": r["active"], "supersedes": list(r["supersedes"]), "embedding": r["embedding"] and list(r["embedding"]),
    }
    return out | ({"raw": json.loads(r["raw"] or "{}")} if include_raw else {})


def store_lines(memories: DataFrame, adapter: str, exported_at: str | None = None, include_raw: bool = False) -> Iterator[str]:
    """A store as JSON text, records by id, a line each; rows stream from the cluster."""
    yield f'{{\n  "adapter": {json.dumps(adapter, ensure_ascii=False)},\n  "exported_at": {json.dumps(exported_at)},\n  "memories": ['
    first = True
    for r in (memories if include_raw else memories.drop("raw")).orderBy("id").toLocalIterator():
        yield ("\n    " if first else ",\n    ") + json.dumps(memory_dict(r, include_raw), ensure_ascii=False, sort_keys=True, allow_nan=False)
        first = False
    yield ("]" if first else "\n  ]") + f',\n  "schema_version": "{SCHEMA_VERSION}"\n}}\n'


def write_store(memories: DataFrame, adapter: str, output: str, **options) -> None:
    with open(output, "w", encoding="utf-8") as out:
        out.writelines(store_lines(memories, adapter, **options))


def _text(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False) + "\n"


def transcripts_lines(transcripts: DataFrame, turns: DataFrame) -> Iterator[str]:
    """A transcript set as JSON text, a transcript a line, by id; rows stream from the cluster."""
    optional = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
    turn = F.struct("turn_idx", "role", "content", optional(turns, "timestamp_text"), optional(turns, "metadata"))
    grouped = transcripts.select("transcript_id", optional(transcripts, "metadata")).join(turns.groupBy("transcript_id").agg(F.array_sort(F.collect_list(turn)).alias("t")), "transcript_id", "left")
    free = lambda x: json.loads(x) if x else {}
    yield f'{{\n  "schema_version": "{SCHEMA_VERSION}",\n  "transcripts": ['
    first = True
    for r in grouped.orderBy("transcript_id").toLocalIterator():
        items = [{"index": t["turn_idx"], "role": t["role"], "content": t["content"], "timestamp": t["timestamp_text"], "metadata": free(t["metadata"])} for t in r["t"] or []]
        yield ("\n    " if first else ",\n    ") + json.dumps({"id": r["transcript_id"], "metadata": free(r["metadata"]), "turns": items}, ensure_ascii=False, sort_keys=True, allow_nan=False)
        first = False
    yield ("]" if first else "\n  ]") + "\n}\n"


def write_transcripts(transcripts: DataFrame, turns: DataFrame, output: str) -> None:
    with open(output, "w", encoding="utf-8") as out:
        out.writelines(transcripts_lines(transcripts, turns))


def policy_json(rules: DataFrame) -> str:
    """A scope policy in canonical form: rules of one source merged, in order. Policies are small by nature."""
    merged = canonical_policy(rules).orderBy("dimension", "source_principal").toLocalIterator()
    found = [{"dimension": r["dimension"], "authoritative_source_principal": r["source_principal"], "prohibited_destination_principals": list(r["destination_principals"])} for r in merged]
    return _text({"schema_version": SCHEMA_VERSION, "rules": found})


def observation_lines(observations: DataFrame) -> Iterator[str]:
    """Recorded retrievals as JSON lines, canonical, by request; the query itself is not part of them."""
    for r in observations.orderBy("request_id").toLocalIterator():
        hits = [h.asDict() for h in sorted(r["hits"], key=lambda h: h["rank"])]
        known = {k: r[k] for k in ("request_id", "query_sha256", "top_k", "retriever_id", "retriever_version")}
        usage = {"retrieval_calls": r["retrieval_calls"], "candidate_count": r["candidate_count"]}
        yield canonical(known | {"expected_memory_ids": sorted(r["expected_memory_ids"]), "hits": hits, "usage": usage}) + "\n"


def assessment_lines(cases: DataFrame) -> Iterator[str]:
    """retrieval_sufficiency() as JSON lines, canonical, by request, without query, scores or usage."""
    for r in cases.select("request_id", "query_sha256", "policy", "expected", "retrieved", "missing", "sufficient").orderBy("request_id").toLocalIterator():
        named = {"expected_memory_ids": list(r["expected"]), "retrieved_expected_memory_ids": list(r["retrieved"]), "missing_expected_memory_ids": list(r["missing"])}
        yield canonical({"request_id": r["request_id"], "query_sha256": r["query_sha256"], "policy": r["policy"], "sufficient": r["sufficient"], **named}) + "\n"


def resolution_lines(memories: DataFrame, transcripts: DataFrame, turns: DataFrame) -> Iterator[str]:
    """Resolved evidence as JSON lines, canonical: per declared memory its segments and issues, in order."""
    refs = ev.source_refs(memories)
    place = F.coalesce(F.col("span.start"), F.lit(-1)).alias("start"), F.coalesce(F.col("span.end"), F.lit(-1)).alias("end")
    segment = F.struct("transcript_id", "turn_idx", *place, "source_ref_index", "role", "text")
    segments = ev.segments(refs, turns).groupBy("id").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    issue = F.struct("source_ref_index", "kind", "transcript_id", "turn_idx")
    issues = ev.issues(refs, transcripts, turns).groupBy("id").agg(F.array_sort(F.collect_list(issue)).alias("issues"))
    declared = memories.where("provenance_status = 'declared'").select("id").join(segments, "id", "left").join(issues, "id", "left")
    span = lambda x: None if x["start"] < 0 else [x["start"], x["end"]]
    for r in declared.orderBy("id").toLocalIterator():
        parts = [{"source_ref_index": x["source_ref_index"], "transcript_id": x["transcript_id"], "turn_idx": x["turn_idx"], "role": x["role"], "span": span(x), "text": x["text"]} for x in r["segments"] or []]
        yield canonical({"memory_id": r["id"], "segments": parts, "issues": [x.asDict() for x in r["issues"] or []]}) + "\n"


def write_tables(findings: DataFrame, stats: DataFrame, folder: str) -> None:
    """The scalable form of a report: Parquet tables."""
    findings.write.mode("overwrite").partitionBy("checker_id").parquet(f"{folder}/findings")
    stats.write.mode("overwrite").parquet(f"{folder}/stats")
