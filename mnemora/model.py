"""Schemas of the audit's relations, and the fixed values of its results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

REF = "struct<transcript_id:string,turn_idx:int,span:struct<start:int,end:int>>"
SCOPE = "struct<user_id:string,agent_id:string,session_id:string>"

#: Relations. Times are kept as text too, since results compare them as written, offset included.
MEMORIES = (
    f"id string, content string, created_at timestamp, created_at_text string, updated_at timestamp, updated_at_text string, "
    f"source_refs array<{REF}>, provenance_status string, scope {SCOPE}, active boolean, supersedes array<string>, embedding array<double>, raw string"
)
TRANSCRIPTS = "transcript_id string"
TURNS = "transcript_id string, turn_idx int, role string, content string"
RULES = "rule_idx int, dimension string, source_principal string, destination_principal string"
HIT = "struct<memory_id:string,rank:int,score:double>"
OBSERVATIONS = (
    f"request_id string, query_sha256 string, expected_memory_ids array<string>, top_k int, retriever_id string, retriever_version string, "
    f"hits array<{HIT}>, retrieval_calls bigint, candidate_count bigint"
)
EVIDENCE = "struct<kind:string,message:string,data:string>"
FINDINGS = (
    "checker_id string, checker_version string, rule_id string, rule_version string, severity string, defect_class string, "
    f"finding_id string, memory_ids array<string>, confidence double, evidence array<{EVIDENCE}>"
)
STATS = "checker_id string, memories_scanned bigint, findings_emitted bigint, details map<string,bigint>, model_calls bigint, input_tokens bigint, output_tokens bigint"

SCOPE_DIMENSIONS = ("user_id", "agent_id", "session_id")

# Schema versions, enumerations and rule metadata of the result format.
SCHEMA_VERSION = "0.1"
CHECKER_RESULT_SCHEMA = "0.3"
MANIFEST_SCHEMA = "1.1"
TAXONOMY_VERSION = "1.1"
PROVENANCE_STATUSES = ("declared", "known_absent", "unavailable")
DEFECT_CLASSES = (
    "orphaned_provenance", "redundancy_bloat", "stale_active", "privacy_scope_violation", "unsupported_claim", "internal_contradiction", "retrieval_shadowing", "injected_instruction",
)
SEVERITIES = ("info", "warning", "error")


@dataclass(frozen=True)
class Rule:
    checker_id: str
    checker_version: str
    rule_id: str
    rule_version: str
    severity: str

    @property
    def defect_class(self) -> str:
        return self.checker_id


RULES_BY_CHECKER = {
    r.checker_id: r
    for r in (
        Rule("orphaned_provenance", "1.0", "memory.provenance.orphaned", "1.0.0", "error"),
        Rule("redundancy_bloat", "3.0", "memory.duplication.equivalent-content", "1.0.0", "warning"),
        Rule("stale_active", "2.0", "memory.state.explicit-stale", "2.0.0", "error"),
        Rule("privacy_scope_violation", "2.0", "memory.scope.prohibited-replica", "1.0.0", "error"),
        Rule("unsupported_claim", "1.0", "memory.claim.unsupported", "1.0.0", "error"),
        Rule("retrieval_shadowing", "1.0", "memory.retrieval.shadowing", "1.0.0", "error"),
    )
}
#: The checkers of an aggregate audit, in the order of its report, and what each needs.
PUBLIC_CHECKERS = ("orphaned_provenance", "redundancy_bloat", "stale_active", "privacy_scope_violation", "unsupported_claim")
REQUIREMENTS = {
    "orphaned_provenance": ("transcripts",),
    "redundancy_bloat": (),
    "stale_active": (),
    "privacy_scope_violation": ("scope_policy",),
    "unsupported_claim": ("transcripts", "semantic_judge"),
}
SKIP_REASONS = {"transcripts": "missing_transcripts", "scope_policy": "missing_scope_policy", "semantic_judge": "missing_semantic_configuration"}

# What each source can tell, as the capability report states it.
CAPABILITY_FACETS = ("provenance", "created_at", "updated_at", "active_state", "supersession", "user_scope", "agent_scope", "session_scope", "embeddings")
CAPABILITIES = {
    "file": {
        "provenance": "supported",
        "created_at": "supported",
        "updated_at": "supported",
        "active_state": "supported",
        "supersession": "supported",
        "user_scope": "supported",
        "agent_scope": "supported",
        "session_scope": "supported",
        "embeddings": "supported",
    },
    "mem0": {
        "provenance": "conditional",
        "created_at": "supported",
        "updated_at": "supported",
        "active_state": "conditional",
        "supersession": "conditional",
        "user_scope": "supported",
        "agent_scope": "supported",
        "session_scope": "supported",
        "embeddings": "conditional",
    },
    "graphiti": {
        "provenance": "conditional",
        "created_at": "supported",
        "updated_at": "unsupported",
        "active_state": "supported",
        "supersession": "unsupported",
        "user_scope": "conditional",
        "agent_scope": "conditional",
        "session_scope": "conditional",
        "embeddings": "conditional",
    },
    "letta": {
        "provenance": "conditional",
        "created_at": "supported",
        "updated_at": "supported",
        "active_state": "supported",
        "supersession": "unsupported",
        "user_scope": "conditional",
        "agent_scope": "conditional",
        "session_scope": "unsupported",
        "embeddings": "conditional",
    },
}


def empty(spark: SparkSession, schema: str):
    return spark.createDataFrame([], schema)
