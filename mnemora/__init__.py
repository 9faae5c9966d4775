"""Audits persistent agent memory at scale, as Spark plans.

The names of `__all__` are the package's interface; they are imported when first used."""

from __future__ import annotations

from importlib import import_module
from typing import Any

__version__ = "0.1.0"

#: Public names by the module that has them.
_PUBLIC = {
    "cli": ("main",),
    "functions.ids": ("canonical", "finding_id_of", "short_hash"),
    "functions.judges": ("DependencyError", "InputTooLong", "Judge", "JudgeError", "Judgment", "LexicalJudge", "ModelConfigError", "ModelJudge", "identity", "softmax_relation"),
    "functions.text": ("fold", "with_folded"),
    "model": ("CAPABILITIES", "DEFECT_CLASSES", "FINDINGS", "MEMORIES", "OBSERVATIONS", "PUBLIC_CHECKERS", "RULES_BY_CHECKER", "Rule", "SCHEMA_VERSION", "STATS", "TAXONOMY_VERSION", "TURNS"),
    "operators.checks": (
        "CheckResult", "canonical_policy", "orphaned_provenance", "premises", "privacy_scope_violation", "redundancy_bloat", "retrieval_shadowing", "retrieval_sufficiency", "stale_active", "unsupported_claim",
    ),
    "operators.constraints": ("ConstraintError", "require_valid_memories"),
    "operators.evidence": ("composed", "issues", "segments", "source_refs"),
    "operators.mutations": ("Mutation", "PreconditionError", "Request", "mutate", "store_digest", "store_fingerprint"),
    "plans.report": ("Audit", "InputError", "Inputs", "audit", "audit_dict", "capabilities", "gate", "preflight", "preflight_report", "register_check", "result_dict", "run_check", "sarif"),
    "plans.sinks": ("assessment_lines", "observation_lines", "policy_json", "resolution_lines", "write_store", "write_tables", "write_transcripts"),
    "session": ("attach",),
    "sources.files": ("SourceError", "load_observations", "load_policy", "load_store", "load_transcripts", "read_export", "read_records", "store_envelope"),
    "sources.live": ("AuthenticationError", "Source", "graph_pages", "letta_pages", "live_records", "mem0_pages", "register_source", "scan"),
    "sources.normalize": ("file_records", "graphiti_records", "letta_records", "mem0_records"),
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted([*_HOME, "__version__"])


def __getattr__(name: str) -> Any:
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_HOME[name]}", __name__), name)


def __dir__() -> list[str]:
    return __all__
