"""Integrity constraints of the relations, as queries that return what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..model import PROVENANCE_STATUSES, SCOPE_DIMENSIONS


def _blank(c: Column) -> Column:
    return c.isNull() | is_blank(c)


def duplicate_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, n) of each id that occurs more than once."""
    return df.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _report(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in rules.items()]))
    return df.withColumn("violated", F.explode(broken)).withColumn("id", F.col(id_col))


def memory_violations(memories: DataFrame) -> DataFrame:
    """(id, violated) per memory and constraint that it breaks; uniqueness of ids is duplicate_ids'."""
    ref_bad = lambda r: (
        _blank(r["transcript_id"]) | (r["turn_idx"] < 0) | (r["span"]["start"] < 0) | (r["span"]["end"] <= r["span"]["start"]) | (r["span"].isNotNull() & r["turn_idx"].isNull())
    )
    scope = [F.col(f"scope.{d}") for d in SCOPE_DIMENSIONS]
    rules = {
        "id_blank": _blank(F.col("id")),
        "content_blank": _blank(F.col("content")),
        "supersedes_blank": F.exists("supersedes", _blank),
        "supersedes_repeated": F.size(F.array_distinct("supersedes")) != F.size("supersedes"),
        "supersedes_itself": F.array_contains("supersedes", F.col("id")),
        "provenance_unknown": ~F.col("provenance_status").isin(*PROVENANCE_STATUSES) | F.col("provenance_status").isNull(),
        "provenance_mismatch": (F.size(F.coalesce("source_refs", F.array())) > 0) != (F.col("provenance_status") == "declared"),
        "embedding_invalid": (F.size("embedding") == 0) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
        "source_ref_invalid": F.exists("source_refs", ref_bad),
        "scope_blank": F.coalesce(scope[0].isNotNull() & is_blank(scope[0]), F.lit(False)) | F.coalesce(scope[1].isNotNull() & is_blank(scope[1]), F.lit(False)) | F.coalesce(scope[2].isNotNull() & is_blank(scope[2]), F.lit(False)),
    }
    return _report(memories, "id", rules).select("id", "violated")


def turn_violations(turns: DataFrame) -> DataFrame:
    """Turns of blank role, negative index, or an index that their transcript has twice."""
    rules = {"role_blank": _blank(F.col("role")), "index_invalid": F.col("turn_idx").isNull() | (F.col("turn_idx") < 0)}
    twice = turns.groupBy("transcript_id", "turn_idx").count().where("count > 1").select(F.col("transcript_id").alias("id"), F.lit("index_repeated").alias("violated"))
    return _report(turns, "transcript_id", rules).select("id", "violated").unionByName(twice)


def observation_violations(observations: DataFrame) -> DataFrame:
    ids, ranks = F.transform("hits", lambda h: h["memory_id"]), F.transform("hits", lambda h: h["rank"])
    unique = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    rules = {
        "expected_invalid": F.col("expected_memory_ids").isNull() | (F.size("expected_memory_ids") == 0) | F.exists("expected_memory_ids", _blank) | ~unique(F.col("expected_memory_ids")),
        "ranks_invalid": F.exists(ranks, lambda r: r.isNull() | (r < 1)) | ~unique(ranks),
        "hit_ids_repeated": ~unique(ids),
        "hit_id_blank": F.exists(ids, _blank),
        "hits_missing": F.col("hits").isNull(),
        "more_hits_than_top_k": F.size("hits") > F.col("top_k"),
        "top_k_invalid": F.col("top_k").isNull() | (F.col("top_k") < 1),
        "query_hash_invalid": F.col("query_sha256").isNull() | ~F.col("query_sha256").rlike(r"\A[0-9a-f]{64}\z"),
        "usage_invalid": F.greatest(*(F.coalesce(F.col(c), F.lit(-1)) < 0 for c in ("retrieval_calls", "candidate_count"))),
        "identity_blank": _blank(F.col("request_id")) | _blank(F.col("retriever_id")) | _blank(F.col("retriever_version")),
        "score_invalid": F.exists("hits", lambda h: F.isnan(h["score"]) | (F.abs(h["score"]) == float("inf"))),
    }
    return _report(observations, "request_id", rules).select("id", "violated")


def rule_violations(rules: DataFrame) -> DataFrame:
    checks = {
        "dimension_unknown": ~F.col("dimension").isin("user_id", "agent_id") | F.col("dimension").isNull(),
        "principal_blank": _blank(F.col("source_principal")) | _blank(F.col("destination_principal")),
        "source_is_destination": F.col("source_principal") == F.col("destination_principal"),
    }
    return _report(rules, "source_principal", checks).select("id", "violated")


def finding_violations(findings: DataFrame) -> DataFrame:
    checks = {
        "class_mismatch": F.col("defect_class") != F.col("checker_id"),
        "confidence_invalid": F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1),
        "memories_invalid": (F.size("memory_ids") == 0) | ~F.col("memory_ids").eqNullSafe(F.sort_array(F.array_distinct("memory_ids"))),
        "evidence_empty": F.size("evidence") == 0,
        "rule_id_invalid": ~F.col("rule_id").rlike(r"\A[a-z0-9]+([.-][a-z0-9]+)*\z"),
        "rule_version_invalid": ~F.col("rule_version").rlike(r"\A(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)\z"),
    }
    repeated = duplicate_ids(findings, "finding_id").select("id", F.lit("id_repeated").alias("violated"))
    return _report(findings, "finding_id", checks).select("id", "violated").unionByName(repeated)


class ConstraintError(ValueError):
    """A relation breaks its constraints; the message names ids and constraints, never content."""


def require(name: str, violations: DataFrame, shown: int = 5) -> None:
    rows = violations.orderBy("id", "violated").limit(shown).collect()
    if rows:
        raise ConstraintError(f"{name}: " + "; ".join(f"{r['id']!r} {r['violated']}" for r in rows))


def require_valid_memories(memories: DataFrame) -> None:
    require("memories", memory_violations(memories))
    require("memory ids", duplicate_ids(memories).select("id", F.lit("id_repeated").alias("violated")))
