"""Aggregate audit, preflight, capabilities, JSON and SARIF output, and the severity gate."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions.ids import json_of
from ..functions.judges import Judge
from ..model import (
    CAPABILITIES, CAPABILITY_FACETS, CHECKER_RESULT_SCHEMA, FINDINGS, PUBLIC_CHECKERS, REQUIREMENTS, RULES_BY_CHECKER, Rule, SCHEMA_VERSION, SCOPE_DIMENSIONS, SEVERITIES, SKIP_REASONS, STATS, empty,
)
from ..operators import checks as ck
from ..scratch import written

TOOL = "Mnemora"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
SARIF_LEVELS = {"info": "note", "warning": "warning", "error": "error"}


class InputError(ValueError):
    """A check lacks an input that it needs."""


# --- checks by name -------------------------------------------------------------------------------


@dataclass
class Inputs:
    """transcripts is (transcripts, turns)."""

    memories: DataFrame
    transcripts: tuple[DataFrame, DataFrame] | None = None
    rules: DataFrame | None = None
    judge: Judge | None = None

    def missing(self, checker_id: str) -> list[str]:
        has = {"transcripts": self.transcripts is not None, "scope_policy": self.rules is not None, "semantic_judge": self.judge is not None}
        return [SKIP_REASONS[x] for x in REQUIREMENTS[checker_id] if not has[x]]


#: Checks of the caller, by id; they run by name but are no part of an aggregate audit.
_CUSTOM: dict[str, Callable[[Inputs], ck.CheckResult]] = {}


def register_check(rule: Rule, check: Callable[[Inputs], ck.CheckResult]) -> None:
    """Adds a check with metadata of its own. Built-in ids and their metadata cannot be replaced."""
    if rule.checker_id in REQUIREMENTS or rule.checker_id == "retrieval_shadowing":
        raise InputError(f"{rule.checker_id} is built in")
    if not rule.checker_id.strip() or not rule.checker_version.strip() or rule.severity not in SEVERITIES:
        raise InputError("a check needs an id, a version and a known severity")
    if not re.fullmatch(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", rule.rule_id) or not re.fullmatch(r"(?:0|[1-9]\d*)(?:\.(?:0|[1-9]\d*)){2}", rule.rule_version):
        raise InputError("a rule needs a dotted lower-case id and a numeric version of three parts")
    RULES_BY_CHECKER[rule.checker_id] = rule
    _CUSTOM[rule.checker_id] = check


def run_check(checker_id: str, inputs: Inputs) -> ck.CheckResult:
    if checker_id in _CUSTOM:
        return _CUSTOM[checker_id](inputs)
    if checker_id not in REQUIREMENTS:
        raise InputError(f"unknown checker {checker_id!r}")
    if missing := inputs.missing(checker_id):
        raise InputError(f"{checker_id}: {', '.join(missing)}")
    m = inputs.memories
    match checker_id:
        case "orphaned_provenance":
            return ck.orphaned_provenance(m, *inputs.transcripts)
        case "redundancy_bloat":
            return ck.redundancy_bloat(m)
        case "stale_active":
            return ck.stale_active(m)
        case "privacy_scope_violation":
            return ck.privacy_scope_violation(m, inputs.rules)
        case "unsupported_claim":
            return ck.unsupported_claim(m, *inputs.transcripts, inputs.judge)
    raise AssertionError(checker_id)


@dataclass
class Audit:
    """Every public check either has a result or is skipped, in the report's order."""

    results: list[ck.CheckResult]
    skipped: list[dict] = field(default_factory=list)
    spark: SparkSession | None = None

    @property
    def findings(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [r.findings for r in self.results]) if self.results else empty(self.spark, FINDINGS)

    @property
    def stats(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [r.stats for r in self.results]) if self.results else empty(self.spark, STATS)


def audit(memories: DataFrame, *, transcripts: tuple[DataFrame, DataFrame] | None = None, rules: DataFrame | None = None, judge: Judge | None = None) -> Audit:
    """All public checks whose inputs are there. A check that fails raises; it never becomes a skip. What several checks
    read is written to the shared folder once."""
    transcripts = transcripts and tuple(map(written, transcripts))
    inputs = Inputs(written(memories), transcripts, rules, judge)
    skipped = [{"checker_id": c, "reasons": m} for c in PUBLIC_CHECKERS if (m := inputs.missing(c))]
    results = [run_check(c, inputs) for c in PUBLIC_CHECKERS if not inputs.missing(c)]
    return Audit(results, skipped, memories.sparkSession)


# --- preflight and capabilities -------------------------------------------------------------------


def preflight(memories: DataFrame, *, adapter: str, has_transcripts: bool = False, rules: DataFrame | None = None, has_judge: bool = False) -> DataFrame:
    """One row per public check: checker_id, status, total_memories, assessable_memories, limitations,
    blocked_reasons. All counts come from one pass over the memories; no check runs."""
    if not adapter.strip():
        raise ValueError("adapter must not be blank")
    facets = CAPABILITIES.get(adapter, {})
    dimensions = sorted(r["dimension"] for r in rules.select("dimension").distinct().collect()) if rules is not None else []
    own = [F.col(f"scope.{d}") for d in SCOPE_DIMENSIONS]
    all_there = reduce(lambda a, b: a & b, [F.col(f"scope.{d}").isNotNull() for d in dimensions], F.lit(True))
    counts = memories.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("provenance_status") == "declared").alias("declared"), F.count_if(F.coalesce(*own).isNotNull()).alias("scoped"),
        F.count_if(F.col("active").isNotNull()).alias("active"), F.count_if(all_there).alias("policy"),
    )
    unsupported = lambda *names: any(facets.get(x) == "unsupported" for x in names)
    scope_facets = [d.replace("_id", "_scope") for d in dimensions]
    plan = {
        "orphaned_provenance": ("declared", "non_declared_provenance", None),
        "redundancy_bloat": ("scoped", "unscoped_memories", None),
        "stale_active": ("active", "active_state_unavailable", "supersession_unsupported" if unsupported("supersession") else None),
        "privacy_scope_violation": ("policy", "policy_scope_unavailable", "policy_scope_unsupported" if unsupported(*scope_facets) else None),
        "unsupported_claim": ("declared", "non_declared_provenance", None),
    }
    has = {"transcripts": has_transcripts, "scope_policy": rules is not None, "semantic_judge": has_judge}
    rows = []
    for place, checker in enumerate(PUBLIC_CHECKERS):
        reasons = [SKIP_REASONS[x] for x in REQUIREMENTS[checker] if not has[x]]
        count, partly, never = plan[checker]
        limits = F.array().cast("array<string>") if reasons else F.array_compact(F.array(F.when(F.col(count) < F.col("n"), partly), F.lit(never).cast("string")))
        status = F.lit("blocked") if reasons else F.when(F.size(limits) > 0, "degraded").otherwise("ready")
        rows.append(F.struct(F.lit(place).alias("place"), F.lit(checker).alias("checker_id"), status.alias("status"), F.col("n").alias("total_memories"), (F.lit(0).cast("long") if reasons else F.col(count)).alias("assessable_memories"), limits.alias("limitations"), F.array(*map(F.lit, reasons)).cast("array<string>").alias("blocked_reasons")))
    return counts.select(F.inline(F.array(*rows))).drop("place")


def capabilities(spark: SparkSession, adapter: str | None = None) -> DataFrame:
    """(adapter, facet, state), of one source or all."""
    if adapter is not None and adapter not in CAPABILITIES:
        raise ValueError(f"unknown adapter {adapter!r}")
    rows = [(a, f, CAPABILITIES[a][f]) for a in CAPABILITIES if adapter in (None, a) for f in CAPABILITY_FACETS]
    return spark.createDataFrame(rows, "adapter string, facet string, state string")


def preflight_report(memories: DataFrame, *, adapter: str, **given) -> dict:
    facets = CAPABILITIES.get(adapter)
    rows = [r.asDict() for r in preflight(memories, adapter=adapter, **given).collect()]
    rows.sort(key=lambda r: PUBLIC_CHECKERS.index(r["checker_id"]))
    return {"schema_version": SCHEMA_VERSION, "adapter": adapter, "adapter_capabilities": facets and {"schema_version": SCHEMA_VERSION, "adapter": adapter, **facets}, "checks": rows}


# --- JSON -----------------------------------------------------------------------------------------


def render(value: object, indent: int | None = 2) -> str:
    text = json.dumps(value, ensure_ascii=False, indent=indent, sort_keys=True, allow_nan=False)
    return text + "\n" if indent is not None else text


def _ordered(findings: DataFrame) -> Iterator[Row]:
    return findings.orderBy("memory_ids", "finding_id").toLocalIterator()


def finding_dict(r: Row) -> dict:
    items = [{"kind": e["kind"], "message": e["message"], "data": json.loads(e["data"])} for e in r["evidence"]]
    return {"finding_id": r["finding_id"], "defect_class": r["defect_class"], "memory_ids": list(r["memory_ids"]), "confidence": r["confidence"], "evidence": items}


def result_dict(result: ck.CheckResult) -> dict:
    """A check's result as its report states it. Meant for reports of a size one file can hold; larger
    ones are written as tables."""
    rule, s = RULES_BY_CHECKER[result.checker_id], result.stats.first()
    details: dict = dict(s["details"])
    for name, rows in result.extra.items():
        details[name] = [r.asDict() for r in rows.orderBy(*rows.columns).toLocalIterator()]
    return {
        "schema_version": CHECKER_RESULT_SCHEMA, "checker_id": rule.checker_id, "checker_version": rule.checker_version, "rule_id": rule.rule_id, "rule_version": rule.rule_version,
        "severity": rule.severity, "defect_class": rule.defect_class, "findings": [finding_dict(r) for r in _ordered(result.findings)],
        "cost": {k: s[k] for k in ("model_calls", "input_tokens", "output_tokens")},
        "stats": {"memories_scanned": s["memories_scanned"], "findings_emitted": s["findings_emitted"], "details": details},
    }


def audit_dict(report: Audit) -> dict:
    return {"schema_version": SCHEMA_VERSION, "results": [result_dict(r) for r in report.results], "skipped": report.skipped}


# --- SARIF ----------------------------------------------------------------------------------------


def sarif_results(findings: DataFrame, rule_index: int) -> DataFrame:
    """(memory_ids, finding_id, result): each finding as a SARIF result in JSON, rendered in parallel."""
    level = F.create_map(*[F.lit(x) for pair in SARIF_LEVELS.items() for x in pair])
    location = F.transform("memory_ids", lambda m: F.struct(F.array(F.struct(F.lit("memory").alias("kind"), m.alias("name"))).alias("logicalLocations")))
    items = F.transform("evidence", lambda e: F.struct(F.parse_json(e["data"]).alias("data"), e["kind"].alias("kind"), e["message"].alias("message")))
    properties = F.struct(
        "checker_id", F.lit(CHECKER_RESULT_SCHEMA).alias("checker_result_schema"), "checker_version", "confidence", "defect_class", items.alias("evidence"), "finding_id", "memory_ids", "rule_version", "severity"
    )
    text = json_of(
        fingerprints=F.struct(F.col("finding_id").alias("mnemoraFindingId")), level=F.element_at(level, F.col("severity")), locations=location,
        message=F.struct(F.array_join(F.transform("evidence", lambda e: e["message"]), "; ").alias("text")), properties=properties, ruleId=F.col("rule_id"), ruleIndex=F.lit(rule_index),
    )
    return findings.select("memory_ids", "finding_id", text.alias("result"))


def _sarif_rule(checker_id: str) -> dict:
    r = RULES_BY_CHECKER[checker_id]
    properties = {"rule_version": r.rule_version, "checker_id": r.checker_id, "checker_version": r.checker_version, "defect_class": r.defect_class, "severity": r.severity}
    return {"id": r.rule_id, "defaultConfiguration": {"level": SARIF_LEVELS[r.severity]}, "properties": properties}


def sarif(results: list[ck.CheckResult], skipped: list[dict] | None = None) -> dict:
    """One run; a rule's index is its place among the completed checks."""
    found = [json.loads(r["result"]) for k, x in enumerate(results) for r in sarif_results(x.findings, k).orderBy("memory_ids", "finding_id").toLocalIterator()]
    run = {"tool": {"driver": {"name": TOOL, "version": __version__, "rules": [_sarif_rule(x.checker_id) for x in results]}}, "results": found}
    if skipped is not None:
        run["properties"] = {"audit_report_schema": SCHEMA_VERSION, "skipped": skipped}
    return {"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [run]}


# --- gate and files -------------------------------------------------------------------------------


def gate(results: list[ck.CheckResult], threshold: str | None) -> bool:
    """Whether a check of the threshold's severity or above found anything; skips and confidence do not
    count."""
    if threshold is None:
        return False
    least = SEVERITIES.index(threshold)
    return any(SEVERITIES.index(RULES_BY_CHECKER[r.checker_id].severity) >= least and not r.findings.isEmpty() for r in results)


def write_text(text: str, output: str | Path, *inputs: str | Path | None) -> None:
    """Writes a report; it never replaces one of its inputs."""
    target = Path(output).resolve()
    if any(x is not None and Path(x).resolve() == target for x in inputs):
        raise InputError(f"output would overwrite an input: {output}")
    target.write_text(text, encoding="utf-8")
