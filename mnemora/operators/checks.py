"""The six checks as plans: relations in, findings and statistics out.

Findings have the columns of `model.FINDINGS`; statistics one row of `model.STATS`. No text of a memory or
transcript leaves a plan, only hashes, lengths and coordinates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import evidence_item, finding_head, finding_id, finding_name, json_of, json_string
from ..functions.judges import Judge, identity, with_judgment
from ..functions.text import is_blank, with_folded
from ..model import RULES_BY_CHECKER, SCOPE_DIMENSIONS
from ..scratch import written
from . import evidence as ev
from .cycles import supersession_cycles

# The message of each kind of evidence.
MESSAGES = {
    "missing_transcript": "Referenced transcript does not exist.",
    "missing_turn": "Referenced transcript turn does not exist.",
    "invalid_span": "Referenced character span exceeds the transcript turn.",
    "exact_duplicate": "Memories contain identical content in the same observable scope.",
    "normalized_duplicate": "Memories contain equivalent content once normalized in the same observable scope.",
    "active_superseded": "Memory remains active despite an explicit supersession relationship.",
    "supersession_cycle": "Memories supersede each other in a cycle, so no record is the unambiguous replacement.",
    "prohibited_scope_replica": "A replica of an authoritative-source memory claim exists in a prohibited principal scope.",
    "declared_evidence_not_entailing": "Declared transcript evidence does not entail the stored memory claim under the configured semantic judge.",
    "insufficient_retrieval": "Recorded retrieval did not satisfy the declared target sufficiency policy.",
}


@dataclass
class CheckResult:
    """findings and stats are lazy; extra holds relations that the report also states."""

    checker_id: str
    findings: DataFrame
    stats: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)


def _findings(df: DataFrame, checker_id: str, confidence: Column | None = None) -> DataFrame:
    """df has memory_ids (sorted) and items (evidence items in any order)."""
    r = RULES_BY_CHECKER[checker_id]
    df = df.withColumn("items", F.array_sort("items"))
    return df.select(
        F.lit(checker_id).alias("checker_id"), F.lit(r.checker_version).alias("checker_version"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.rule_version).alias("rule_version"),
        F.lit(r.severity).alias("severity"), F.lit(r.defect_class).alias("defect_class"),
        finding_id(checker_id, r.checker_version, r.defect_class, F.col("items"), F.col("memory_ids")).alias("finding_id"),
        "memory_ids", (F.lit(1.0) if confidence is None else confidence).alias("confidence"),
        F.transform("items", lambda x: F.struct(x["kind"].alias("kind"), x["message"].alias("message"), x["data"].alias("data"))).alias("evidence"),
    )


def _stats(df: DataFrame, checker_id: str, scanned: Column, emitted: Column, details: dict[str, Column], usage: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """df is one row that holds what the columns need."""
    pairs = [x for name, c in details.items() for x in (F.lit(name), c.cast("long"))]
    usage = usage or (F.lit(0),) * 3
    return df.select(
        F.lit(checker_id).alias("checker_id"), scanned.cast("long").alias("memories_scanned"), emitted.cast("long").alias("findings_emitted"), F.create_map(*pairs).alias("details"),
        *(c.cast("long").alias(n) for c, n in zip(usage, ("model_calls", "input_tokens", "output_tokens"), strict=True)),
    )


def _count(condition: Column | None = None) -> Column:
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)


def _together(*one_row: DataFrame) -> DataFrame:
    """One row of several frames of one row each."""
    first, *rest = (d.withColumn("__one", F.lit(1)) for d in one_row)
    for d in rest:
        first = first.join(F.broadcast(d), "__one")
    return first.drop("__one")


# --- unresolvable provenance ----------------------------------------------------------------------


def orphan_issues(memories: DataFrame, transcripts: DataFrame, turns: DataFrame) -> DataFrame:
    return ev.issues(ev.source_refs(memories), transcripts, turns)


def orphaned_provenance(memories: DataFrame, transcripts: DataFrame, turns: DataFrame) -> CheckResult:
    name = "orphaned_provenance"
    found = orphan_issues(memories, transcripts, turns)
    kind, span = F.col("kind"), F.array("span.start", "span.end")
    index, transcript, turn = F.col("source_ref_index"), F.col("transcript_id"), F.col("turn_idx")
    data = (
        F.when(kind == "missing_transcript", json_of(source_ref_index=index, transcript_id=transcript))
        .when(kind == "missing_turn", json_of(source_ref_index=index, transcript_id=transcript, turn_idx=turn))
        .otherwise(json_of(source_ref_index=index, span=span, transcript_id=transcript, turn_idx=turn, turn_length=F.col("turn_length")))
    )
    message = F.coalesce(*[F.when(kind == k, MESSAGES[k]) for k in ev.ISSUES])
    grouped = found.groupBy("id").agg(F.collect_list(evidence_item(kind, message, data)).alias("items")).select(F.array("id").alias("memory_ids"), "items")
    scanned = memories.agg(_count().alias("n"), F.sum(F.when(F.col("provenance_status") == "declared", F.size("source_refs")).otherwise(0)).alias("refs"))
    emitted = found.agg(F.count_distinct("id").alias("emitted"))
    stats = _stats(_together(scanned, emitted), name, F.col("n"), F.col("emitted"), {"source_refs_scanned": F.coalesce("refs", F.lit(0))})
    return CheckResult(name, _findings(grouped, name), stats)


# --- duplicate claims -----------------------------------------------------------------------------


def scoped(memories: DataFrame) -> DataFrame:
    return memories.where(F.coalesce(*(F.col(f"scope.{d}") for d in SCOPE_DIMENSIONS)).isNotNull())


_GROUP = (*SCOPE_DIMENSIONS, "sha", "folded_length")


def _claims(memories: DataFrame) -> DataFrame:
    """(id, user_id, agent_id, session_id, sha, folded_length, exact) of memories with a scope."""
    rows = scoped(memories).select("id", "content", *(F.col(f"scope.{d}").alias(d) for d in SCOPE_DIMENSIONS))
    return with_folded(rows).select("id", *SCOPE_DIMENSIONS, F.sha2("folded", 256).alias("sha"), F.char_length("folded").alias("folded_length"), F.sha2("content", 256).alias("exact"))


def duplicate_groups(memories: DataFrame) -> DataFrame:
    """Groups of equivalent content in one scope, null parts of a scope equal: user_id, agent_id,
    session_id, sha (of the folded content), folded_length, memory_ids, n, is_exact."""
    grouped = _claims(memories).groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id")).alias("memory_ids"), (F.min("exact") == F.max("exact")).alias("is_exact"))
    return grouped.where("n >= 2")


def _duplicate_evidence() -> tuple[Column, Column, Column]:
    """Kind, message and data of a group's evidence."""
    kind = F.when(F.col("is_exact"), "exact").otherwise("normalized")
    scope = F.struct(*(F.col(d).alias(d) for d in sorted(SCOPE_DIMENSIONS)))
    data = json_of(match_kind=kind, normalized_content_length=F.col("folded_length"), normalized_content_sha256=F.col("sha"), scope=scope)
    message = F.when(F.col("is_exact"), MESSAGES["exact_duplicate"]).otherwise(MESSAGES["normalized_duplicate"])
    return F.concat(kind, F.lit("_duplicate")), message, data


def duplicate_members(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The findings of redundancy_bloat without lists of members, for groups that no row can hold: (finding_id, n, kind, message,
    data) and (finding_id, id), a row per member, as tables.

    A finding's id is a hash over the sorted ids of its group. Members are dealt by group and sorted by id within it, and a
    task hashes them as they pass; neither it nor the aggregation before it, which counts, ever holds a group. The
    ids of findings go back to the members by a join that adaptive execution splits where a group is hot."""
    kind, message, data = _duplicate_evidence()
    claims = written(_claims(memories))
    sizes = claims.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"), (F.min("exact") == F.max("exact")).alias("is_exact")).where("n >= 2")
    key = F.sha2(F.to_json(F.struct(*_GROUP)), 256).alias("key")
    groups = written(sizes.select(key, "n", kind.alias("kind"), message.alias("message"), data.alias("data")))
    head = finding_head("redundancy_bloat", RULES_BY_CHECKER["redundancy_bloat"])
    start = F.concat(F.lit(head), F.lit('{"data":'), F.col("data"), F.lit(',"kind":"'), F.col("kind"), F.lit('"}],"memory_ids":['))
    members = claims.select("id", key).join(groups.select("key"), "key")
    # a group's first row, before all ids, brings what its hash starts with
    streamed = members.select("key", F.lit(1).alias("place"), "id", json_string(F.col("id")).alias("text")).unionByName(groups.select("key", F.lit(0).alias("place"), F.lit("").alias("id"), start.alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = digest = None
        first = True
        for batch in batches:
            done = []
            for k, place, text in zip(batch.column("key").to_pylist(), batch.column("place").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if place == 0:
                    if key is not None:
                        done.append((key, finding_name(digest)))
                    key, digest, first = k, hashlib.sha256(text.encode()), True
                else:
                    digest.update((text if first else f",{text}").encode())
                    first = False
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["key", "finding_id"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (key, finding_name(digest))], ["key", "finding_id"])

    hashed = streamed.repartition("key").sortWithinPartitions("key", "place", "id").select("key", "place", "text").mapInArrow(run, "key string, finding_id string")
    named = written(hashed)
    return groups.join(named, "key").select("finding_id", "n", "kind", "message", "data"), members.join(named, "key").select("finding_id", "id")


def redundancy_bloat(memories: DataFrame) -> CheckResult:
    name = "redundancy_bloat"
    groups = duplicate_groups(memories)
    rows = groups.select("memory_ids", F.array(evidence_item(*_duplicate_evidence())).alias("items"))
    counts = groups.agg(_count().alias("groups"), _count(F.col("is_exact")).alias("exact"))
    everything = memories.agg(_count().alias("n"), _count(F.coalesce(*(F.col(f"scope.{d}") for d in SCOPE_DIMENSIONS)).isNull()).alias("unscoped"))
    details = {
        "eligible_memories": F.col("n") - F.col("unscoped"), "unscoped_memories_skipped": F.col("unscoped"), "duplicate_groups": F.col("groups"),
        "exact_duplicate_groups": F.col("exact"), "normalized_duplicate_groups": F.col("groups") - F.col("exact"),
    }
    return CheckResult(name, _findings(rows, name), _stats(_together(everything, counts), name, F.col("n"), F.col("groups"), details))


# --- superseded but active ------------------------------------------------------------------------


def supersession_links(memories: DataFrame) -> DataFrame:
    """(src, dst) for each supersession, dangling and self-links included."""
    return memories.select(F.col("id").alias("src"), F.explode("supersedes").alias("dst"))


def resolved_links(memories: DataFrame) -> DataFrame:
    """(src, dst, dst_active) of links to another, existing memory."""
    targets = memories.select(F.col("id").alias("dst"), F.col("active").alias("dst_active"))
    return supersession_links(memories).where("src <> dst").join(targets, "dst").select("src", "dst", "dst_active")


def dangling_links(memories: DataFrame) -> DataFrame:
    return supersession_links(memories).where("src <> dst").join(memories.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")


def cycle_members(memories: DataFrame) -> DataFrame:
    """(id, cycle, active) of each memory in a supersession cycle."""
    members = supersession_cycles(resolved_links(memories))
    return members.join(memories.select("id", "active"), "id")


def cycle_groups(members: DataFrame) -> DataFrame:
    """Per cycle: members and active_members, both sorted."""
    return members.groupBy("cycle").agg(
        F.sort_array(F.collect_list("id")).alias("members"), F.sort_array(F.collect_list(F.when(F.col("active"), F.col("id")))).alias("active_members")
    )


def direct_stale(memories: DataFrame, members: DataFrame) -> DataFrame:
    """(id, superseder) of active superseded memories outside cycles."""
    return resolved_links(memories).where("dst_active IS TRUE").select(F.col("dst").alias("id"), F.col("src").alias("superseder")).join(members.select("id"), "id", "left_anti")


def stale_active(memories: DataFrame) -> CheckResult:
    name = "stale_active"
    members = cycle_members(memories)
    groups = cycle_groups(members)
    cycle_data = json_of(active_members=F.col("active_members"), members=F.col("members"))
    cyclic = groups.where(F.size("active_members") > 0).select(
        F.col("members").alias("memory_ids"), F.array(evidence_item("supersession_cycle", MESSAGES["supersession_cycle"], cycle_data)).alias("items")
    )
    item = evidence_item("active_superseded", MESSAGES["active_superseded"], json_of(old_active=F.lit(True), superseding_memory_id=F.col("superseder")))
    direct = direct_stale(memories, members)
    by_memory = direct.groupBy("id").agg(F.collect_list(item).alias("items")).select(F.array("id").alias("memory_ids"), "items")
    links, dangling = supersession_links(memories), dangling_links(memories)
    row = _together(
        memories.agg(_count().alias("n")),
        links.agg(_count().alias("links"), _count(F.col("src") == F.col("dst")).alias("own")),
        dangling.agg(_count().alias("dangling")),
        groups.agg(_count().alias("cycles"), _count(F.size("active_members") > 0).alias("reported")),
        direct.agg(F.count_distinct("id").alias("direct")),
    )
    details = {
        "supersession_links_scanned": F.col("links"), "resolved_supersession_links": F.col("links") - F.col("own") - F.col("dangling"), "missing_targets_skipped": F.col("dangling"),
        "self_links_skipped": F.col("own"), "supersession_cycles": F.col("cycles"),
    }
    targets = dangling.select(F.col("src").alias("superseder_id"), F.col("dst").alias("missing_target_id"))
    stats = _stats(row, name, F.col("n"), F.col("direct") + F.col("reported"), details)
    return CheckResult(name, _findings(cyclic.unionByName(by_memory), name), stats, {"dangling_supersession_targets": targets})


# --- copies across a prohibited boundary ----------------------------------------------------------


def canonical_policy(rules: DataFrame) -> DataFrame:
    """Rules of one (dimension, source) merged: dimension, source_principal, destination_principals (sorted)."""
    return rules.groupBy("dimension", "source_principal").agg(F.sort_array(F.collect_set("destination_principal")).alias("destination_principals"))


_COMPARED = ("active", "content", "created_at_text", "embedding", "provenance_status", "source_refs", "supersedes", "updated_at_text")


def _portable(memories: DataFrame) -> DataFrame:
    """One row per memory, with the fields that a comparison needs: short ones as they are, lists and
    content as SHA-256."""
    lists = {"embedding", "source_refs", "supersedes"}
    value = lambda c: F.sha2("content", 256) if c == "content" else F.sha2(F.to_json(c), 256) if c in lists else F.col(c)
    fields = [value(c).alias(f"f_{c.removesuffix('_text')}") for c in _COMPARED]
    return memories.select("id", *fields, *(F.col(f"scope.{d}").alias(d) for d in SCOPE_DIMENSIONS), F.sha2("content", 256).alias("exact"), "content")


#: Parts of a principal's memories, which meet its rules apart.
SLOTS = 64


def principals(memories: DataFrame, policy: DataFrame) -> DataFrame:
    """(rule, is_source, id, principal, sha, …) of each memory that a merged rule makes a source or a
    destination. Only those are folded: the rules are met first, in a join that Spark broadcasts where the policy's principals
    are few by its own measure; where it does not, a principal's texts go to many tasks."""
    each = _portable(memories).select("*", F.explode(F.create_map(*[x for d in SCOPE_DIMENSIONS for x in (F.lit(d), F.col(d))])).alias("dimension", "principal")).where("principal is not null")
    sides = policy.select("dimension", F.col("source_principal").alias("rule"), F.explode(F.concat(F.array("source_principal"), F.array_except("destination_principals", F.array("source_principal")))).alias("principal"))
    each = each.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int"))
    sides = sides.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    met = each.join(sides, ["dimension", "principal", "slot"]).drop("slot")
    return with_folded(met).withColumn("sha", F.sha2("folded", 256)).drop("content", "folded").withColumn("is_source", F.col("principal") == F.col("rule"))


_CLAIM = ("dimension", "rule", "sha")
_FIELDS = tuple(f"f_{c.removesuffix('_text')}" for c in _COMPARED)


def _classed(found: DataFrame) -> DataFrame:
    """principals() with class: members of a claim's side that no comparison tells apart share it."""
    same = ("principal", "exact", *_FIELDS, *SCOPE_DIMENSIONS)
    return found.withColumn("class", F.sha2(F.to_json(F.struct("is_source", *same)), 256))


def replica_factors(found: DataFrame) -> DataFrame:
    """The replicas of principals() as pairs of classes: dimension, rule, sha, source_class, destination_class,
    destination_principal, match_kind, differing_fields, sources and destinations (how many members each class has). A claim that
    m sources and n destinations share in the same form is one row, and sources * destinations replicas."""
    keep = ("principal", "exact", *_FIELDS, *SCOPE_DIMENSIONS)
    classes = _classed(found).groupBy(*_CLAIM, "is_source", "class").agg(F.count(F.lit(1)).alias("n"), *(F.any_value(c).alias(c) for c in keep))
    side = lambda condition, name: classes.where(condition).select(*_CLAIM, *(F.col(c).alias(f"{name}_{c}") for c in ("class", "n", *keep)))
    pairs = side("is_source", "s").join(side("not is_source", "d"), list(_CLAIM))
    differs = lambda c: ~F.col(f"s_{c}").eqNullSafe(F.col(f"d_{c}"))
    parts = [F.when(differs(n), n.removeprefix("f_")) for n in _FIELDS] + [F.when(differs(d) & (F.col("dimension") != d), f"scope.{d}") for d in SCOPE_DIMENSIONS]
    return pairs.select(
        *_CLAIM, F.col("s_class").alias("source_class"), F.col("d_class").alias("destination_class"), F.col("d_principal").alias("destination_principal"),
        F.when(F.col("s_exact") == F.col("d_exact"), "exact").otherwise("normalized").alias("match_kind"), F.sort_array(F.array_compact(F.array(*parts))).alias("differing_fields"),
        F.col("s_n").alias("sources"), F.col("d_n").alias("destinations"),
    )


def _members(found: DataFrame, sources: bool) -> DataFrame:
    """(dimension, rule, sha, source_class and source_id, or destination_class and destination_id)."""
    name = "source" if sources else "destination"
    return _classed(found.where("is_source" if sources else "not is_source")).select(*_CLAIM, F.col("class").alias(f"{name}_class"), F.col("id").alias(f"{name}_id"))


def replicas(found: DataFrame) -> DataFrame:
    """Source and destination of each replica, from principals(): dimension, rule, source_id, destination_id,
    destination_principal, sha, match_kind, differing_fields. The factors, written out."""
    whole = replica_factors(found).join(_members(found, True), [*_CLAIM, "source_class"]).join(_members(found, False), [*_CLAIM, "destination_class"])
    return whole.select("dimension", "rule", "source_id", "destination_id", "destination_principal", "sha", "match_kind", "differing_fields")


def privacy_scope_violation(memories: DataFrame, rules: DataFrame) -> CheckResult:
    """Evidence is rendered once for all destinations of a class, since it does not name them; counts come from the factors."""
    name = "privacy_scope_violation"
    policy = canonical_policy(rules)
    found = written(principals(memories, policy))  # narrow: hashes and short fields, read by both sides and the counts
    factors = written(replica_factors(found))
    data = json_of(
        authoritative_source_memory_id=F.col("source_id"), authoritative_source_principal=F.col("rule"), destination_principal=F.col("destination_principal"), differing_fields=F.col("differing_fields"),
        match_kind=F.col("match_kind"), normalized_content_sha256=F.col("sha"), scope_dimension=F.col("dimension"),
    )
    item = evidence_item("prohibited_scope_replica", MESSAGES["prohibited_scope_replica"], data)
    rendered = factors.join(_members(found, True), [*_CLAIM, "source_class"]).groupBy(*_CLAIM, "destination_class").agg(F.collect_list(item).alias("items"))
    reached = _members(found, False)
    met = reached.join(rendered, [*_CLAIM, "destination_class"])
    grouped = met.groupBy("destination_id").agg(F.flatten(F.collect_list("items")).alias("items")).select(F.array("destination_id").alias("memory_ids"), "items")
    row = _together(
        memories.agg(_count().alias("n")), policy.agg(_count().alias("rules")),
        found.agg(_count(F.col("is_source")).alias("sources"), _count(~F.col("is_source")).alias("destinations")),
        factors.agg(F.coalesce(F.sum(F.col("sources") * F.col("destinations")), F.lit(0)).alias("matches")),
        reached.join(factors.select(*_CLAIM).distinct(), list(_CLAIM), "left_semi").agg(F.count_distinct("destination_id").alias("emitted")),
    )
    details = {"policy_rules_scanned": F.col("rules"), "authoritative_candidates": F.col("sources"), "destination_candidates": F.col("destinations"), "replica_matches": F.col("matches")}
    return CheckResult(name, _findings(grouped, name), _stats(row, name, F.col("n"), F.col("emitted"), details))


# --- claims that their evidence does not entail ---------------------------------------------------


def premises(memories: DataFrame, transcripts: DataFrame, turns: DataFrame) -> DataFrame:
    """Per declared memory: outcome (`assess`, `resolution_issues`, `no_evidence`) and its composed evidence."""
    refs = ev.source_refs(memories)
    broken = ev.issues(refs, transcripts, turns).select("id", F.lit(True).alias("broken")).distinct()
    whole = ev.composed(ev.segments(refs, turns))
    outcome = F.when(F.col("broken"), "resolution_issues").when(F.col("premise").isNull() | is_blank(F.col("premise")), "no_evidence").otherwise("assess")
    return memories.where("provenance_status = 'declared'").select("id", "content").join(broken, "id", "left").join(whole, "id", "left").withColumn("outcome", outcome).drop("broken")


def _paired(found: DataFrame) -> DataFrame:
    """premises() as a table, so that the evidence is joined once: texts only where they are assessed, hashes of them, and pair, which equal
    pairs of texts share; what is not assessed is a pair of its own."""
    assess = F.col("outcome") == "assess"
    shas = {f"{c}_sha": F.sha2(c, 256) for c in ("content", "premise")}
    pair = F.when(assess, F.sha2(F.concat_ws(":", "premise_sha", "content_sha"), 256)).otherwise(F.concat(F.lit("-"), F.col("id")))
    texts = [F.when(assess, F.col(c)).alias(c) for c in ("premise", "content")]
    return written(found.withColumns(shas).select("id", "outcome", pair.alias("pair"), *texts, "content_sha", "premise_sha", "coordinates", "unique_segment_count"))


def _answered(paired: DataFrame, judge: Judge) -> DataFrame:
    """_paired() without texts, with the judgment, null where nothing is assessed. Equal pairs of texts are judged once each."""
    texts = paired.where("outcome = 'assess'").groupBy("pair").agg(F.any_value("premise").alias("premise"), F.any_value("content").alias("content"))
    asked = with_judgment(texts, judge).select("pair", "judgment")
    failed = F.when(F.col("judgment.status") == "failed", F.raise_error(F.concat(F.lit("the semantic judgment failed for memory "), F.col("id")))).otherwise(F.col("judgment"))
    return paired.drop("premise", "content").join(asked, "pair", "left").withColumn("judgment", failed)


def judged(memories: DataFrame, transcripts: DataFrame, turns: DataFrame, judge: Judge) -> DataFrame:
    """premises() of outcome `assess`, without texts, with the judgment."""
    return _answered(_paired(premises(memories, transcripts, turns)), judge).where("outcome = 'assess'")


def unsupported_claim(memories: DataFrame, transcripts: DataFrame, turns: DataFrame, judge: Judge) -> CheckResult:
    name = "unsupported_claim"
    judge_id, judge_version = identity(judge)
    # the judge is asked once; only hashes of texts are kept
    everything = written(_answered(_paired(premises(memories, transcripts, turns)), judge))
    answers = everything.where("outcome = 'assess'")
    data = json_of(
        composition_style=F.lit("plain"), hypothesis_sha256=F.col("content_sha"), judge_id=F.lit(judge_id), judge_version=F.lit(judge_version), premise_sha256=F.col("premise_sha"),
        semantic_relation=F.col("judgment.relation"), source_coordinates=F.col("coordinates"), unique_segment_count=F.col("unique_segment_count"),
    )
    items = F.array(evidence_item("declared_evidence_not_entailing", MESSAGES["declared_evidence_not_entailing"], data)).alias("items")
    rows = answers.where("judgment.status = 'ok' and judgment.relation <> 'entailment'").select(F.array("id").alias("memory_ids"), items, F.col("judgment.score").alias("score"))
    relation = F.col("judgment.relation")
    row = _together(
        memories.agg(_count().alias("n"), _count(F.col("provenance_status") == "declared").alias("declared")),
        everything.agg(_count(F.col("outcome") == "resolution_issues").alias("issues"), _count(F.col("outcome") == "no_evidence").alias("nothing")),
        answers.agg(
            _count(F.col("judgment.status") == "too_long").alias("long"), _count(F.col("judgment.status") == "ok").alias("assessed"),
            *(_count(relation == r).alias(r) for r in ("entailment", "neutral", "contradiction")),
            *(F.coalesce(F.sum(f"judgment.{u}"), F.lit(0)).alias(u) for u in ("model_calls", "input_tokens", "output_tokens")),
        ),
    )
    details = {
        "declared_memories": F.col("declared"), "assessed_memories": F.col("assessed"), "skipped_non_declared_provenance": F.col("n") - F.col("declared"),
        "skipped_resolution_issues": F.col("issues"), "skipped_no_evidence": F.col("nothing"), "skipped_input_too_long": F.col("long"),
        **{f"{r}_judgments": F.col(r) for r in ("entailment", "neutral", "contradiction")},
    }
    stats = _stats(row, name, F.col("n"), F.col("neutral") + F.col("contradiction"), details, (F.col("model_calls"), F.col("input_tokens"), F.col("output_tokens")))
    return CheckResult(name, _findings(rows, name, F.col("score")), stats)


# --- expected records that retrieval missed -------------------------------------------------------

POLICIES = {"all": "all_expected", "any": "any_expected"}


def retrieval_sufficiency(observations: DataFrame, policy: str) -> DataFrame:
    """observations with expected, retrieved and missing (sorted) and sufficient, row by row."""
    if policy not in POLICIES.values():
        raise ValueError(f"unknown sufficiency policy {policy!r}")
    hit = F.transform("hits", lambda h: h["memory_id"])
    df = observations.withColumn("expected", F.sort_array("expected_memory_ids")).withColumn("retrieved", F.sort_array(F.array_intersect("expected", hit))).withColumn("missing", F.sort_array(F.array_except("expected", hit)))
    return df.withColumn("policy", F.lit(policy)).withColumn("sufficient", F.size("missing") == 0 if policy == "all_expected" else F.size("retrieved") > 0)


def retrieval_shadowing(observations: DataFrame, policy: str) -> CheckResult:
    """Findings over the missing records of each recorded case that its policy does not accept."""
    name = "retrieval_shadowing"
    cases = retrieval_sufficiency(observations, policy)
    data = json_of(
        expected_memory_ids=F.col("expected"), missing_expected_memory_ids=F.col("missing"), policy=F.col("policy"), query_sha256=F.col("query_sha256"), request_id=F.col("request_id"),
        retrieved_expected_memory_ids=F.col("retrieved"), retriever_id=F.col("retriever_id"), retriever_version=F.col("retriever_version"), top_k=F.col("top_k"),
    )
    rows = cases.where("not sufficient").select(F.col("missing").alias("memory_ids"), F.array(evidence_item("insufficient_retrieval", MESSAGES["insufficient_retrieval"], data)).alias("items"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    row = cases.agg(
        _count().alias("cases"), _count(~F.col("sufficient")).alias("emitted"), total(F.size("expected")).alias("e"), total(F.size("retrieved")).alias("r"), total(F.size("missing")).alias("m"),
        total("retrieval_calls").alias("calls"), total("candidate_count").alias("candidates"), total(F.size("hits")).alias("hits"),
    )
    details = {
        "retrieval_cases_assessed": F.col("cases"), "expected_targets": F.col("e"), "retrieved_expected_targets": F.col("r"), "missing_expected_targets": F.col("m"),
        "retrieval_calls": F.col("calls"), "candidate_count": F.col("candidates"), "hits_observed": F.col("hits"),
    }
    return CheckResult(name, _findings(rows, name), _stats(row, name, F.lit(0), F.col("emitted"), details))
