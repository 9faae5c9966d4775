"""The audit's queries over the derived views, and the SQL that gives the same rows.

Results are flat: arrays are joined to text, so that values compare whatever the engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import json_of
from ..functions.judges import LexicalJudge
from ..functions.text import is_blank, with_folded
from ..model import CAPABILITIES, CAPABILITY_FACETS, RULES_BY_CHECKER, SCHEMA_VERSION
from ..operators import checks as ck
from ..operators import constraints as co
from ..operators import evidence as ev
from ..operators import mutations as mu
from ..scratch import scratch_path, written
from ..sources import files, normalize
from . import report, views
from .views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str = "", *needs: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL over the views it needs."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *needs) if needs else sql
        return f

    return register


def _flat(findings: DataFrame) -> DataFrame:
    return findings.select("finding_id", F.array_join("memory_ids", ",").alias("memory_ids"), "severity", "rule_id", F.array_join(F.transform("evidence", lambda e: e["kind"]), ",").alias("kinds"), F.array_join(F.transform("evidence", lambda e: e["data"]), ",").alias("data"))


def _ids_sql(checker: str, items: str) -> str:
    """Findings of rows (ids: sorted list, items: list of {kind, data}) as SQL."""
    r = RULES_BY_CHECKER[checker]
    return f"""SELECT 'finding-' || substr(sha256('{{"checker_id":"{checker}","checker_version":"{r.checker_version}","defect_class":"{r.defect_class}","evidence":[' ||
  array_to_string(list_transform(items, lambda x: '{{"data":' || x.data || ',"kind":"' || x.kind || '"}}'), ',') || '],"memory_ids":["' || array_to_string(ids, '","') || '"]}}'), 1, 24) AS finding_id,
  array_to_string(ids, ',') AS memory_ids, '{r.severity}' AS severity, '{r.rule_id}' AS rule_id, array_to_string(list_transform(items, lambda x: x.kind), ',') AS kinds,
  array_to_string(list_transform(items, lambda x: x.data), ',') AS data
FROM ({items})"""


def _stat_rows(stats: DataFrame) -> DataFrame:
    return stats.select("memories_scanned", "findings_emitted", F.explode("details").alias("detail", "amount"))


def _number(path: str, name: str) -> F.Column:
    """A whole number, -1 where there is none."""
    return F.coalesce(F.col(path).cast("long"), F.lit(-1)).alias(name)


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.memories(spark, sf_dir)


def _transcripts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return views.transcripts(spark, sf_dir), views.turns(spark, sf_dir)


# --- provenance -----------------------------------------------------------------------------------


@query("SELECT id, pos AS source_ref_index, transcript_id, coalesce(turn_idx, -1) AS turn_idx, coalesce(span_start, -1) AS span_start, coalesce(span_end, -1) AS span_end, coalesce(turn_length, -1) AS turn_length, outcome FROM classified", "classified")
def q1_classified_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References against transcripts and turns."""
    found = ev.classified_refs(ev.source_refs(_memories(spark, sf_dir)), *_transcripts(spark, sf_dir))
    columns = ["transcript_id", _number("turn_idx", "turn_idx"), _number("span.start", "span_start"), _number("span.end", "span_end")]
    return found.select("id", F.col("pos").alias("source_ref_index"), *columns, _number("turn_length", "turn_length"), "outcome")


_ISSUE_KINDS = "outcome IN ('missing_transcript', 'missing_turn', 'invalid_span')"


@query(
    f"SELECT id, pos AS source_ref_index, outcome AS kind, transcript_id, coalesce(CASE WHEN outcome <> 'missing_transcript' THEN turn_idx END, -1) AS turn_idx, CASE WHEN outcome = 'invalid_span' THEN span_start ELSE -1 END AS span_start, "
    f"CASE WHEN outcome = 'invalid_span' THEN span_end ELSE -1 END AS span_end, CASE WHEN outcome = 'invalid_span' THEN turn_length ELSE -1 END AS turn_length FROM classified WHERE {_ISSUE_KINDS}",
    "classified",
)
def q1_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ck.orphan_issues(_memories(spark, sf_dir), *_transcripts(spark, sf_dir))
    return found.select("id", "source_ref_index", "kind", "transcript_id", _number("turn_idx", "turn_idx"), _number("span.start", "span_start"), _number("span.end", "span_end"), _number("turn_length", "turn_length"))


_C1_ITEMS = f"""SELECT [id] AS ids, list({{'kind': outcome, 'data': data}} ORDER BY '{{"data":' || data || ',"kind":"' || outcome || '"}}') AS items FROM (SELECT id, outcome, CASE outcome
  WHEN 'missing_transcript' THEN '{{"source_ref_index":' || pos || ',"transcript_id":"' || transcript_id || '"}}'
  WHEN 'missing_turn' THEN '{{"source_ref_index":' || pos || ',"transcript_id":"' || transcript_id || '","turn_idx":' || turn_idx || '}}'
  ELSE '{{"source_ref_index":' || pos || ',"span":[' || span_start || ',' || span_end || '],"transcript_id":"' || transcript_id || '","turn_idx":' || turn_idx || ',"turn_length":' || turn_length || '}}' END AS data
FROM classified WHERE {_ISSUE_KINDS}) GROUP BY id"""


@query(_ids_sql("orphaned_provenance", _C1_ITEMS), "classified")
def c1_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(ck.orphaned_provenance(_memories(spark, sf_dir), *_transcripts(spark, sf_dir)).findings)


@query(
    f"SELECT (SELECT count(*) FROM memories) AS memories_scanned, (SELECT count(DISTINCT id) FROM classified WHERE {_ISSUE_KINDS}) AS findings_emitted, 'source_refs_scanned' AS detail, (SELECT count(*) FROM refs) AS amount",
    "memories", "refs", "classified",
)
def c1_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stat_rows(ck.orphaned_provenance(_memories(spark, sf_dir), *_transcripts(spark, sf_dir)).stats)


@query("SELECT id, pos AS source_ref_index, transcript_id, turn_idx, role, coalesce(span_start, -1) AS span_start, coalesce(span_end, -1) AS span_end, length(text) AS chars, sha256(text) AS text_sha256 FROM segments", "segments")
def q1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that references cite."""
    found = ev.segments(ev.source_refs(_memories(spark, sf_dir)), views.turns(spark, sf_dir))
    return found.select("id", "source_ref_index", "transcript_id", _number("turn_idx", "turn_idx"), "role", _number("span.start", "span_start"), _number("span.end", "span_end"), F.char_length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


@query("SELECT id, outcome, coalesce(segment_count, 0) AS segment_count, coalesce(unique_segment_count, 0) AS unique_segment_count, sha256(premise) AS premise_sha256, coordinates FROM premises", "premises")
def q2_premises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed evidence and why a memory is not assessed."""
    found = ck.premises(_memories(spark, sf_dir), *_transcripts(spark, sf_dir))
    coordinates = F.when(F.col("coordinates").isNotNull(), F.to_json("coordinates", {"ignoreNullFields": "false"}))
    return found.select("id", "outcome", F.coalesce("segment_count", F.lit(0)).alias("segment_count"), F.coalesce("unique_segment_count", F.lit(0)).cast("long").alias("unique_segment_count"), F.sha2("premise", 256).alias("premise_sha256"), coordinates.alias("coordinates"))


# --- duplicates -----------------------------------------------------------------------------------

_C2_GROUPS = (
    "SELECT user_id, sha256(folded) AS sha, length(folded) AS folded_length, count(*) AS n, list(id ORDER BY id) AS ids, count(DISTINCT content) = 1 AS is_exact FROM folded WHERE user_id IS NOT NULL GROUP BY user_id, folded HAVING count(*) >= 2"
)


@query("SELECT id, sha256(folded) AS folded_sha256, length(folded) AS folded_length FROM folded", "folded")
def h1_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = with_folded(_memories(spark, sf_dir).select("id", "content"))
    return folded.select("id", F.sha2("folded", 256).alias("folded_sha256"), F.char_length("folded").cast("long").alias("folded_length"))


@query(f"SELECT user_id, sha, folded_length, n, array_to_string(ids, ',') AS memory_ids, is_exact FROM ({_C2_GROUPS})", "folded")
def c2_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.duplicate_groups(_memories(spark, sf_dir)).select("user_id", "sha", F.col("folded_length").cast("long").alias("folded_length"), "n", F.array_join("memory_ids", ",").alias("memory_ids"), "is_exact")


_C2_ITEMS = f"""SELECT ids, [{{'kind': k || '_duplicate', 'data': '{{"match_kind":"' || k || '","normalized_content_length":' || folded_length || ',"normalized_content_sha256":"' || sha ||
  '","scope":{{"agent_id":null,"session_id":null,"user_id":"' || user_id || '"}}}}'}}] AS items FROM (SELECT *, CASE WHEN is_exact THEN 'exact' ELSE 'normalized' END AS k FROM ({_C2_GROUPS}))"""


@query(_ids_sql("redundancy_bloat", _C2_ITEMS), "folded")
def c2_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(ck.redundancy_bloat(_memories(spark, sf_dir)).findings)


@query(f"SELECT finding_id, unnest(string_split(memory_ids, ',')) AS id FROM ({_ids_sql('redundancy_bloat', _C2_ITEMS)})", "folded")
def a1_duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of duplicate findings as rows, finding ids hashed from a sorted stream."""
    return ck.duplicate_members(_memories(spark, sf_dir))[1]


@query(f"SELECT finding_id, len(string_split(memory_ids, ','))::BIGINT AS n, kinds AS kind, data FROM ({_ids_sql('redundancy_bloat', _C2_ITEMS)})", "folded")
def a1_duplicate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate findings without their lists of members."""
    return ck.duplicate_members(_memories(spark, sf_dir))[0].select("finding_id", "n", "kind", "data")


def _details_sql(row: str, details: dict[str, str]) -> str:
    """A row per detail of one row that has memories_scanned and findings_emitted."""
    return " UNION ALL ".join(f"SELECT memories_scanned, findings_emitted, '{k}' AS detail, {v} AS amount FROM ({row})" for k, v in details.items())


@query(
    _details_sql(
        f"SELECT (SELECT count(*) FROM memories) AS memories_scanned, count(*) AS findings_emitted, (SELECT count(*) FROM memories WHERE user_id IS NULL) AS u, count(*) FILTER (WHERE is_exact) AS e FROM ({_C2_GROUPS})",
        {"eligible_memories": "memories_scanned - u", "unscoped_memories_skipped": "u", "duplicate_groups": "findings_emitted", "exact_duplicate_groups": "e", "normalized_duplicate_groups": "findings_emitted - e"},
    ),
    "folded",
)
def c2_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stat_rows(ck.redundancy_bloat(_memories(spark, sf_dir)).stats)


# --- supersession ---------------------------------------------------------------------------------


@query("SELECT src, dst, coalesce(dst_active::VARCHAR, 'unknown') AS dst_active FROM resolved", "resolved")
def j6_resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.resolved_links(_memories(spark, sf_dir)).withColumn("dst_active", F.coalesce(F.col("dst_active").cast("string"), F.lit("unknown")))


@query("SELECT src AS superseder_id, dst AS missing_target_id FROM links WHERE src <> dst AND dst NOT IN (SELECT id FROM memories)", "links", "memories")
def c3_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.dangling_links(_memories(spark, sf_dir)).select(F.col("src").alias("superseder_id"), F.col("dst").alias("missing_target_id"))


_CYCLES = "SELECT cycle, list(m.id ORDER BY m.id) AS ids, coalesce(list(m.id ORDER BY m.id) FILTER (WHERE b.active), []) AS alive FROM members m JOIN memories b ON m.id = b.id GROUP BY cycle"


@query(f"SELECT cycle, array_to_string(ids, ',') AS members, array_to_string(alive, ',') AS active_members FROM ({_CYCLES})", "members", "memories")
def c3_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: strongly connected components of the resolved links."""
    return ck.cycle_groups(ck.cycle_members(_memories(spark, sf_dir))).select("cycle", F.array_join("members", ",").alias("members"), F.array_join("active_members", ",").alias("active_members"))


_DIRECT = "SELECT dst AS id, src AS superseder FROM resolved WHERE dst_active AND dst NOT IN (SELECT id FROM members)"


@query(_DIRECT, "resolved", "members")
def c3_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = _memories(spark, sf_dir)
    return ck.direct_stale(memories, ck.cycle_members(memories))


_C3_ITEMS = f"""SELECT ids, [{{'kind': 'supersession_cycle', 'data': '{{"active_members":["' || array_to_string(alive, '","') || '"],"members":["' || array_to_string(ids, '","') || '"]}}'}}] AS items FROM ({_CYCLES}) WHERE len(alive) > 0
UNION ALL SELECT [id], list({{'kind': 'active_superseded', 'data': '{{"old_active":true,"superseding_memory_id":"' || superseder || '"}}'}} ORDER BY superseder) FROM ({_DIRECT}) GROUP BY id"""


@query(_ids_sql("stale_active", _C3_ITEMS), "resolved", "members")
def c3_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(ck.stale_active(_memories(spark, sf_dir)).findings)


@query(
    _details_sql(
        f"SELECT (SELECT count(*) FROM memories) AS memories_scanned, (SELECT count(*) FROM ({_CYCLES}) WHERE len(alive) > 0) + (SELECT count(DISTINCT id) FROM ({_DIRECT})) AS findings_emitted, (SELECT count(*) FROM links) AS l, "
        f"(SELECT count(*) FROM links WHERE src = dst) AS o, (SELECT count(*) FROM resolved) AS r, (SELECT count(DISTINCT cycle) FROM members) AS c",
        {"supersession_links_scanned": "l", "resolved_supersession_links": "r", "missing_targets_skipped": "l - o - r", "self_links_skipped": "o", "supersession_cycles": "c"},
    ),
    "links", "resolved", "members",
)
def c3_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stat_rows(ck.stale_active(_memories(spark, sf_dir)).stats)


# --- isolation ------------------------------------------------------------------------------------


@query("SELECT dimension, source AS source_principal, string_agg(DISTINCT destination, ',' ORDER BY destination) AS destination_principals FROM rules GROUP BY dimension, source", "rules")
def a9_policy_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.canonical_policy(views.rules(spark)).select("dimension", "source_principal", F.array_join("destination_principals", ",").alias("destination_principals"))


_PRINCIPALS = "SELECT r.*, f.id, f.user_id, f.content, f.folded, f.active, f.provenance_status, f.doc_id FROM (SELECT DISTINCT dimension, source FROM rules) r JOIN folded f ON f.user_id = r.source"
_DESTINATIONS = "SELECT r.*, f.id, f.user_id, f.content, f.folded, f.active, f.provenance_status, f.doc_id FROM rules r JOIN folded f ON f.user_id = r.destination"
# Variants have neither references nor links, base records may have both.
_HAS_REFS = "({x}.id IN (SELECT id FROM refs))"
_REFS_TEXT = "coalesce((SELECT string_agg(transcript_id || ':' || coalesce(turn_idx::VARCHAR, '') || ':' || coalesce(span_start::VARCHAR, '') || ':' || coalesce(span_end::VARCHAR, ''), ',' ORDER BY pos) FROM refs WHERE refs.id = {x}.id), '')"
_REPLICAS = f"""SELECT s.dimension, s.source AS rule, s.id AS source_id, d.id AS destination_id, d.user_id AS destination_principal, sha256(d.folded) AS sha, CASE WHEN s.content = d.content THEN 'exact' ELSE 'normalized' END AS match_kind,
  list_sort(list_filter([CASE WHEN s.active IS DISTINCT FROM d.active THEN 'active' END, CASE WHEN s.content <> d.content THEN 'content' END, CASE WHEN s.provenance_status <> d.provenance_status THEN 'provenance_status' END,
    CASE WHEN rs.t IS DISTINCT FROM rd.t THEN 'source_refs' END, CASE WHEN ls.t IS DISTINCT FROM ld.t THEN 'supersedes' END], lambda x: x IS NOT NULL)) AS differing
FROM ({_PRINCIPALS}) s JOIN ({_DESTINATIONS}) d ON s.dimension = d.dimension AND s.source = d.source AND s.folded = d.folded
LEFT JOIN ref_texts rs ON rs.id = s.id LEFT JOIN ref_texts rd ON rd.id = d.id LEFT JOIN link_texts ls ON ls.id = s.id LEFT JOIN link_texts ld ON ld.id = d.id"""
views.SQL["ref_texts"] = "SELECT id, string_agg(transcript_id || ':' || coalesce(turn_idx::VARCHAR, '') || ':' || coalesce(span_start::VARCHAR, '') || ':' || coalesce(span_end::VARCHAR, ''), ',' ORDER BY pos) AS t FROM refs GROUP BY id"
views.SQL["link_texts"] = "SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS t FROM links GROUP BY src"
views._NEEDS["ref_texts"], views._NEEDS["link_texts"] = ["refs"], ["links"]
_C4_VIEWS = ("folded", "rules", "ref_texts", "link_texts")


@query(f"SELECT dimension, rule, source_id, destination_id, destination_principal, sha, match_kind, array_to_string(differing, ',') AS differing_fields FROM ({_REPLICAS})", *_C4_VIEWS)
def c4_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicas across a prohibited boundary, and the fields in which they differ."""
    found = ck.replicas(ck.principals(_memories(spark, sf_dir), ck.canonical_policy(views.rules(spark))))
    return found.withColumn("differing_fields", F.array_join("differing_fields", ","))


@query(
    f"""SELECT dimension, rule, sha, destination_principal, match_kind, array_to_string(differing, ',') AS differing_fields, count(*) AS replicas, count(DISTINCT source_id) AS sources, count(DISTINCT destination_id) AS destinations
FROM ({_REPLICAS}) GROUP BY ALL""",
    *_C4_VIEWS,
)
def j8_replica_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicas counted from pairs of classes, without writing them out."""
    found = ck.replica_factors(ck.principals(_memories(spark, sf_dir), ck.canonical_policy(views.rules(spark))))
    fields = F.array_join("differing_fields", ",").alias("differing_fields")
    once = lambda side: F.aggregate(F.collect_set(F.struct(f"{side}_class", f"{side}s")), F.lit(0).cast("long"), lambda n, x: n + x[f"{side}s"]).alias(f"{side}s")
    return found.groupBy("dimension", "rule", "sha", "destination_principal", "match_kind", fields).agg(F.sum(F.col("sources") * F.col("destinations")).alias("replicas"), once("source"), once("destination"))


_C4_DATA = """'{"authoritative_source_memory_id":"' || source_id || '","authoritative_source_principal":"' || rule || '","destination_principal":"' || destination_principal || '","differing_fields":[' ||
  array_to_string(list_transform(differing, lambda x: '"' || x || '"'), ',') || '],"match_kind":"' || match_kind || '","normalized_content_sha256":"' || sha || '","scope_dimension":"' || dimension || '"}'"""
_C4_ITEMS = f"SELECT [destination_id] AS ids, list({{'kind': 'prohibited_scope_replica', 'data': data}} ORDER BY data) AS items FROM (SELECT destination_id, {_C4_DATA} AS data FROM ({_REPLICAS})) GROUP BY destination_id"


@query(_ids_sql("privacy_scope_violation", _C4_ITEMS), *_C4_VIEWS)
def c4_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(ck.privacy_scope_violation(_memories(spark, sf_dir), views.rules(spark)).findings)


@query(
    _details_sql(
        f"SELECT (SELECT count(*) FROM memories) AS memories_scanned, (SELECT count(DISTINCT destination_id) FROM ({_REPLICAS})) AS findings_emitted, (SELECT count(*) FROM (SELECT DISTINCT dimension, source FROM rules)) AS r, "
        f"(SELECT count(*) FROM ({_PRINCIPALS})) AS s, (SELECT count(*) FROM ({_DESTINATIONS})) AS d, (SELECT count(*) FROM ({_REPLICAS})) AS m",
        {"policy_rules_scanned": "r", "authoritative_candidates": "s", "destination_candidates": "d", "replica_matches": "m"},
    ),
    *_C4_VIEWS,
)
def c4_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stat_rows(ck.privacy_scope_violation(_memories(spark, sf_dir), views.rules(spark)).stats)


# --- entailment -----------------------------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda x: x <> '')"
_SHARE = "CASE WHEN len(h) = 0 THEN 0 ELSE len(list_intersect(h, p)) / len(h) END"
_JUDGED = f"""SELECT *, CASE WHEN score >= 0.5 THEN 'entailment' WHEN score < 0.1 THEN 'contradiction' ELSE 'neutral' END AS relation FROM (SELECT *, {_SHARE} AS score
FROM (SELECT *, list_distinct({_WORDS.format(x='content')}) AS h, list_distinct({_WORDS.format(x='premise')}) AS p, len({_WORDS.format(x='content')}) + len({_WORDS.format(x='premise')}) AS tokens FROM premises WHERE outcome = 'assess'))"""


@query(f"SELECT id, relation, round(score, 9) AS score, tokens AS input_tokens FROM ({_JUDGED})", "premises")
def c5_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge as an Arrow UDF over distinct pairs of texts."""
    found = ck.judged(_memories(spark, sf_dir), *_transcripts(spark, sf_dir), LexicalJudge())
    return found.select("id", F.col("judgment.relation").alias("relation"), F.round("judgment.score", 9).alias("score"), F.col("judgment.input_tokens").alias("input_tokens"))


_C5_ITEMS = f"""SELECT [id] AS ids, [{{'kind': 'declared_evidence_not_entailing', 'data': '{{"composition_style":"plain","hypothesis_sha256":"' || sha256(content) || '","judge_id":"lexical-overlap","judge_version":"1","premise_sha256":"' || sha256(premise) ||
  '","semantic_relation":"' || relation || '","source_coordinates":' || coordinates || ',"unique_segment_count":' || unique_segment_count || '}}'}}] AS items FROM ({_JUDGED}) WHERE relation <> 'entailment'"""


@query(_ids_sql("unsupported_claim", _C5_ITEMS), "premises")
def c5_lexical_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(ck.unsupported_claim(_memories(spark, sf_dir), *_transcripts(spark, sf_dir), LexicalJudge()).findings)


@query(
    _details_sql(
        f"SELECT (SELECT count(*) FROM memories) AS memories_scanned, count(*) FILTER (WHERE relation <> 'entailment') AS findings_emitted, count(*) AS a, (SELECT count(*) FROM memories WHERE provenance_status = 'declared') AS d, "
        f"(SELECT count(*) FROM premises WHERE outcome = 'resolution_issues') AS i, (SELECT count(*) FROM premises WHERE outcome = 'no_evidence') AS z, count(*) FILTER (WHERE relation = 'entailment') AS e, "
        f"count(*) FILTER (WHERE relation = 'neutral') AS n, count(*) FILTER (WHERE relation = 'contradiction') AS c FROM ({_JUDGED})",
        {
            "declared_memories": "d", "assessed_memories": "a", "skipped_non_declared_provenance": "memories_scanned - d", "skipped_resolution_issues": "i", "skipped_no_evidence": "z", "skipped_input_too_long": "0::BIGINT",
            "entailment_judgments": "e", "neutral_judgments": "n", "contradiction_judgments": "c",
        },
    ),
    "memories", "premises",
)
def c5_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stat_rows(ck.unsupported_claim(_memories(spark, sf_dir), *_transcripts(spark, sf_dir), LexicalJudge()).stats)


# --- retrieval ------------------------------------------------------------------------------------


@query("SELECT 'vec-' || q AS request_id, 'vec-' || vec_id AS memory_id, rank FROM hits", "hits")
def t8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded hits, ranked by cosine similarity."""
    return views.observations(spark, sf_dir).select("request_id", F.explode("hits").alias("h")).select("request_id", F.col("h.memory_id").alias("memory_id"), F.col("h.rank").cast("long").alias("rank"))


def _sufficiency(policy: str) -> tuple[str, Query]:
    name = ck.POLICIES[policy]
    condition = "len(missing) = 0" if policy == "all" else "len(retrieved) > 0"
    sql = f"SELECT request_id, '{name}' AS policy, array_to_string(expected, ',') AS expected, array_to_string(retrieved, ',') AS retrieved, array_to_string(missing, ',') AS missing, {condition} AS sufficient FROM cases"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = ck.retrieval_sufficiency(views.observations(spark, sf_dir), name)
        return found.select("request_id", "policy", *(F.array_join(c, ",").alias(c) for c in ("expected", "retrieved", "missing")), "sufficient")

    run.__name__ = f"q3_sufficiency_{policy}"
    return sql, run


for _policy in ck.POLICIES:
    _sql, _run = _sufficiency(_policy)
    query(_sql, "cases")(_run)

_QUOTED = "array_to_string(list_transform({x}, lambda x: '\"' || x || '\"'), ',')"
_C6_ITEMS = f"""SELECT missing AS ids, [{{'kind': 'insufficient_retrieval', 'data': '{{"expected_memory_ids":[' || {_QUOTED.format(x='expected')} || '],"missing_expected_memory_ids":[' || {_QUOTED.format(x='missing')} || '],"policy":"all_expected","query_sha256":"' ||
  sha256(request_id) || '","request_id":"' || request_id || '","retrieved_expected_memory_ids":[' || {_QUOTED.format(x='retrieved')} || '],"retriever_id":"cosine","retriever_version":"1","top_k":{views.TOP_K}}}'}}] AS items FROM cases WHERE len(missing) > 0"""


@query(_ids_sql("retrieval_shadowing", _C6_ITEMS), "cases")
def c6_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(ck.retrieval_shadowing(views.observations(spark, sf_dir), "all_expected").findings)


@query(
    _details_sql(
        "SELECT 0::BIGINT AS memories_scanned, count(*) FILTER (WHERE len(missing) > 0) AS findings_emitted, count(*) AS c, sum(len(expected))::BIGINT AS e, sum(len(retrieved))::BIGINT AS r, sum(len(missing))::BIGINT AS m FROM cases",
        {"retrieval_cases_assessed": "c", "expected_targets": "e", "retrieved_expected_targets": "r", "missing_expected_targets": "m", "retrieval_calls": "c", "candidate_count": f"{views.TOP_K} * c", "hits_observed": f"{views.TOP_K} * c"},
    ),
    "cases",
)
def c6_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stat_rows(ck.retrieval_shadowing(views.observations(spark, sf_dir), "all_expected").stats)


def _expected_and_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seen = written(views.observations(spark, sf_dir))
    hits = seen.select("request_id", F.explode("hits.memory_id").alias("memory_id"))
    return seen.select("request_id", F.explode("expected_memory_ids").alias("memory_id")), hits


_NEAR = "SELECT 'vec-' || q AS request_id, 'vec-' || vec_id AS memory_id FROM hits"


@query(f"SELECT e.request_id, e.memory_id FROM expected e JOIN ({_NEAR}) h USING (request_id, memory_id)", "expected", "hits")
def j9_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, hits = _expected_and_hits(spark, sf_dir)
    return expected.join(hits, ["request_id", "memory_id"], "left_semi")


@query(f"SELECT e.request_id, e.memory_id FROM expected e ANTI JOIN ({_NEAR}) h USING (request_id, memory_id)", "expected", "hits")
def j9_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, hits = _expected_and_hits(spark, sf_dir)
    return expected.join(hits, ["request_id", "memory_id"], "left_anti")


# --- reports --------------------------------------------------------------------------------------


@query(
    "SELECT 'orphaned_provenance' AS checker_id, (SELECT count(*) FROM memories) AS memories_scanned, (SELECT count(DISTINCT id) FROM classified WHERE " + _ISSUE_KINDS + ") AS findings_emitted, 'error' AS severity "
    f"UNION ALL SELECT 'redundancy_bloat', (SELECT count(*) FROM memories), (SELECT count(*) FROM ({_C2_GROUPS})), 'warning' "
    f"UNION ALL SELECT 'stale_active', (SELECT count(*) FROM memories), (SELECT count(*) FROM ({_CYCLES}) WHERE len(alive) > 0) + (SELECT count(DISTINCT id) FROM ({_DIRECT})), 'error' "
    f"UNION ALL SELECT 'privacy_scope_violation', (SELECT count(*) FROM memories), (SELECT count(DISTINCT destination_id) FROM ({_REPLICAS})), 'error' "
    f"UNION ALL SELECT 'unsupported_claim', (SELECT count(*) FROM memories), (SELECT count(*) FROM ({_JUDGED}) WHERE relation <> 'entailment'), 'error'",
    "classified", "premises", "members", *_C4_VIEWS,
)
def r1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All public checks in one plan."""
    audit = report.audit(_memories(spark, sf_dir), transcripts=_transcripts(spark, sf_dir), rules=views.rules(spark), judge=LexicalJudge())
    severity = F.create_map(*[F.lit(x) for r in RULES_BY_CHECKER.values() for x in (r.checker_id, r.severity)])
    return audit.stats.select("checker_id", "memories_scanned", "findings_emitted", F.element_at(severity, F.col("checker_id")).alias("severity"))


@query(
    "SELECT c AS checker_id, CASE WHEN a < n THEN 'degraded' ELSE 'ready' END AS status, n AS total_memories, a AS assessable_memories, CASE WHEN a < n THEN l ELSE '' END AS limitations, '' AS blocked_reasons FROM "
    "(SELECT *, (SELECT count(*) FROM memories) AS n FROM (SELECT 'orphaned_provenance' AS c, (SELECT count(*) FROM memories WHERE provenance_status = 'declared') AS a, 'non_declared_provenance' AS l "
    "UNION ALL SELECT 'unsupported_claim', (SELECT count(*) FROM memories WHERE provenance_status = 'declared'), 'non_declared_provenance' UNION ALL SELECT 'redundancy_bloat', (SELECT count(*) FROM memories WHERE user_id IS NOT NULL), 'unscoped_memories' "
    "UNION ALL SELECT 'stale_active', (SELECT count(*) FROM memories WHERE active IS NOT NULL), 'active_state_unavailable' UNION ALL SELECT 'privacy_scope_violation', (SELECT count(*) FROM memories WHERE user_id IS NOT NULL), 'policy_scope_unavailable'))",
    "memories",
)
def r2_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each check can assess, in one pass."""
    found = report.preflight(_memories(spark, sf_dir), adapter="file", has_transcripts=True, rules=views.rules(spark), has_judge=True)
    return found.select("checker_id", "status", "total_memories", "assessable_memories", F.array_join("limitations", ",").alias("limitations"), F.array_join("blocked_reasons", ",").alias("blocked_reasons"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS adapter, '{f}' AS facet, '{CAPABILITIES[a][f]}' AS state" for a in CAPABILITIES for f in CAPABILITY_FACETS))
def r3_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.capabilities(spark)


_SARIF_C1 = _ids_sql("orphaned_provenance", _C1_ITEMS)


@query(f"SELECT finding_id, 'error' AS level, memory_ids AS location, len(string_split(kinds, ',')) AS parts FROM ({_SARIF_C1})", "classified")
def o9_sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as SARIF results, read back from their JSON."""
    rows = report.sarif_results(ck.orphaned_provenance(_memories(spark, sf_dir), *_transcripts(spark, sf_dir)).findings, 0)
    get = lambda path: F.get_json_object("result", path)
    return rows.select(get("$.fingerprints.mnemoraFindingId").alias("finding_id"), get("$.level").alias("level"), get("$.locations[0].logicalLocations[0].name").alias("location"), F.size(F.split(get("$.message.text"), "; ")).cast("long").alias("parts"))


# --- constraints, sets and scalars ----------------------------------------------------------------


@query("SELECT content_sha256 AS id, count(*) AS n FROM (SELECT sha256(text) AS content_sha256 FROM documents) GROUP BY content_sha256 HAVING count(*) > 1")
def k8_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that occur more than once (of records named by their content)."""
    from ..operators.constraints import duplicate_ids

    return duplicate_ids(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.sha2("text", 256).alias("id")))


@query(
    "SELECT id, 'supersedes_itself' AS violated FROM base WHERE doc_id % 7 = 0 UNION ALL SELECT id, 'content_blank' FROM base WHERE doc_id % 11 = 0 UNION ALL SELECT id, 'embedding_invalid' FROM base WHERE doc_id % 13 = 0 "
    "UNION ALL SELECT id, 'provenance_mismatch' FROM base WHERE doc_id % 13 = 0 UNION ALL SELECT id, 'scope_blank' FROM base WHERE doc_id % 17 = 0 UNION ALL SELECT id, 'supersedes_repeated' FROM base WHERE doc_id % 19 = 0 AND doc_id % 7 <> 0",
    "base",
)
def k1_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 to K7: records made to break constraints of a memory, and which they break."""
    from ..operators.constraints import memory_violations

    d = F.substring("id", 5, 8).cast("long")
    broken = _memories(spark, sf_dir).where(F.length("id") == 12).withColumns({
        "supersedes": F.when(d % 7 == 0, F.array("id")).when(d % 19 == 0, F.array(F.lit("x"), F.lit("x"))).otherwise(F.array().cast("array<string>")),
        "content": F.when(d % 11 == 0, " \t\u3000").otherwise(F.concat(F.lit("."), F.col("content"))), "embedding": F.when(d % 13 == 0, F.array(F.lit(float("nan")))),
        "provenance_status": F.when(d % 13 == 0, "declared").otherwise(F.col("provenance_status")), "scope": F.col("scope").withField("user_id", F.when(d % 17 == 0, " ").otherwise("u")),
    })
    return memory_violations(broken).select("id", "violated")


@query("SELECT id, replace(content, 'the', 'THE') AS content FROM memories WHERE (length(content) - length(replace(content, 'the', ''))) / 3 = 1", "memories")
def h15_replace_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact replacement where the text occurs exactly once."""
    df = _memories(spark, sf_dir).select("id", "content")
    return df.where(mu.occurrences(F.col("content"), "the") == 1).select("id", mu.replaced_once(F.col("content"), "the", "THE").alias("content"))


@query("SELECT id FROM memories UNION ALL SELECT id || '-copy' FROM memories WHERE doc_id % 7 = 0", "memories")
def u1_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _memories(spark, sf_dir)
    copied = df.where(F.regexp_extract("id", r"(\d{8})", 1).cast("long") % 7 == 0).withColumn("id", F.concat("id", F.lit("-copy")))
    return mu.append(df, copied).select("id")


@query("SELECT id, '{\"active\":' || CASE WHEN active THEN 'true' WHEN NOT active THEN 'false' ELSE 'null' END || ',\"id\":\"' || id || '\",\"scope\":{\"agent_id\":null,\"session_id\":null,\"user_id\":' || coalesce('\"' || user_id || '\"', 'null') || '}}' AS canonical FROM memories", "memories")
def h10_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.struct(*(F.col(f"scope.{d}").alias(d) for d in ("agent_id", "session_id", "user_id")))
    return _memories(spark, sf_dir).select("id", json_of(active=F.col("active"), id=F.col("id"), scope=scope).alias("canonical"))


@query("SELECT id, doc_id % 3 <> 0 AS blank FROM memories", "memories")
def h14_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space of any kind, and none at all, is blank."""
    d = F.substring("id", 5, 8).cast("long")
    content = F.when(d % 3 == 1, "").when(d % 3 == 2, " \t\n\u00a0\u2003\u3000\x1c").otherwise(F.concat(F.lit(" "), "content", F.lit("x\u2003")))
    return _memories(spark, sf_dir).select("id", is_blank(content).alias("blank"))


# --- mutations of the whole store, then the check that should see them -----------------------------


_CLAIM, _TARGET = "User lives in Lyon.", "doc-00000004"


def _adapted(spark: SparkSession, sf_dir: str, **columns: F.Column) -> DataFrame:
    """The whole store, in which the target is active and says where a user lives."""
    here = F.col("id") == _TARGET
    changed = {"content": F.lit(_CLAIM), "active": F.lit(True), "scope": F.col("scope").withField("user_id", F.lit("user-en"))} | columns
    return _memories(spark, sf_dir).withColumns({k: F.when(here, c).otherwise(F.col(k)) for k, c in changed.items()})


def _reference(transcript: str) -> dict[str, F.Column]:
    ref = F.struct(F.lit(transcript).alias("transcript_id"), F.lit(0).alias("turn_idx"), F.lit(None).cast("struct<start:int,end:int>").alias("span"))
    return {"source_refs": F.array(ref), "provenance_status": F.lit("declared")}


views.SQL["adapted"] = f"SELECT doc_id, id, CASE WHEN id = '{_TARGET}' THEN '{_CLAIM}' ELSE content END AS content, CASE WHEN id = '{_TARGET}' THEN 'user-en' ELSE user_id END AS user_id FROM memories"
views._NEEDS["adapted"] = ["memories"]


@query(f"SELECT relation, count(*) AS memories FROM (SELECT relation FROM ({_JUDGED}) WHERE id <> '{_TARGET}' UNION ALL SELECT 'contradiction') GROUP BY relation", "premises")
def m1_substitute_then_c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcripts, turns = _transcripts(spark, sf_dir)
    transcripts = transcripts.unionByName(spark.createDataFrame([("t-1",)], "transcript_id string"))
    turns = turns.unionByName(spark.createDataFrame([("t-1", 0, "user", "Lyon is where I live.")], "transcript_id string, turn_idx int, role string, content string"))
    base = _adapted(spark, sf_dir, content=F.lit("Lyon"), **_reference("t-1"))
    done = mu.mutate(base, mu.Request("unsupported_claim", target_memory_id=_TARGET, replace_from="Lyon", replace_to="Oslo"), (transcripts, turns))
    found = ck.judged(done.memories, transcripts, turns, LexicalJudge())
    return found.groupBy(F.col("judgment.relation").alias("relation")).agg(F.count(F.lit(1)).alias("memories"))


@query("SELECT count(*) + 1 AS memories, count(DISTINCT content) + 1 AS contents, count(DISTINCT user_id) AS users FROM adapted", "adapted")
def m2_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = mu.Request("internal_contradiction", target_memory_id=_TARGET, replace_from="Lyon", replace_to="Oslo", conflict_relation="exclusive_value")
    done = mu.mutate(_adapted(spark, sf_dir), request)
    return done.memories.agg(F.count(F.lit(1)).alias("memories"), F.count_distinct("content").alias("contents"), F.count_distinct("scope.user_id").alias("users"))


@query(
    f"SELECT array_to_string(ids, ',') AS memory_ids, array_to_string(list_transform(items, lambda x: x.kind), ',') AS kinds FROM ({_C3_ITEMS}) WHERE NOT list_contains(ids, '{_TARGET}') "
    f"UNION ALL SELECT '{_TARGET}', 'active_superseded,active_superseded'",
    "resolved", "members",
)
def m3_stale_then_c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target, which the record before it supersedes already, gets a second superseder."""
    done = mu.mutate(_adapted(spark, sf_dir), mu.Request("stale_active", target_memory_id=_TARGET, replace_from="Lyon", replace_to="Oslo"))
    return _flat(ck.stale_active(done.memories).findings).select("memory_ids", "kinds")


def _broken(subtype: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        transcripts, turns = _transcripts(spark, sf_dir)
        done = mu.mutate(_adapted(spark, sf_dir, **_reference("conv-0")), mu.Request("orphaned_provenance", subtype, target_memory_id=_TARGET), (transcripts, turns))
        return _flat(ck.orphaned_provenance(done.memories, transcripts, turns).findings).select("memory_ids", "kinds")

    run.__name__ = f"m4_{subtype}_then_c1"
    return run


for _subtype in mu.SUBTYPES["orphaned_provenance"]:
    query(
        f"SELECT ids[1] AS memory_ids, array_to_string(list_transform(items, lambda x: x.kind), ',') AS kinds FROM ({_C1_ITEMS}) WHERE ids[1] <> '{_TARGET}' UNION ALL SELECT '{_TARGET}', '{_subtype}'", "classified"
    )(_broken(_subtype))


@query("SELECT count(*) + 3 AS memories, count(DISTINCT user_id) AS users FROM adapted", "adapted")
def m5_crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mu.mutate(_adapted(spark, sf_dir), mu.Request("retrieval_shadowing", target_memory_id=_TARGET, query="Which editor?", distractor_family="editor"))
    return done.memories.agg(F.count(F.lit(1)).alias("memories"), F.count_distinct("scope.user_id").alias("users"))


@query("SELECT count(*) + 1 AS memories, count(*) FILTER (WHERE contains(content, 'haiku')) + 1 AS injected FROM memories", "memories")
def m6_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mu.mutate(_memories(spark, sf_dir), mu.Request("injected_instruction", "format_override", seed=42))
    return done.memories.agg(F.count(F.lit(1)).alias("memories"), F.count_if(F.contains("content", F.lit("haiku"))).alias("injected"))


@query(f"SELECT count(DISTINCT destination_id) + 1 AS findings FROM ({_REPLICAS}) WHERE source_id <> '{_TARGET}' AND destination_id <> '{_TARGET}'", *_C4_VIEWS)
def m7_scope_then_c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mu.mutate(_adapted(spark, sf_dir), mu.Request("privacy_scope_violation", target_memory_id=_TARGET, destination_user_id="user-de"))
    return ck.privacy_scope_violation(done.memories, views.rules(spark)).findings.agg(F.count(F.lit(1)).alias("findings"))


@query(
    f"SELECT count(*) + CASE WHEN count(*) FILTER (WHERE list_contains(ids, '{_TARGET}')) = 0 THEN 1 ELSE 0 END AS findings, "
    f"(sum(n) + 1 + CASE WHEN count(*) FILTER (WHERE list_contains(ids, '{_TARGET}')) = 0 THEN 1 ELSE 0 END)::BIGINT AS members FROM ({_C2_GROUPS})",
    "folded",
)
def m8_duplicate_then_c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mu.mutate(_memories(spark, sf_dir), mu.Request("redundancy_bloat", target_memory_id=_TARGET))
    return ck.redundancy_bloat(done.memories).findings.agg(F.count(F.lit(1)).alias("findings"), F.sum(F.size("memory_ids")).cast("long").alias("members"))


_SEEDS = (0, 1, 42)


def _seeded_sql() -> str:
    """The place that a seeded draw below n names, from the generator's first numbers: it takes as many leading bits as n
    has until they are below n."""
    import random

    draws = ", ".join(f"({seed}, {i}, {x})" for seed in _SEEDS for r in [random.Random(seed)] for i, x in enumerate([r.getrandbits(32) for _ in range(40)]))
    return f"""SELECT p.seed, e.id FROM (SELECT seed, arg_min(x >> (32 - k), i) AS place FROM (VALUES {draws}) d(seed, i, x)
CROSS JOIN (SELECT count(*) AS n, length(bin(count(*))) AS k FROM memories WHERE active) WHERE (x >> (32 - k)) < n GROUP BY seed) p
JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM memories WHERE active) e ON e.place = p.place"""


@query(_seeded_sql(), "memories")
def t7_seeded_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of all active memories a seed draws."""
    memories = _memories(spark, sf_dir)
    chosen = [(seed, mu.choose(memories, mu.Request("stale_active", seed=seed), F.col("active"), "an active memory")["id"]) for seed in _SEEDS]
    return spark.createDataFrame(chosen, "seed int, id string")


# --- records of other stores, as memories ---------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str, **fields: F.Column) -> DataFrame:
    """(v): a record per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("d", F.col("doc_id"))
    text = F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "true"})
    return docs.select(F.parse_json(text).alias("v"), F.lit("json").alias("file_format"), *([F.when(F.col("d") % 2 == 0, "core").otherwise("archival").alias("memory_type")]))


def _states(memories: DataFrame) -> DataFrame:
    flat = [F.col(f"scope.{d}").alias(d) for d in views.DIMENSIONS]
    refs = F.array_join(F.transform("source_refs", lambda r: F.concat_ws(":", r["transcript_id"], F.coalesce(r["turn_idx"].cast("string"), F.lit("-")))), ",")
    return memories.select("id", F.sha2("content", 256).alias("content_sha256"), *flat, "provenance_status", "active", refs.alias("refs"), "created_at_text")


@query(
    "SELECT 'r' || doc_id AS id, sha256(text) AS content_sha256, CASE WHEN doc_id % 3 = 0 THEN 'inner' WHEN doc_id % 3 = 1 THEN 'u' || doc_id END AS user_id, NULL::VARCHAR AS agent_id, 's' AS session_id, "
    "CASE WHEN doc_id % 4 = 0 THEN 'declared' WHEN doc_id % 4 = 1 THEN 'known_absent' ELSE 'unavailable' END AS provenance_status, CASE WHEN doc_id % 5 = 0 THEN true WHEN doc_id % 5 = 1 THEN false END AS active, "
    "CASE WHEN doc_id % 4 = 0 THEN 't' || doc_id || ':' || doc_id % 7 ELSE '' END AS refs, '2024-03-01T10:00:' || lpad((doc_id % 60)::VARCHAR, 2, '0') || 'Z' AS created_at_text FROM documents WHERE text <> ''"
)
def n1_file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of files; a scope object wins by key, an empty list of references says that there are none."""
    d = F.col("doc_id")
    ref = F.array(F.struct(F.concat(F.lit("t"), d.cast("string")).alias("transcript_id"), (d % 7).alias("turn_idx")))
    scope = F.when(d % 3 == 0, F.struct(F.lit("inner").alias("user_id")))
    rows = _records(
        spark, sf_dir, id=F.concat(F.lit("r"), d.cast("string")), content=F.col("text"), scope=scope, user_id=F.when(d % 3 != 2, F.concat(F.lit("u"), d.cast("string"))), session_id=F.lit("s"),
        source_refs=F.when(d % 4 == 0, ref).when(d % 4 == 1, F.array().cast("array<struct<transcript_id:string,turn_idx:bigint>>")), active=F.when(d % 5 < 2, d % 5 == 0),
        created_at=F.concat(F.lit("2024-03-01 10:00:"), F.lpad((d % 60).cast("string"), 2, "0"), F.lit("+00:00")),
    )
    return _states(normalize.file_records(rows)).join(spark.read.parquet(f"{sf_dir}/documents.parquet").where("text <> ''").select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("id")), "id")


@query(
    "SELECT 'm' || doc_id AS id, sha256(text) AS content_sha256, CASE WHEN doc_id % 2 = 0 THEN 'u' || doc_id ELSE 'asked' END AS user_id, CASE WHEN doc_id % 3 = 0 THEN 'True' END AS agent_id, "
    "CASE WHEN doc_id % 4 = 0 THEN 'run' WHEN doc_id % 4 = 1 THEN 'session' ELSE 'run-asked' END AS session_id, 'unavailable' AS provenance_status, NULL::BOOLEAN AS active, '' AS refs, NULL::VARCHAR AS created_at_text FROM documents"
)
def n2_mem0_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, else session_id, else the query's own filters."""
    d = F.col("doc_id")
    rows = _records(
        spark, sf_dir, id=F.concat(F.lit("m"), d.cast("string")), memory=F.col("text"), user_id=F.when(d % 2 == 0, F.concat(F.lit("u"), d.cast("string"))), agent_id=F.when(d % 3 == 0, F.lit(True)),
        run_id=F.when(d % 4 == 0, F.lit("run")), session_id=F.when(d % 4 < 2, F.lit("session")),
    )
    return _states(normalize.mem0_records(rows, {"user_id": "asked", "run_id": "run-asked"}))


@query(
    "SELECT 'g' || doc_id AS id, sha256(text) AS content_sha256, 'group-' || lang AS user_id, 'given' AS agent_id, NULL::VARCHAR AS session_id, CASE WHEN doc_id % 4 = 0 THEN 'declared' ELSE 'unavailable' END AS provenance_status, "
    "CASE WHEN doc_id % 5 = 0 THEN false END AS active, CASE WHEN doc_id % 4 = 0 THEN 't-a:-,t-b:3' ELSE '' END AS refs, NULL::VARCHAR AS created_at_text FROM documents"
)
def n3_graphiti_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group as a scope, episodes by the caller's map, a state only where a time says so."""
    d = F.col("doc_id")
    episodes = F.when(d % 4 == 0, F.array(*map(F.lit, ("e1", "unknown", "e2")))).when(d % 4 == 1, F.array(F.lit("unknown")))
    rows = _records(
        spark, sf_dir, uuid=F.concat(F.lit("g"), d.cast("string")), fact=F.col("text"), group_id=F.concat(F.lit("group-"), F.col("lang")), episodes=episodes, invalid_at=F.when(d % 5 == 0, F.lit("2024-01-01T00:00:00Z"))
    )
    return _states(normalize.graphiti_records(rows, {"agent_id": "given"}, "user_id", {"e1": "t-a", "e2": {"transcript_id": "t-b", "turn_idx": 3}}))


@query(
    "SELECT 'l' || doc_id AS id, sha256(text) AS content_sha256, NULL::VARCHAR AS user_id, 'agent' AS agent_id, NULL::VARCHAR AS session_id, 'unavailable' AS provenance_status, "
    "CASE WHEN doc_id % 2 = 0 THEN true ELSE doc_id % 3 <> 0 END AS active, '' AS refs, NULL::VARCHAR AS created_at_text FROM documents"
)
def n4_letta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core blocks are active, archival passages unless they are deleted."""
    d = F.col("doc_id")
    rows = _records(spark, sf_dir, id=F.concat(F.lit("l"), d.cast("string")), value=F.when(d % 2 == 0, F.col("text")), text=F.when(d % 2 == 1, F.col("text")), is_deleted=F.when(d % 2 == 1, d % 3 == 0))
    return _states(normalize.letta_records(rows, {"agent_id": "agent"}))


@query(
    "SELECT doc_id, 'file:' || substr(sha256('{\"adapter\":\"file\",\"content\":\"' || sha256(text) || '\",\"created_at\":\"2024-02-29T' || lpad((doc_id % 20 + 2)::VARCHAR, 2, '0') || ':30:00Z\",\"scope\":{\"agent_id\":null,\"session_id\":null,\"user_id\":\"' || lang || "
    "'\"},\"source_refs\":[{\"span\":null,\"transcript_id\":\"a\",\"turn_idx\":1},{\"span\":null,\"transcript_id\":\"b\",\"turn_idx\":null}]}'), 1, 24) AS id FROM documents"
)
def h8_generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from content, instant in UTC, scope and the set of references, whatever their order."""
    d = F.col("doc_id")
    ref = lambda t, n: F.struct(F.lit(t).alias("transcript_id"), F.lit(n).cast("int").alias("turn_idx"))
    hour = F.lpad((d % 20).cast("string"), 2, "0")
    rows = _records(
        spark, sf_dir, content=F.sha2("text", 256), user_id=F.col("lang"), created_at=F.concat(F.lit("2024-02-29T"), hour, F.lit(":30:00-02:00")), source_refs=F.array(ref("b", None), ref("a", 1), ref("b", None)), doc=d
    )
    made = normalize.file_records(rows)
    return made.select(F.get_json_object("raw", "$.source_metadata.doc").cast("long").alias("doc_id"), "id")


# --- gates, skips and the whole report ------------------------------------------------------------


@query("SELECT 'info' AS threshold, count(*) > 0 AS reached FROM classified WHERE " + _ISSUE_KINDS + f" UNION ALL SELECT 'warning', (SELECT count(*) FROM ({_C2_GROUPS})) + (SELECT count(*) FROM classified WHERE {_ISSUE_KINDS}) > 0 UNION ALL SELECT 'error', (SELECT count(*) FROM classified WHERE {_ISSUE_KINDS}) > 0", "classified", "folded")
def f13_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """which thresholds a check of duplicates (warning) and one of provenance (error) reach."""
    memories = _memories(spark, sf_dir)
    results = [ck.redundancy_bloat(memories), ck.orphaned_provenance(memories, *_transcripts(spark, sf_dir))]
    return spark.createDataFrame([(s, report.gate(results, s)) for s in ("info", "warning", "error")], "threshold string, reached boolean")


@query("SELECT * FROM (VALUES ('orphaned_provenance', 'missing_transcripts'), ('privacy_scope_violation', 'missing_scope_policy'), ('unsupported_claim', 'missing_semantic_configuration,missing_transcripts')) t(checker_id, reasons)")
def f14_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks without their inputs are skipped, and say why."""
    found = report.audit(_memories(spark, sf_dir))
    return spark.createDataFrame([(s["checker_id"], ",".join(sorted(s["reasons"]))) for s in found.skipped], "checker_id string, reasons string")


_O10_RULES = [(c, RULES_BY_CHECKER[c].rule_id) for c in ("orphaned_provenance", "redundancy_bloat")]


@query(
    f"SELECT '{_O10_RULES[0][1]}' AS rule, 0 AS rule_index, count(DISTINCT id) AS results FROM classified WHERE {_ISSUE_KINDS} UNION ALL SELECT '{_O10_RULES[1][1]}', 1, count(*) FROM ({_C2_GROUPS})", "classified", "folded"
)
def o10_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two checks in one run, by the rule that they name and its place."""
    memories = _memories(spark, sf_dir)
    found = [ck.orphaned_provenance(memories, *_transcripts(spark, sf_dir)).findings, ck.redundancy_bloat(memories).findings]
    rows = reduce(DataFrame.unionByName, [report.sarif_results(f, k) for k, f in enumerate(found)])
    return rows.groupBy(F.get_json_object("result", "$.ruleId").alias("rule"), F.get_json_object("result", "$.ruleIndex").cast("int").alias("rule_index")).agg(F.count(F.lit(1)).alias("results"))


# --- preflight that blocks, further constraints, files -------------------------------------------


_BLOCKED = {
    "letta": {
        "orphaned_provenance": ("", "missing_transcripts"),
        "redundancy_bloat": ("unscoped_memories", ""),
        "stale_active": ("active_state_unavailable,supersession_unsupported", ""),
        "privacy_scope_violation": ("policy_scope_unavailable", ""),
        "unsupported_claim": ("", "missing_transcripts,missing_semantic_configuration"),
    },
    "unknown": {
        "orphaned_provenance": ("", "missing_transcripts"),
        "redundancy_bloat": ("unscoped_memories", ""),
        "stale_active": ("active_state_unavailable", ""),
        "privacy_scope_violation": ("", "missing_scope_policy"),
        "unsupported_claim": ("", "missing_transcripts,missing_semantic_configuration"),
    },
}
_ASSESSABLE = {"redundancy_bloat": "user_id IS NOT NULL", "privacy_scope_violation": "user_id IS NOT NULL", "stale_active": "active IS NOT NULL"}


@query(
    " UNION ALL ".join(
        f"SELECT '{adapter}' AS adapter, '{checker}' AS checker_id, '{'blocked' if reasons else 'degraded'}' AS status, count(*) AS total_memories, "
        f"count(*) FILTER (WHERE {'false' if reasons else _ASSESSABLE[checker]}) AS assessable_memories, '{limits}' AS limitations, '{reasons}' AS blocked_reasons FROM memories"
        for adapter, checks in _BLOCKED.items()
        for checker, (limits, reasons) in checks.items()
    ),
    "memories",
)
def r2_preflight_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that lack their inputs are blocked; what a source never tells is a limitation, and an
    unknown source tells nothing of that."""
    memories = _memories(spark, sf_dir)
    given = {"letta": {"rules": views.rules(spark)}, "unknown": {}}
    rows = [report.preflight(memories, adapter=a, **given[a]).withColumn("adapter", F.lit(a)) for a in _BLOCKED]
    joined = [F.array_join(c, ",").alias(c) for c in ("limitations", "blocked_reasons")]
    return reduce(DataFrame.unionByName, rows).select("adapter", "checker_id", "status", "total_memories", "assessable_memories", *joined)


_CHANGED_TURNS = (
    "SELECT 'conv-' || conv_id AS id, CASE WHEN (conv_id + turn) % 5 = 0 THEN ' ' ELSE role END AS role, "
    "CASE WHEN conv_id % 7 = 0 THEN turn - 1 WHEN conv_id % 11 = 0 THEN turn // 2 ELSE turn END AS i FROM conversations"
)


@query(
    f"WITH c AS ({_CHANGED_TURNS}) SELECT id, 'role_blank' AS violated FROM c WHERE trim(role) = '' UNION ALL SELECT id, 'index_invalid' FROM c WHERE i < 0 "
    "UNION ALL SELECT id, 'index_repeated' FROM c GROUP BY id, i HAVING count(*) > 1"
)
def k10_turn_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns made to break the constraints of a transcript, and which they break."""
    turns, c, t = views.turns(spark, sf_dir), F.substring("transcript_id", 6, 20).cast("long"), F.col("turn_idx")
    index = F.when(c % 7 == 0, t - 1).when(c % 11 == 0, F.floor(t / 2).cast("int")).otherwise(t)
    changed = turns.select("transcript_id", "content", F.when((c + t) % 5 == 0, " ").otherwise(F.col("role")).alias("role"), index.alias("turn_idx"))
    return co.turn_violations(changed)


_K11 = ("query_hash_invalid", "more_hits_than_top_k", "identity_blank", "ranks_invalid", "expected_invalid", "ranks_invalid", "hit_id_blank", "usage_invalid")


@query(
    f"SELECT request_id AS id, CASE (substr(request_id, 5)::INT // 50) % {len(_K11)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_K11)) + " END AS violated FROM cases",
    "cases",
)
def k11_observation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded retrievals made to break a constraint each."""
    place = F.floor(F.substring("request_id", 5, 20).cast("long") / 50) % len(_K11)
    hits = lambda **changed: F.transform("hits", lambda h: h.withField(*next(iter(changed.items()))))
    blank = F.transform("hits", lambda h: h.withField("memory_id", F.when(h["rank"] == 1, " ").otherwise(h["memory_id"])))
    lost = F.transform("hits", lambda h: h.withField("rank", F.when(h["rank"] > 1, h["rank"])))
    broken = views.observations(spark, sf_dir).withColumns({
        "query_sha256": F.when(place == 0, F.upper("query_sha256")).otherwise(F.col("query_sha256")),
        "top_k": F.when(place == 1, F.size("hits") - 1).otherwise(F.col("top_k")),
        "retriever_id": F.when(place == 2, " \u3000").otherwise(F.col("retriever_id")),
        "hits": F.when(place == 3, hits(rank=F.lit(1))).when(place == 5, lost).when(place == 6, blank).otherwise(F.col("hits")),
        "expected_memory_ids": F.when(place == 4, F.concat("expected_memory_ids", "expected_memory_ids")).otherwise(F.col("expected_memory_ids")),
        "candidate_count": F.when(place == 7, F.lit(-1).cast("long")).otherwise(F.col("candidate_count")),
    })
    return co.observation_violations(broken)


@query(
    "SELECT finding_id AS id, CASE substr(memory_ids, 5, 8)::INT % 4 WHEN 0 THEN 'rule_version_invalid' WHEN 1 THEN 'memories_invalid' WHEN 2 THEN 'confidence_invalid' ELSE 'class_mismatch' END AS violated "
    f"FROM ({_ids_sql('orphaned_provenance', _C1_ITEMS)})",
    "classified",
)
def k13_finding_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of orphaned provenance made to break a constraint each."""
    found = ck.orphaned_provenance(_memories(spark, sf_dir), *_transcripts(spark, sf_dir)).findings
    place = F.substring(F.get("memory_ids", F.lit(0)), 5, 8).cast("int") % 4
    broken = found.withColumns({
        "rule_version": F.when(place == 0, "1.0").otherwise(F.col("rule_version")),
        "memory_ids": F.when(place == 1, F.concat("memory_ids", "memory_ids")).otherwise(F.col("memory_ids")),
        "confidence": F.when(place == 2, 1.5).otherwise(F.col("confidence")),
        "defect_class": F.when(place == 3, "stale_active").otherwise(F.col("defect_class")),
    })
    return co.finding_violations(broken)


views.SQL["ref_json"] = (
    "SELECT id, string_agg('{\"span\":' || coalesce('[' || span_start || ',' || span_end || ']', 'null') || ',\"transcript_id\":\"' || transcript_id || '\",\"turn_idx\":' || coalesce(turn_idx::VARCHAR, 'null') || '}', ',' ORDER BY pos) AS t FROM refs GROUP BY id"
)
views.SQL["link_json"] = "SELECT src AS id, string_agg('\"' || dst || '\"', ',' ORDER BY dst) AS t FROM links GROUP BY src"
views._NEEDS["ref_json"], views._NEEDS["link_json"] = ["refs"], ["links"]


_RECORD_VIEWS = ("memories", "ref_json", "link_json")
_RECORD_JSON = (
    "SELECT m.id, '{\"active\":' || coalesce(active::VARCHAR, 'null') || ',\"content\":' || to_json(content)::VARCHAR || ',\"created_at\":null,\"embedding\":null,\"id\":\"' || m.id || '\",\"provenance_status\":\"' || provenance_status || "
    "'\",\"scope\":{\"agent_id\":null,\"session_id\":null,\"user_id\":' || coalesce('\"' || user_id || '\"', 'null') || '},\"source_refs\":[' || coalesce(r.t, '') || '],\"supersedes\":[' || coalesce(l.t, '') || '],\"updated_at\":null}' AS json "
    "FROM memories m LEFT JOIN ref_json r ON r.id = m.id LEFT JOIN link_json l ON l.id = m.id"
)


@query(f"SELECT id, sha256(json) AS record_sha256 FROM ({_RECORD_JSON})", *_RECORD_VIEWS)
def a18_canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's portable fields as canonical JSON, of which a store's digest is made."""
    return mu.canonical_rows(_memories(spark, sf_dir)).select("id", F.sha2("json", 256).alias("record_sha256"))


_STORE_JSON = f"""'{{"adapter":"file","memories":[' || coalesce(string_agg(json, ',' ORDER BY id), '') || '],"schema_version":"{SCHEMA_VERSION}"}}'"""


@query(f"SELECT sha256({_STORE_JSON}) AS digest FROM ({_RECORD_JSON})", *_RECORD_VIEWS)
def a18_store_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the whole store, hashed in order by one task."""
    return spark.createDataFrame([(mu.store_digest(_memories(spark, sf_dir)),)], "digest string")


_TURN_JSON = """'{"content":' || to_json(content)::VARCHAR || ',"index":' || turn_idx || ',"metadata":{},"role":' || to_json(role)::VARCHAR || ',"timestamp":null}'"""


@query(
    f"""SELECT sha256('{{"schema_version":"{SCHEMA_VERSION}","transcripts":[' || coalesce(string_agg(json, ',' ORDER BY transcript_id), '') || ']}}') AS digest FROM (
  SELECT transcript_id, '{{"id":"' || transcript_id || '","metadata":{{}},"turns":[' || string_agg({_TURN_JSON}, ',' ORDER BY turn_idx) || ']}}' AS json FROM turns GROUP BY transcript_id
)""",
    "turns",
)
def a19_transcripts_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of all transcripts, turn by turn in order."""
    return spark.createDataFrame([(mu.transcripts_digest(_transcripts(spark, sf_dir)),)], "digest string")


# Of two levels at most, so up to 256 leaves.
@query(
    f"""SELECT CASE WHEN max(bits) = 0 THEN any_value(leaf) ELSE sha256(string_agg(leaf, '' ORDER BY node)) END AS root FROM (
  SELECT node, max(bits) AS bits, sha256(string_agg(h, '' ORDER BY h)) AS leaf FROM (
    SELECT h, bits, CASE WHEN bits = 0 THEN 0 ELSE ('0x' || substr(h, 1, 8))::BIGINT >> (32 - bits) END AS node
    FROM (SELECT h, ceil(log2(greatest(1, count(*) OVER () / {mu.LEAF_RECORDS}.0)))::INTEGER AS bits FROM (SELECT sha256(json) AS h FROM ({_RECORD_JSON})))
  ) GROUP BY node
)""",
    *_RECORD_VIEWS,
)
def a18_store_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of the store's Merkle tree."""
    return spark.createDataFrame([(mu.store_merkle(_memories(spark, sf_dir)),)], "root string")


@query(
    "SELECT 'r' || doc_id AS id, sha256(text) AS content_sha256, lang AS user_id, NULL::VARCHAR AS agent_id, NULL::VARCHAR AS session_id, 'known_absent' AS provenance_status, doc_id % 2 = 0 AS active, '' AS refs, NULL::VARCHAR AS created_at_text FROM documents"
)
def s3_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a line of JSON in a folder of files, read back as memories."""
    d, folder = F.col("doc_id"), f"{scratch_path(spark, 'lines')}/records.jsonl"
    none = F.array().cast("array<string>").alias("source_refs")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    record = F.struct(F.concat(F.lit("r"), d.cast("string")).alias("id"), F.col("text").alias("content"), F.col("lang").alias("user_id"), (d % 2 == 0).alias("active"), none)
    docs.select(F.to_json(record).alias("value")).write.text(folder)
    return _states(normalize.file_records(files.read_records(spark, folder)))


@query(
    f"SELECT request_id, sha256(request_id) AS query_sha256, array_to_string(expected, ',') AS expected, {views.TOP_K} AS top_k, h.hits FROM cases JOIN (SELECT 'vec-' || q AS request_id, string_agg('vec-' || vec_id || ':' || rank, ',' ORDER BY rank) AS hits FROM hits GROUP BY q) h USING (request_id)",
    "cases", "hits",
)
def s17_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded retrievals as lines of JSON, hits in any order, read back and validated; hits by rank."""
    folder = f"{scratch_path(spark, 'observations')}/observations.jsonl"
    record = F.struct("request_id", "query_sha256", "expected_memory_ids", "top_k", "retriever_id", "retriever_version", F.reverse("hits").alias("hits"), F.struct("retrieval_calls", "candidate_count").alias("usage"))
    views.observations(spark, sf_dir).select(F.to_json(record).alias("value")).write.text(folder)
    hit = F.transform("hits", lambda h: F.concat_ws(":", h["memory_id"], h["rank"].cast("string")))
    return files.load_observations(spark, folder).select("request_id", "query_sha256", F.array_join("expected_memory_ids", ",").alias("expected"), F.col("top_k").cast("int").alias("top_k"), F.array_join(hit, ",").alias("hits"))
